"""Shared small pieces of the corpus operators."""
from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capshare.session import shared_dir

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Paths of the tables written on the way to the result that is being built.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and every later read sees the same rows (row ids included)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``settle(build())``, after which the tables that ``build`` settled on its way are removed. The result must be all that is read later."""
    outer, inner = _made.get(), []
    mark = _made.set(inner)
    try:
        out = settle(build(), name)
    finally:
        _made.reset(mark)
    kept = inner.pop()
    for path in inner:
        remove(spark, path)
    if outer is not None:
        outer.append(kept)
    return out


def _from_files(docs: DataFrame) -> bool:
    return docs._jdf.queryExecution().optimizedPlan().nodeName() == "LogicalRelation"


def repeatable(df: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``df``, a projection of ``docs`` without row numbers (``numbered`` has them): a table just read from files is left there, any other is written first."""
    return df if _from_files(docs) else settle(df, name)


def numbered(docs: DataFrame, cols: list[Column], row: str, name: str) -> DataFrame:
    """``cols`` of ``docs`` behind a number of the row (``row``) that is the same in every scan. Rows just read from Parquet are numbered by file and place in the
    file, which no split of the files changes, and stay there; the rows of any other table are written with their numbers."""
    if _from_files(docs):
        place = docs.metadataColumn("_metadata")
        try:
            rows = docs.select(place["file_path"].alias("_path"), place["row_index"].alias("_index"), *cols)
        except AnalysisException:       # no places in files of this format
            rows = None
        if rows is not None:
            # one row a file, as in the driver's own listing of the files
            paths = sorted(r[0] for r in rows.select("_path").distinct().collect())
            files = docs.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], "_path string, _file long")
            return rows.join(F.broadcast(files), "_path").select((F.shiftleft("_file", 40) + F.col("_index")).alias(row), *rows.columns[2:])
    return settle(docs.select(F.monotonically_increasing_id().alias(row), *cols), name)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished step once the driver's collector finds its plan dead. Look now, before the next large step needs the disk.
    The listeners hold their last event, and with it the plan of the last query, until another comes: so one small query goes first."""
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even where ``body`` reads it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words; empty for null. Plain replacements and a one-character split are several times faster than one pattern."""
    flat = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def hash128(*cols: Column) -> Column:
    """Two independent 64-bit hashes: collisions do not matter at 10^12 rows."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b"))


def unit(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone, the same in every engine: 52 bits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def key_of(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
