"""Readers and sinks of the run tables and telemetry traces.

Sinks write to a partition or path of their own, so a lost executor only repeats its task; nothing is collected.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_SCHEMA = "scenario string, method string, seed bigint, wvr double, vr double, ll double, embb double, n bigint"


def read_traces(spark: SparkSession, path: str, **partition) -> DataFrame:
    """Traces of one (family, scenario, seed, ...); equality on partition columns prunes directories."""
    df = spark.read.parquet(path)
    for name, value in partition.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_traces(df: DataFrame, path: str, partition_by: Sequence[str], skip_present: bool = True) -> None:
    """Write each partition once. Present partitions are left out by an anti join on the directory columns."""
    spark = df.sparkSession
    if skip_present and exists(spark, path):
        have = spark.read.parquet(path).select(*partition_by).distinct()
        df = df.join(have, [*partition_by], "left_anti")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows with the same key (compared as text, NULL equal to NULL); columns may differ."""
    as_text = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(keys)]
    fresh = new.select(*as_text).distinct()
    tagged = old.select("*", *as_text)
    kept = tagged.join(fresh, [f"_k{i}" for i in range(len(keys))], "left_anti").drop(*[f"_k{i}" for i in range(len(keys))])
    return kept.unionByName(new, allowMissingColumns=True)


def write_upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], version: str) -> str:
    """Merged table under a new version directory; readers switch when the write has committed."""
    old = read_current(spark, path, new.schema)
    target = f"{path}/version={version}"
    upsert(old, new, keys).write.mode("errorifexists").parquet(target)
    return target


def read_current(spark: SparkSession, path: str, schema) -> DataFrame:
    """Newest committed version, or an empty table when there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return spark.createDataFrame([], schema)
    done = sorted(s.getPath().toString() for s in fs.listStatus(root)
                  if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a declared schema; an absent file reads as an empty table of that schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_documents(df: DataFrame, path: str, partition_by: Sequence[str], pretty: bool = False) -> None:
    """One JSON document per row, in directories named by the key parts; ``pretty`` indents them over several lines."""
    body = [c for c in df.columns if c not in partition_by]
    (df.select(*partition_by, F.to_json(F.struct(*body), {"pretty": str(pretty).lower()}).alias("value"))
     .write.mode("overwrite").partitionBy(*partition_by).text(path))


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Documents in directories named by key parts, which come back as columns: one JSON object per line, or with ``multi_line`` one per file."""
    if multi_line:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raw = spark.read.text(path)
    keys = [c for c in raw.columns if c != "value"]
    return raw.select(*keys, F.from_json("value", schema).alias("d")).select(*keys, "d.*")


def explode_cells(records: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel per-cell arrays -> one row per (run, cell) with its position."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return records.select(*keys, F.posexplode(zipped).alias("cell", "_z")).select(*keys, F.col("cell").cast("bigint").alias("cell"), "_z.*")
