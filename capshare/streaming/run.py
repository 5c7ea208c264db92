"""Run a streaming query over what its source holds, into files; nothing passes through the driver.

A table is replayed as numbered batches: each batch is a folder that becomes visible to the stream only when all earlier ones have been processed
and committed, so the order of a replay depends neither on file times nor on how many tasks wrote or read a batch.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf: str, name: str, columns: list[str]) -> DataFrame:
    """One table of a directory as a file stream, only the needed columns."""
    full = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(full).option("pathGlobFilter", f"{name}.parquet").parquet(sf).select(*columns)


class Replay:
    """A batch table cut into about ``batches`` equal ranges of ``order`` (or behind each of ``cuts``), to be streamed back one by one. Rows of equal order stay together."""

    def __init__(self, df: DataFrame, name: str, order: str, batches: int = 1, cuts: list | None = None):
        self.spark, self.schema, self.path = df.sparkSession, df.schema, workspace(df.sparkSession, name)
        if cuts is None and batches > 1:
            cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / batches) for i in range(1, batches)]), 10000)).first()[0]
        number = sum((F.when(F.col(order) > c, F.lit(1)).otherwise(F.lit(0)) for c in sorted(set(cuts or []))), F.lit(0))
        df.withColumn("_batch", number).write.partitionBy("_batch").parquet(f"{self.path}/staged")
        self._fs("mkdirs", f"{self.path}/in")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/staged")
        found = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        self.names = sorted((n for n in found if n.startswith("_batch=")), key=lambda n: int(n.partition("=")[2]))

    def _fs(self, call: str, *paths: str) -> None:
        at = [self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        if not getattr(at[0].getFileSystem(self.spark._jsc.hadoopConfiguration()), call)(*at):
            raise OSError(f"{call} failed: {paths}")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/in")

    def __iter__(self):
        """Makes one batch after the other visible; a replay runs once."""
        for n in self.names:
            self._fs("rename", f"{self.path}/staged/{n}", f"{self.path}/in/{n}")
            yield n


def _drain(writer, feed) -> None:
    """Process what is there and end; with ``feed``, again after each of its batches, from the same checkpoint."""
    for _ in feed if feed is not None else [None]:
        writer.trigger(availableNow=True).start().awaitTermination()


def run_append(df: DataFrame, name: str, stateful: bool = False, feed: Replay | None = None) -> DataFrame:
    """Drain the source into a file sink (exactly once) and read it back. ``stateful``: state in RocksDB, set for this query alone."""
    spark = df.sparkSession
    path = workspace(spark, name)
    before = spark.conf.get(PROVIDER, None)
    try:
        if stateful:
            spark.conf.set(PROVIDER, ROCKSDB)       # a query takes a copy of the session's settings when it starts
        _drain(df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint"), feed)
    finally:
        if stateful:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def run_update(df: DataFrame, name: str, keys: list[str], feed: Replay | None = None) -> DataFrame:
    """Update mode: each batch's changed rows are written under its number; the newest row of a key counts."""
    spark = df.sparkSession
    path = workspace(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    _drain(df.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{path}/checkpoint"), feed)
    rows = spark.read.parquet(f"{path}/out")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
