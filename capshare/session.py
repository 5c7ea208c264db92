"""Session builder used by tests and the benchmark; a cluster brings its own session."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "capshare", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
             # methods above 8000 bytes are never compiled by the JIT: let such stages run operator by operator instead
             .config("spark.sql.codegen.hugeMethodLimit", "8000")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a fresh local one only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path
