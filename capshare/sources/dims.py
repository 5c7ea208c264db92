"""Dimensions made of fixed values; all are small by construction and safe to broadcast."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import scalars as S


def cell_classes(spark: SparkSession) -> DataFrame:
    rows = [(c, n, d, p, K.DATA_RES * se, l) for c, n, d, p, se, l in K.CELL_CLASSES]
    return spark.createDataFrame(rows, "class bigint, name string, deadline int, priority double, se double, layers int")


def links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(K.LINK_GBPS, K.CONTROL_RESERVE, K.PRBS_PER_CELL, K.REFERENCE_WIDTH, K.OVERHEAD)],
        "gbps double, reserve double, prbs int, width int, overhead double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SCENARIOS, "scenario string, family string, load double")


def grid(spark: SparkSession, name: str, values, dtype: str = "double") -> DataFrame:
    """A one-column parameter grid (JN-9): a literal list, so its size is that of the list."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def with_cells(facts: DataFrame, classes: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Join facts with the class of their cell; the dimension holds eight rows."""
    return facts.withColumn("class", F.col(cell) % F.lit(len(K.CELL_CLASSES))).join(F.broadcast(classes), "class")


def seed_split(seed) -> "F.Column":
    out = None
    for name, (lo, hi) in K.SEED_SPLITS.items():
        cond = S.col(seed).between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out
