"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Ids hash to one of ``cells`` places on a ring on which every shard owns ``vnodes`` tokens. A row belongs to the next token
clockwise; rows that find its shard full continue clockwise to the next shard with room. Capacities add up to the number of rows (n // shards, one more in
the first n % shards), so counts are at most one apart: law ``rows``. The overflow is decided on counts per cell, of
which there are ``cells`` whatever the data; the rows only look up the interval of ranks that holds them.

* null id: hashes like any other value; null text: size 16, crc32 of nothing (0).
* repeated rows and equal ids are rows of their own; ranks inside a cell go by row, cut into chunks so that an id that holds a third
  of all rows is ranked by many tasks. Extra columns are ignored; an empty table gives an empty table.
"""
from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle


def ring(spark: SparkSession, shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of all tokens: shards x vnodes rows."""
    tokens = spark.range(shards * vnodes).select((F.col("id") % shards).alias("shard"), F.expr("id div %d" % shards).alias("v"))
    return sorted((r.cell, r.shard) for r in tokens.select(F.pmod(F.xxhash64(F.lit("ring"), "shard", "v"), F.lit(cells)).alias("cell"), "shard").collect())


def intervals(counts: dict[int, int], tokens: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, lo, hi, shard, first slot): which ranks of a cell go where. All rows go home first; then what is left continues clockwise."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used, out, left = [0] * shards, [], []
    places = [c for c, _ in tokens]

    def give(cell, lo, shard, want):
        take = min(want, room[shard])
        if take:
            out.append((cell, lo, lo + take, shard, used[shard]))
            used[shard] += take
            room[shard] -= take
        return take

    for cell in sorted(counts):
        at = bisect_left(places, cell) % len(tokens)
        got = give(cell, 0, tokens[at][1], counts[cell])
        if got < counts[cell]:
            left.append((cell, got, at))
    for cell, lo, at in left:
        while lo < counts[cell]:
            at = (at + 1) % len(tokens)
            lo += give(cell, lo, tokens[at][1], counts[cell] - lo)
    return out


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64, cells: int = 16384, id_col: str = "doc_id", text_col: str = "text", chunk: int = 50_000) -> DataFrame:
    """Per row: uid, id, size, text_crc32, shard, slot."""
    spark, text = docs.sparkSession, F.col(text_col)
    base = settle(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                              F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.pmod(F.xxhash64(F.lit("row"), F.col(id_col)), F.lit(cells)).alias("cell")), "shard")
    counts = {r["cell"]: r["n"] for r in base.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = intervals(counts, ring(spark, shards, vnodes, cells), shards) if counts else []
    chunks = max(1, -(-max(counts.values(), default=0) // chunk))
    base = base.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "uid"), F.lit(chunks)))
    ahead = base.groupBy("cell", "chunk").agg(F.count("*").alias("n"))
    ahead = ahead.select("cell", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranked = base.withColumn("nth", F.row_number().over(Window.partitionBy("cell", "chunk").orderBy("uid")) - 1).join(ahead, ["cell", "chunk"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    # at most cells + shards x vnodes rows
    where = F.broadcast(spark.createDataFrame(plan, "at bigint, lo bigint, hi bigint, shard int, first bigint"))
    placed = ranked.join(where, (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("uid", "id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """The documents as Parquet, one folder a shard, in slot order inside a file."""
    held = settle(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), "docs")
    rows = held.select("row.*")
    placed = shard(rows, **kw).select("uid", "shard", "slot")
    whole = held.select(F.monotonically_increasing_id().alias("uid"), "row").join(placed, "uid")
    whole.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").select("row.*", "shard").write.partitionBy("shard").parquet(path)
