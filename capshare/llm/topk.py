"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. Pass by pass, global histograms per query narrow the interval that holds its
k-th highest score until it is one integer; if more rows tie at that score than are wanted, further histograms over the
ids locate the last id that is taken. A last pass keeps what lies above both marks, so exactly k rows per query leave the tasks, however
many ties there are. Only histograms and marks travel: their size is queries x bins, never pairs.

* null vectors and vectors with null or non-finite components take no part; neither do rows with a null id.
* shorter vectors count as padded with zeros. Rows that repeat an id stay separate: each is a candidate, and each is a query that leaves out itself alone. They
  are told apart by a row number that grows with (id, vector), so ties go to the smaller id.
* fewer than k other rows: all are returned. Empty tables, or no query: empty result. Extra columns are ignored.
* scores are sums of products of 64-bit integers. They are computed in single or double precision only where the largest norms prove that
  to be exact, else in integers (which wrap beyond 64 bits).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capshare.operators.ranks import ranked

from .common import settle

BLOCK, Q_BLOCK, BINS = 8192, 1024, 1024


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(row, id, v array<bigint>) of the usable rows, v = floor(scale * x); ``row`` counts them in the order of (id, v)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = rows.select(F.struct("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.monotonically_increasing_id().alias("place")).alias("o"))
    return ranked(rows, [], "o").select(F.col("pos").alias("row"), "o.id", "o.v")


def blocks(rows: DataFrame, dim: int, size: int, kind) -> DataFrame:
    """Matrices of about ``size`` vectors: (block, ids, m). Ids are hashed to blocks, so blocks are even."""
    n = max(1, -(-rows.count() // size))
    cut = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(pdf), dim), kind)
        for i, v in enumerate(pdf["v"]):
            m[i, :len(v)] = v
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    return settle(cut.groupBy("block").applyInPandas(pack, "block long, ids binary, m binary"), "blocks")


def _width(span: int) -> int:
    """Smallest power of BINS of which BINS cover the span: intervals then divide evenly."""
    width = 1
    while width * BINS < span:
        width *= BINS
    return width


def _scores(r, shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim, kind, dtype = shape
    qi, ci = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
    q, c = (np.frombuffer(x, kind).reshape(-1, dim).astype(dtype) for x in (r.q_m, r.m))
    return qi, ci, q @ c.T


def _histograms(shape, field: str):
    """Counts per query and bin of the current interval: of scores, or of the ids of rows that tie at the k-th score."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                qi, ci, s = _scores(r, shape)
                lo, width, kth = (np.frombuffer(x, np.int64) for x in (r.lo, r.width, r.kth))
                live = np.flatnonzero(width > 0)
                out = []
                for start in range(0, len(live), 64):
                    rows = live[start:start + 64]
                    x = s[rows]
                    other = ci[None, :] != qi[rows, None]
                    if field == "score":
                        b = np.floor_divide(x - lo[rows, None], width[rows, None]).astype(np.int64)
                        ok = other & (b >= 0) & (b < BINS)
                    else:
                        b = (ci[None, :] - lo[rows, None]) // width[rows, None]
                        ok = other & (x == kth[rows, None]) & (b >= 0) & (b < BINS)
                    flat = np.bincount((np.arange(len(rows))[:, None] * BINS + b)[ok], minlength=len(rows) * BINS)
                    hit = np.flatnonzero(flat)
                    out.append((qi[rows][hit // BINS], hit % BINS, flat[hit]))
                if out:
                    yield pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "bin": np.concatenate([o[1] for o in out]), "n": np.concatenate([o[2] for o in out])})

    return run


def _taken(shape):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                qi, ci, s = _scores(r, shape)
                kth, last = np.frombuffer(r.kth, np.int64), np.frombuffer(r.last, np.int64)
                keep = (s > kth[:, None]) | ((s == kth[:, None]) & (ci[None, :] <= last[:, None]))
                keep &= ci[None, :] != qi[:, None]
                a, b = np.nonzero(keep)
                yield pd.DataFrame({"query_id": qi[a], "vec_id": ci[b], "score": s[a, b].astype(np.int64)})

    return run


def _packed_marks(marks: DataFrame) -> DataFrame:
    """Marks of the queries of a block as arrays in the order of its matrix."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        return pd.DataFrame({"q_block": [p["q_block"].iloc[0]]} | {c: [p[c].to_numpy(np.int64).tobytes()] for c in ("lo", "width", "kth", "last")})

    return marks.groupBy("q_block").applyInPandas(pack, "q_block long, lo binary, width binary, kth binary, last binary")


def search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """Both (row, id, v array<bigint>): query_id, rank, vec_id, score. A candidate with the row number of the query is the query itself."""
    found = _search(queries.select(F.col("row").alias("id"), "v"), candidates.select(F.col("row").alias("id"), "v"), k)
    names = [d.select(F.col("row").alias(row), F.col("id").alias(name)) for d, row, name in ((queries, "q", "query_id"), (candidates, "c", "vec_id"))]
    out = found.select(F.col("query_id").alias("q"), "rank", F.col("vec_id").alias("c"), "score")
    return out.join(names[0], "q").join(names[1], "c").select("query_id", "rank", "vec_id", "score")


def _search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The same for unique ids (id, v)."""
    spark = candidates.sparkSession
    candidates, queries = settle(candidates, "vectors"), settle(queries, "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    stat = lambda d: d.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).first()
    qs, cs = stat(queries), stat(candidates)
    schema = "query_id long, rank int, vec_id long, score long"
    if not qs.n or not cs.n:
        return spark.createDataFrame([], schema)
    dim = max(qs.dim, cs.dim, 1)
    top = qs.norm * cs.norm * (1 + 1e-9) + 1
    dtype = np.float32 if top < 2 ** 24 else np.float64 if top < 2 ** 53 else np.int64
    bound, most = int(min(top, 2 ** 61)), max(qs.norm, cs.norm)
    kind = np.int8 if most < 127 else np.int16 if most < 32767 else np.int64
    shape = (dim, kind, dtype)
    c_blocks = blocks(candidates, dim, BLOCK, kind)
    q_blocks = blocks(queries, dim, Q_BLOCK, kind).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    # every candidate block meets every block of queries once: their numbers run from 0
    each = lambda d, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d.agg(F.max(name)).first()[0]).cast("long")))
    pairs = c_blocks.withColumn("q_block", each(q_blocks, "q_block"))
    every_block = each(c_blocks, "block")

    def order(it):
        for pdf in it:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.q_ids, np.int64)
                yield pd.DataFrame({"query_id": ids, "q_block": r.q_block, "pos": np.arange(len(ids))})

    marks = q_blocks.select("q_block", "q_ids").mapInPandas(order, "query_id long, q_block long, pos long")
    first = _width(2 * bound + 1)
    # kth: the k-th score once it is known; ahead: rows above the interval; want: rows still to be found inside it
    marks = settle(marks.select("*", F.lit(-bound).cast("long").alias("lo"), F.lit(first).cast("long").alias("width"), F.lit(0).cast("long").alias("kth"),
                                F.lit(np.iinfo(np.int64).max).cast("long").alias("last"), F.lit(k).cast("long").alias("want")), "marks")

    def meet(marks):
        sides = q_blocks.join(_packed_marks(marks), "q_block").withColumn("block", every_block)
        return pairs.join(sides, ["block", "q_block"]).select("q_ids", "q_m", "ids", "m", "lo", "width", "kth", "last")

    def narrow(marks, field):
        live = marks.where("width > 0")
        hist = meet(marks).mapInPandas(_histograms(shape, field), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        way = F.col("bin").desc() if field == "score" else F.col("bin")
        w = Window.partitionBy("query_id").orderBy(way)
        run = hist.join(live.select("query_id", "want"), "query_id").withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("query_id")))
        # the bin that holds the wanted row, or the last one if there are fewer
        held = run.where((F.col("upto") >= F.least("want", "total")) & (F.col("upto") - F.col("n") < F.least("want", "total"))).select("query_id", "bin", "n", (F.least("want", "total") - F.col("upto") + F.col("n")).alias("need"))
        return settle(marks.join(held, "query_id", "left"), "marks")

    width = first
    while width:
        m = narrow(marks, "score")
        next_width = width // BINS
        lo = F.col("lo") + F.coalesce(F.col("bin"), F.lit(0)) * F.col("width")
        some = F.col("bin").isNotNull()
        # without any candidate the mark stays above everything
        marks = m.select("query_id", "q_block", "pos", lo.alias("lo"), F.when(some, F.lit(next_width)).otherwise(F.lit(0)).cast("long").alias("width"),
                         F.when(some, lo).when(F.col("width") == 0, F.col("kth")).otherwise(F.lit(bound + 1)).cast("long").alias("kth"),
                         "last", F.coalesce("need", "want").alias("want"), F.coalesce("n", F.lit(0)).alias("tied"))
        marks = settle(marks, "marks")
        width = next_width
    # rows that tie at the k-th score: all are wanted, or the smallest ids among them
    span = cs.hi - cs.lo + 1
    width = _width(span)
    marks = settle(marks.withColumn("lo", F.lit(cs.lo).cast("long")).withColumn("width", F.when(F.col("tied") > F.col("want"), F.lit(width)).otherwise(F.lit(0)).cast("long")), "marks")
    while width and marks.where("width > 0").limit(1).count():
        next_width = width // BINS
        m = narrow(marks, "id")
        lo = F.col("lo") + F.coalesce(F.col("bin"), F.lit(0)) * F.col("width")
        some = F.col("bin").isNotNull()
        marks = settle(m.select("query_id", "q_block", "pos", lo.alias("lo"), F.when(some, F.lit(next_width)).otherwise(F.lit(0)).cast("long").alias("width"), "kth",
                                F.when(some, lo + F.col("width") - 1).otherwise(F.col("last")).cast("long").alias("last"), F.coalesce("need", "want").alias("want"), "tied"), "marks")
        width = next_width
    found = meet(marks).mapInPandas(_taken(shape), "query_id long, vec_id long, score long")
    return found.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).alias("rank"), "vec_id", "score")
