"""Rate and distortion of vector tables under block floating point, low rank, sketch and sparsification.

A vector is one row; its length is a property of the table (a few dozen to a few thousand), so work on one vector
stays inside a row and work across vectors is an aggregate over positions.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import DCT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import bind, col


def energy(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x * x)


def error_energy(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nmse_db(err, total) -> Column:
    return F.lit(10.0) * F.log10(col(err) / col(total))


# --- block floating point -----------------------------------------------------------------------------------
def block_float(vec, width, block: int = 16) -> Column:
    """Blocks share the exponent of their largest magnitude; mantissas have ``width`` bits with sign."""
    levels = F.pow(F.lit(2.0), col(width) - F.lit(1.0)) - F.lit(1.0)

    def quantise(part):
        def scaled(scale):
            return F.transform(part, lambda x: F.rint(x / scale * levels) / levels * scale)
        peak = F.array_max(F.transform(part, F.abs))
        return F.when(peak > 0, bind(F.pow(F.lit(2.0), F.ceil(F.log2(peak))), scaled)).otherwise(part)

    def whole(v):
        blocks = F.ceil(F.size(v) / F.lit(float(block))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return F.flatten(F.transform(parts, quantise))

    return bind(vec, whole)


def block_ratio(width, block: int = 16, sample_bits: int = 16, exponent_bits: int = 8) -> Column:
    """Compression ratio against ``sample_bits`` per value."""
    return F.lit(float(sample_bits * block)) / (col(width) * F.lit(float(block)) + F.lit(float(exponent_bits)))


def shared_scale(df: DataFrame, width: int, vec: str = "vec", out: str = "quantised") -> DataFrame:
    """One scale per position over the whole table, then the total power of the table restored.

    Position peaks and the two powers are aggregates; both results are one row and are broadcast.
    """
    levels = float(2 ** (width - 1) - 1)
    peaks = (df.select(F.posexplode(vec).alias("p", "x")).groupBy("p").agg(F.max(F.abs("x")).alias("m"))
             .agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("s")).select(F.col("s.m").alias("_peak")))
    q = df.crossJoin(F.broadcast(peaks)).withColumn(out, F.zip_with(
        vec, "_peak", lambda x, m: F.rint(x / F.greatest(m, F.lit(1e-30)) * levels) / levels * F.greatest(m, F.lit(1e-30)))).drop("_peak")
    power = q.agg(F.sqrt(F.sum(energy(vec)) / F.sum(energy(out))).alias("_gain"))
    return q.crossJoin(F.broadcast(power)).withColumn(out, F.transform(out, lambda x: x * F.col("_gain"))).drop("_gain")


# --- low rank ---------------------------------------------------------------------------------------------------
def gram(df: DataFrame, vec: str = "vec") -> np.ndarray:
    """n x n Gram matrix of a tall table. Every task sums its own rows first, so n x n numbers per task are shuffled and the
    driver holds n^2 numbers only (n is the vector length)."""

    def partial(batches):
        total = None
        for b in batches:
            m = np.stack(b[vec].to_numpy())
            g = m.T @ m
            total = g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    rows = df.select(vec).mapInPandas(partial, "i bigint, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    n = max((r.i for r in cells), default=-1) + 1
    out = np.zeros((n, n))
    for r in cells:
        out[r.i, r.j] = r.g
    return out


def gram_table(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Gram matrix as a table (i, j, g): products of positions inside a row, summed over rows before the shuffle."""
    pairs = F.flatten(F.transform(F.col(vec), lambda x, i: F.transform(
        F.slice(F.col(vec), i + 1, F.size(vec)), lambda y, k: F.struct(i.alias("i"), (i + k).alias("j"), (x * y).alias("g")))))
    return df.select(F.explode(pairs).alias("t")).groupBy("t.i", "t.j").agg(F.sum("t.g").alias("g"))


def singular_values(df: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """All singular values (descending) and right vectors, from the small Gram matrix."""
    vals, vecs = np.linalg.eigh(gram(df, vec))
    order = np.argsort(vals)[::-1]
    return np.sqrt(np.maximum(vals[order], 0.0)), vecs[:, order]


def effective_rank(sigma: np.ndarray, share: float = 0.99) -> int:
    """Fewest singular values that hold ``share`` of the energy."""
    cum = np.cumsum(sigma ** 2) / max(float(np.sum(sigma ** 2)), 1e-300)
    return int(np.searchsorted(cum, share) + 1)


def apply_basis(df: DataFrame, basis: np.ndarray, vec: str = "vec", out: str = "approx", coef: str = "coef") -> DataFrame:
    """``coef = row . basis`` and ``approx = coef . basis^T`` in one Arrow pass; the basis is n x r."""
    @F.pandas_udf("struct<coef:array<double>,approx:array<double>>")
    def kernel(v: pd.Series) -> pd.DataFrame:
        m = np.stack(v.to_numpy())
        c = m @ basis
        return pd.DataFrame({"coef": list(c), "approx": list(c @ basis.T)})

    return df.withColumn("_k", kernel(vec)).select(*df.columns, F.col("_k.coef").alias(coef), F.col("_k.approx").alias(out))


def block_float_array(m: np.ndarray, width: int, block: int = 16) -> np.ndarray:
    """``block_float`` of every row of a matrix; width 0 leaves it as it is."""
    if not width or not m.size:
        return m
    starts = np.arange(0, m.shape[1], block)
    peak = np.repeat(np.maximum.reduceat(np.abs(m), starts, axis=1), np.diff(np.append(starts, m.shape[1])), axis=1)
    scale = np.exp2(np.ceil(np.log2(np.where(peak > 0, peak, 1.0))))
    levels = 2.0 ** (width - 1) - 1.0
    return np.rint(m / scale * levels) / levels * scale


def factor_errors(df: DataFrame, bases: dict[int, np.ndarray], widths: Sequence[int], vec: str = "vec") -> DataFrame:
    """(rank, width, err, total): squared error of the table behind both factors as they are sent, for every rank (its n x rank basis) and width, in one pass.

    Coefficients and rows of the basis go through block floating point before they are multiplied; width 0 leaves them exact. Every task adds up its rows, so
    one row per task, rank and width is shuffled. ``total`` is the energy of the table.
    """
    sent = {(rank, width): block_float_array(basis, width) for rank, basis in bases.items() for width in widths}

    def partial(batches):
        err, total = dict.fromkeys(sent, 0.0), 0.0
        for b in batches:
            if not len(b):
                continue
            m = np.stack(b[vec].to_numpy())
            total += float((m * m).sum())
            for rank, basis in bases.items():
                coef = m @ basis
                for width in widths:
                    err[rank, width] += float(((m - block_float_array(coef, width) @ sent[rank, width].T) ** 2).sum())
        yield pd.DataFrame([(r, w, e, total) for (r, w), e in err.items()], columns=["rank", "width", "err", "total"])

    return df.select(vec).mapInPandas(partial, "rank int, width int, err double, total double").groupBy("rank", "width").agg(F.sum("err").alias("err"), F.sum("total").alias("total"))


def sketch_basis(df: DataFrame, rank: int, vec: str = "vec", row_id: str = "id") -> np.ndarray:
    """Orthonormal n x r basis from a sign sketch: r signed sums of rows (one aggregate), then a QR of n x r on the driver."""
    signs = [F.when(F.pmod(F.xxhash64(F.col(row_id), F.lit(k)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) for k in range(rank)]
    long = df.select(*[s.alias(f"_s{k}") for k, s in enumerate(signs)], F.posexplode(vec).alias("p", "x"))
    z = long.groupBy("p").agg(*[F.sum(F.col("x") * F.col(f"_s{k}")).alias(f"z{k}") for k in range(rank)]).orderBy("p").collect()
    q, _ = np.linalg.qr(np.array([[row[f"z{k}"] for k in range(rank)] for row in z]))
    return q


def low_rank_ratio(rows: int, n: int, rank, width: int, sample_bits: int = 16):
    return rows * n * sample_bits / (rank * width * (rows + n))


def affordable(rows: int, n: int, budget_bits: float, widths: Sequence[int] = (4, 6, 8, 12, 16)) -> dict[int, int]:
    """width -> largest rank whose two factors fit the budget, where it is at least one."""
    return {b: r for b in widths if (r := min(int(budget_bits // (2 * b * (rows + n))), n)) >= 1}


# --- transform and sparsify --------------------------------------------------------------------------------------
def dct(df: DataFrame, vec: str, out: str, inverse: bool = False) -> DataFrame:
    t = DCT(inverse=inverse, inputCol="_v", outputCol="_t")
    return (t.transform(df.withColumn("_v", array_to_vector(vec))).withColumn(out, vector_to_array("_t")).drop("_v", "_t"))


def keep_largest(vec, k: int | Column) -> Column:
    """Keep the k largest magnitudes of a row (first positions on ties), zero the rest."""
    def whole(v):
        ranked = F.sort_array(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
        # the k-th entry in (magnitude, position) order is the cut
        return bind(F.get(ranked, (k if isinstance(k, Column) else F.lit(k)) - 1), lambda cut: F.transform(v, lambda x, i: F.when(
            F.struct((-F.abs(x)).alias("m"), i.alias("i")) <= cut, x).otherwise(F.lit(0.0))))
    return bind(vec, whole)


def sparse_bound(vec, kept, width, block: int = 16) -> Column:
    """Largest squared error that a sparsified row can have once its kept values are quantised: the energy left out, and half a step for every kept value."""
    levels = F.pow(F.lit(2.0), col(width) - F.lit(1.0)) - F.lit(1.0)

    def steps(v):
        def of(part):
            peak = F.array_max(F.transform(part, F.abs))
            half = F.pow(F.lit(2.0), F.ceil(F.log2(peak))) / levels / 2
            return F.when(peak > 0, F.size(F.filter(part, lambda x: x != 0)) * half * half).otherwise(F.lit(0.0))
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(float(block))).cast("int") - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return F.aggregate(F.transform(parts, of), F.lit(0.0), lambda a, x: a + x)

    return error_energy(vec, kept) + bind(kept, steps)


def keep_top_positions(df: DataFrame, k: int, vec: str = "vec", out: str = "kept") -> DataFrame:
    """Keep the k positions with the most energy over the table; the pick is one small row and is broadcast."""
    e = df.select(F.posexplode(vec).alias("p", "x")).groupBy("p").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    top = e.orderBy(F.desc("e"), "p").limit(k).agg(F.collect_list("p").alias("_top"))
    return (df.crossJoin(F.broadcast(top))
            .withColumn(out, F.transform(vec, lambda x, i: F.when(F.array_contains("_top", i), x).otherwise(F.lit(0.0)))).drop("_top"))


def sparse_ratio(n: int, k, width: int, sample_bits: int = 16):
    """Each kept value costs its mantissa and its position."""
    return n * sample_bits / (k * (width + math.ceil(math.log2(n))))
