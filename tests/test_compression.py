"""Errors of quantised factors, the bound of sparsification and the array form of block floating point."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from capshare.operators import compression as C


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 40)) + 0.05 * rng.normal(size=(500, 40))
    m[7] = 0.0
    m[8, 16:32] = 0.0
    return m, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, vec array<double>").repartition(5)


def test_array_form_is_the_column_form(table):
    m, df = table
    for width in (4, 9):
        got = df.select("id", C.block_float("vec", F.lit(width)).alias("q")).toPandas().sort_values("id")
        assert np.array_equal(np.stack(got.q.to_numpy()), C.block_float_array(m, width))
    assert C.block_float_array(m, 0) is m


def test_factor_errors_are_those_of_the_sent_factors(table):
    m, df = table
    _, basis = C.singular_values(df)
    bases = {k: basis[:, :k] for k in (2, 6, 20)}
    got = {(r["rank"], r.width): r for r in C.factor_errors(df, bases, [0, 5, 10]).collect()}
    assert len(got) == 9
    for (k, w), r in got.items():
        sent = C.block_float_array(m @ bases[k], w) @ C.block_float_array(bases[k], w).T
        assert r.err == pytest.approx(((m - sent) ** 2).sum()) and r.total == pytest.approx((m ** 2).sum())
    assert got[6, 0].err < got[6, 10].err < got[6, 5].err and got[20, 10].err < got[6, 10].err < got[2, 10].err
    # without rounding the error is the energy of the other singular values
    assert got[6, 0].err == pytest.approx((np.linalg.svd(m, compute_uv=False)[6:] ** 2).sum(), rel=1e-6)


def test_sparsification_keeps_its_bound(table):
    m, df = table
    d = df.crossJoin(df.sparkSession.createDataFrame([(k, w) for k in (1, 10, 40) for w in (3, 8)], "k int, w int"))
    d = d.withColumn("s", C.keep_largest("vec", F.col("k"))).withColumn("q", C.block_float("s", "w"))
    rows = d.select("id", "k", "w", C.error_energy("vec", "q").alias("err"), C.sparse_bound("vec", "s", "w").alias("bound"), F.size(F.filter("s", lambda x: x != 0)).alias("kept")).collect()
    assert len(rows) == 3000 and all(r.err <= r.bound + 1e-12 for r in rows) and all(r.kept <= r.k for r in rows)
    assert max(r.err / r.bound for r in rows if r.bound > 0) > 0.5      # and the bound is not idle


def test_budgets():
    assert C.affordable(1000, 64, 2 * 4 * 1064 * 3 + 1) == {4: 3, 6: 2, 8: 1, 12: 1} and C.affordable(1000, 64, 10) == {} and C.affordable(10, 64, 1e9)[4] == 64
