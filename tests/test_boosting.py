"""Leaf-wise quantile boosting against a local fit with exact thresholds, and its stopping rule."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from capshare.operators import boosting as B


def table(spark, x, y):
    return spark.createDataFrame([(*map(float, a), float(t)) for a, t in zip(x, y, strict=True)], [*(f"f{i}" for i in range(x.shape[1])), "y"])


def local_fit(x, y, level, rounds, rate, leaves=15, min_leaf=40, l2=1.0):
    """Greedy best-first trees over all thresholds; returns a predictor."""
    base = np.quantile(y, level)
    pred, trees = np.full(len(y), base), []

    def best(rows, g):
        found = (0.0, None)
        for f in range(x.shape[1]):
            o = rows[np.argsort(x[rows, f], kind="stable")]
            gl, nl = np.cumsum(g[o])[:-1], np.arange(1, len(o))
            ok = (x[o[1:], f] > x[o[:-1], f]) & (nl >= min_leaf) & (len(o) - nl >= min_leaf)
            if ok.any():
                t = g[o].sum()
                gain = np.where(ok, gl ** 2 / (nl + l2) + (t - gl) ** 2 / (len(o) - nl + l2) - t ** 2 / (len(o) + l2), -np.inf)
                i = int(gain.argmax())
                if gain[i] > found[0]:
                    found = (gain[i], (f, x[o[i], f]))
        return found

    for _ in range(rounds):
        g = (y <= pred) - level
        parts = [(np.arange(len(y)), [])]
        gains = [best(parts[0][0], g)]
        while len(parts) < leaves and max(v for v, _ in gains) > 0:
            i = int(np.argmax([v for v, _ in gains]))
            (rows, path), (_, (f, t)) = parts.pop(i), gains.pop(i)
            for side in (True, False):
                sub = rows[(x[rows, f] <= t) == side]
                parts.append((sub, [*path, (f, t, side)]))
                gains.append(best(sub, g))
        tree = [(path, rate * np.quantile(y[rows] - pred[rows], level, method="inverted_cdf")) for rows, path in parts]
        trees.append(tree)
        for (rows, _), (_, v) in zip(parts, tree, strict=True):
            pred[rows] += v

    def predict(z):
        out = np.full(len(z), base)
        for tree in trees:
            for path, v in tree:
                hit = np.ones(len(z), bool)
                for f, t, side in path:
                    hit &= (z[:, f] <= t) == side
                out[hit] += v
        return out

    return predict


def pinball(y, q, level):
    return np.maximum(level * (y - q), (level - 1) * (y - q)).mean()


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.random((6000, 4))
    y = np.sin(6 * x[:, 0]) + 2 * x[:, 1] * (x[:, 2] > .5) + (0.2 + x[:, 3]) * rng.standard_normal(6000)
    return x, y


def test_pinball_as_a_local_fit(spark, data):
    x, y = data
    levels = (0.25, 0.9)
    models = B.fit(table(spark, x[:4000], y[:4000]).repartition(3), [f"f{i}" for i in range(4)], levels=levels, rounds=25, rate=0.2, holdout=F.lit(False))
    got = B.score_arrow(table(spark, x[4000:], y[4000:]).withColumn("y", F.col("y") + 0), models, [f"f{i}" for i in range(4)]).select("y", *[f"f{i}" for i in range(4)], "q").toPandas()
    z, q = got[[f"f{i}" for i in range(4)]].to_numpy(), np.array([sum_of(models[k], got[[f"f{i}" for i in range(4)]].to_numpy()) for k in range(2)])
    for k, a in enumerate(levels):
        ours, ref = pinball(got.y.to_numpy(), q[k], a), pinball(got.y.to_numpy(), local_fit(x[:4000], y[:4000], a, 25, 0.2)(z), a)
        assert ours < 1.05 * ref and len(models[k]["trees"]) == 25
    assert max(sum("value" in n for n in t) for m in models for t in m["trees"]) == 15


def sum_of(model, x):
    return model["base"] + sum(B._values(t, x) for t in model["trees"])


def test_leaves_are_large_enough_and_of_the_right_quantile(spark, data):
    x, y = data
    m, = B.fit(table(spark, x, y).repartition(5), [f"f{i}" for i in range(4)], levels=(0.75,), rounds=1, rate=1.0, min_leaf=150, holdout=F.lit(False))
    leaf = B._leaf_of(m["trees"][0], x)
    for i in np.unique(leaf):
        resid = np.sort(y[leaf == i] - m["base"])
        assert len(resid) >= 150 and m["trees"][0][i]["value"] == pytest.approx(resid[int(np.ceil(0.75 * len(resid))) - 1])


def test_stops_when_held_out_rows_gain_nothing(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((2000, 2)), rng.standard_normal(2000)         # nothing to learn
    m, = B.fit(table(spark, x, y), ["f0", "f1"], levels=(0.5,), rounds=60, rate=0.3, patience=4)
    assert len(m["losses"]) < 40 and len(m["trees"]) == int(np.argmin(m["losses"]))


def test_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None if i % 3 else 1.0, None if i % 7 == 0 else float(i % 3), None) for i in range(600)], "f0 double, y double, f1 double")
    m, = B.fit(df, ["f0", "f1"], levels=(0.5,), rounds=3, rate=1.0, holdout=F.lit(False))
    got = {r.f0: r.q[0] for r in B.score_columns(df, [m], ["f0", "f1"]).collect()}
    assert got[1.0] == pytest.approx(0.0) and got[None] in (1.0, 2.0)
    assert B.fit(df.where("false"), ["f0", "f1"]) == [] and B.fit(df.withColumn("y", F.lit(None).cast("double")), ["f0"]) == []


def test_summaries_keep_ranks():
    v = np.random.default_rng(3).random(50_000)
    a, w = B._summary(v, np.ones(len(v)), 500)
    assert len(a) == 500 and w.sum() == pytest.approx(len(v)) and abs(np.searchsorted(np.sort(v), a) / len(v) - (np.arange(500) + .5) / 500).max() < 1 / 500
