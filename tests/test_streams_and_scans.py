"""Replay order, late and missing rows in keyed state, the calibration scan over long keys, bootstrap blocks and row positions."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from capshare.operators import calibration as CAL, paired as PA, ranks, series
from capshare.streaming import run, stateful, telemetry as TE

T0 = dt.datetime(2024, 1, 1)


def test_twenty_replays_give_the_same_complete_rows(spark):
    light = spark.newSession()
    light.conf.set("spark.sql.shuffle.partitions", "1")
    light.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [(i % 3, i // 3, T0 + dt.timedelta(hours=i // 3), 1.0, 2 + i % 5, i % 2, 1) for i in range(240)]
    df = light.createDataFrame(rows, "link_id long, slot long, ts timestamp, priority double, arrived long, violated long, served long").repartition(2).persist()
    want = {(i, w): sum(r[0] == i and r[1] // 8 == w for r in rows) for i in range(3) for w in range(10)}
    seen = set()
    for _ in range(20):
        feed = run.Replay(df, "same", "slot", 2)
        k = TE.running_kpis(feed.stream(), "ts", "8 hours", "1 hour").select("link_id", F.hour("window.start").alias("h"), F.dayofmonth("window.start").alias("d"), "used", "rows", "weighted_violation_ratio")
        got = run.run_update(k, "same", ["link_id", "d", "h"], feed).collect()
        assert {(r.link_id, (r.d - 1) * 3 + r.h // 8): r.rows for r in got} == want
        seen.add(str(sorted(map(tuple, got))))
    assert len(seen) == 1


def staged(spark, batches, schema):
    """A feed whose batches are given."""
    rows = spark.createDataFrame([(*r, i) for i, b in enumerate(batches) for r in b], schema + ", part int")
    feed = run.Replay(rows, "given", "part", cuts=list(range(len(batches) - 1)))
    assert len(feed.names) == len(batches)
    return feed


def test_fifo_goes_on_behind_a_gap_and_counts_late_rows(spark):
    row = lambda s, a=10.0, w=4.0: (1, s, 2, a, w)
    feed = staged(spark, [[row(1), row(0), row(3), row(4)], [row(5), row(6)], [row(2), row(7)]], "cell_id long, slot long, deadline int, arrived double, allowed double")
    got = run.run_append(stateful.fifo(feed.stream(), patience=3), "gap", stateful=True, feed=feed).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(8)) and got[-1].late == 1 and got[6].late == 0
    ages, left = np.zeros(3), []
    for s in range(8):
        a, w = (0.0, 0.0) if s == 2 else (10.0, 4.0)
        ages[0] += a
        for i in (2, 1, 0):
            take = min(w, ages[i])
            ages[i] -= take
            w -= take
        left.append(ages.copy())
        ages = np.array([0.0, ages[0], ages[1]])
    assert [r.queue for r in got] == pytest.approx([x[:2].sum() for x in left]) and [r.violated for r in got] == pytest.approx([x[2] for x in left])
    assert stateful.delay_histogram(spark.createDataFrame(got)).agg(F.sum("bits")).first()[0] == pytest.approx(sum(r.served for r in got))


def test_offsets_leave_when_epochs_open_and_late_outcomes_are_counted(spark):
    lag, miss = 2, [1, 0, 1, 1, 0, 1, 0, 0, 1, 1]
    opens = lambda k: (7, "open", k, None, T0 + dt.timedelta(hours=k))
    outcome = lambda k: (7, "outcome", k, miss[k], T0 + dt.timedelta(hours=k + lag, minutes=-1))
    schema = "cell_id long, kind string, k long, miss int, ts timestamp"
    # epoch 9 opens long before its own outcome; that of epoch 3 comes after its step was due
    feed = staged(spark, [[opens(k) for k in range(4)] + [outcome(0), outcome(1)], [outcome(2)] + [opens(k) for k in range(4, 7)] + [outcome(4)], [outcome(3), outcome(5), outcome(6), outcome(7)] + [opens(k) for k in range(7, 10)]], schema)
    got = run.run_append(stateful.calibrate(feed.stream(), lag, gamma=0.1, lo=-0.05, hi=0.2), "open", stateful=True, feed=feed).orderBy("k").collect()
    d, want = 0.0, []
    for k in range(10):
        if k - lag >= 0 and k - lag != 3:
            d = min(max(d + 0.1 * (miss[k - lag] - (1 - 0.9)), -0.05), 0.2)
        want.append(d)
    assert [r.k for r in got] == list(range(10)) and [r.delta for r in got] == pytest.approx(want)
    assert got[-1].late == 1 and got[6].late == 0


@pytest.mark.parametrize("chunk, levels", [(8, 1), (64, 2), (5, 0)])
def test_calibration_scan_is_the_plain_fold(spark, chunk, levels):
    rng = np.random.default_rng(2)
    miss = {c: rng.integers(0, 2, n) for c, n in ((1, 3000), (2, 17))}
    df = spark.createDataFrame([(c, k, None if k % 13 == 5 else int(m)) for c, v in miss.items() for k, m in enumerate(v)], "cell long, k long, miss int")
    got = {(r.cell, r.k): r.delta for r in CAL.offsets(df, ["cell"], "k", "miss", 3, lo=-0.05, hi=0.1, chunk=chunk, levels=levels).collect()}
    for c, v in miss.items():
        d = 0.0
        for k in range(len(v)):
            if k >= 3 and (k - 3) % 13 != 5:
                d = min(max(d + 0.02 * (v[k - 3] - (1 - 0.9)), -0.05), 0.1)
            assert got[c, k] == pytest.approx(d, abs=1e-9)
    assert len(got) == 3017


def test_positions_of_a_key_over_many_ranges(spark):
    df = spark.range(0, 20_000).select((F.col("id") % 10 == 0).cast("int").alias("key"), ((F.col("id") * 7919) % 20_011).alias("o"))
    got = ranks.ranked(df, ["key"], "o").toPandas()
    for _, g in got.groupby("key"):
        g = g.sort_values("o")
        assert (g.pos.to_numpy() == np.arange(len(g))).all() and (g.n == len(g)).all()


def test_bootstrap_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.exponential(2.0, 6000)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 5.0)], "key string, o long, v double")
    counts = {(r.n, r.block): np.array(r.m) for r in PA.block_counts(spark.createDataFrame([(6000,), (7,)], "n long"), 50, 256).collect()}
    assert len(counts) == 24 + 1 and (counts[7, 0] == 7).all() and (sum(m for (n, _), m in counts.items() if n == 6000) == 6000).all()
    spread = np.array([m for (n, b), m in counts.items() if n == 6000 and b < 23])
    assert spread.mean() == pytest.approx(256, rel=0.02) and spread.std() == pytest.approx(16, rel=0.15)
    got = {r.key: r for r in PA.bootstrap(df, ["key"], "o", ["v"], lambda m: m, 400, block=256).collect()}
    half = 1.96 * v.std() / np.sqrt(len(v))
    assert got["a"].ci_lo == pytest.approx(v.mean() - half, abs=0.35 * half) and got["a"].ci_hi == pytest.approx(v.mean() + half, abs=0.35 * half)
    assert got["b"].ci_lo is None


def test_percentiles_of_large_and_odd_groups(spark):
    rng = np.random.default_rng(6)
    groups = {"big": rng.integers(0, 4000, 20_000) / 8, "one": np.array([3.0]), "ties": np.repeat([1.0, 2.0], 50), None: rng.random(11)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("big", None), ("empty", None)], "k string, v double")
    probs = (0.0, 0.05, 0.5, 0.77, 1.0)
    got = {r.k: r.q for r in ranks.percentiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups) and all(got[k] == pytest.approx(list(np.quantile(v, probs))) for k, v in groups.items())


@pytest.mark.parametrize("chunk, levels", [(256, 2), (7, 1), (50, 0)])
def test_sojourns_of_a_hot_key(spark, chunk, levels):
    rng = np.random.default_rng(8)
    n = 2_000_000 if chunk == 256 else 20_000
    state = np.concatenate([rng.integers(0, 2, n - 5000), np.ones(5000, int)])
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"key": 1, "slot": np.arange(n), "s": state})).union(spark.createDataFrame([(2, 5, 1), (2, 6, 1), (2, 9, 1), (2, 10, 0), (2, 300, None), (2, 301, None)], "key long, slot long, s long")).repartition(8)
    got = series.sojourns(df, ["key"], "slot", "s", chunk, levels)
    hot = got.where("key = 1").orderBy("start").toPandas()
    start = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
    assert (hot.start.to_numpy() == start).all() and (hot.length.to_numpy() == np.diff(np.append(start, n))).all() and (hot.s.to_numpy() == state[start]).all()
    assert len(start) > (900_000 if chunk == 256 else 5000)
    assert sorted((r.start, r.length, r.s) for r in got.where("key = 2").collect()) == [(5, 2, 1), (9, 1, 1), (10, 1, 0), (300, 2, None)]


def test_delayed_sums_of_a_hot_key(spark):
    rng = np.random.default_rng(9)
    at = lambda ms: T0 + dt.timedelta(milliseconds=int(ms))
    tele = [(1 if i % 3 else 2, "telemetry", i, int(rng.integers(0, 50)), at(rng.integers(0, 3_600_000))) for i in range(6000)]
    dec = [(1 + i % 3, "decision", 10_000 + i, None, at(rng.integers(0, 3_600_000))) for i in range(300)] + [(1, "decision", 20_000, None, tele[1][4] + dt.timedelta(seconds=60))]
    cut = T0 + dt.timedelta(minutes=30)
    parts = [[r for r in tele + dec if r[4] <= cut], [r for r in tele + dec if r[4] > cut], [(9, "telemetry", 0, 1, T0 + dt.timedelta(hours=2))]]
    feed = staged(spark, parts, "cell_id long, kind string, id long, bits long, ts timestamp")
    got = {r.id: (r.seen, r.total) for r in run.run_append(stateful.delayed_sums(feed.stream(), 60, 600, "0 seconds"), "seen", stateful=True, feed=feed).collect()}
    assert len(got) == 301
    for c, _, i, _, t in dec:
        seen = [b for k, _, _, b, u in tele if k == c and t - dt.timedelta(seconds=600) < u <= t - dt.timedelta(seconds=60)]
        assert got[i] == (len(seen), sum(seen))
