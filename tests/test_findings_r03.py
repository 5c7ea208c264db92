"""Findings of round 3."""
from __future__ import annotations

import os
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W, functions as F
from pyspark.util import PythonEvalType

from capshare.functions import demand
from capshare.functions.quantiles import read_at_grid, sorted_quantiles
from capshare.operators import boosting as B, calibration as CAL, predicates, registry as RG, replay, search, series
from capshare.plans.q_stats import signed
from capshare.session import shared_dir
from capshare.streaming import stateful

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)


def test_window_quantiles_equal_duckdb_bit_by_bit(spark):
    """An outcome that ties with its quantile misses in both engines or in none."""
    rng = random.Random(3)
    rows = [(i, sorted(rng.randrange(90) / (5 + rng.randrange(1, 9)) for _ in range(rng.randrange(1, 31)))) for i in range(300)]
    rows += [(300 + i, [rng.randrange(1, 90) / 7] * rng.randrange(2, 31)) for i in range(100)]
    rows += [(400, [0.0] * 5), (401, [0.0, 0.0, 3.5])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r["id"]: list(r["q"]) for r in df.select("id", sorted_quantiles("v", LEVELS).alias("q")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, v DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute(f"SELECT id, quantile_cont(x, {list(LEVELS)}) FROM (SELECT id, unnest(v) AS x FROM t) GROUP BY id").fetchall())
    assert got == want


def test_quantiles_of_nothing_and_of_infinity(spark):
    df = spark.sql("SELECT array() :: array<double> AS v UNION ALL SELECT array(1D, double('infinity'))")
    got = sorted(str(r["q"]) for r in df.select(sorted_quantiles("v", (0.5,)).alias("q")).collect())
    assert got == ["[None]", "[inf]"]


def _sent_to_driver(spark) -> int:
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
    return sum(stages.apply(i).resultSize() for i in range(stages.size()))


def test_boosting_sends_the_driver_one_message_a_pass(spark, monkeypatch):
    """Twenty tasks send no histograms of their own."""
    monkeypatch.setattr(B, "TASK_ROWS", 1_000)
    names, sent = ["a", "b", "c"], []
    for parts in (1, 20):
        df = spark.range(0, 20_000, 1, parts).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(n) for i, n in enumerate(names)])
        before = _sent_to_driver(spark)
        assert len(B.fit(df.withColumn("y", F.col("a") + F.col("b")), names, levels=(0.5,), rounds=2)[0]["losses"]) == 3
        sent.append(_sent_to_driver(spark) - before)
    assert sent[1] < 2_500_000, sent        # a task reports about 6 kB beside its result


def test_dense_grid_is_not_shuffled(spark):
    """All slots of every key, events at the borders of chunks and without a value among them; only sums and starts of chunks are exchanged."""
    hits = [(k, s, v) for k in (1, 2, None) for s, v in ((0, 3), (255, 4), (256, None), (256, 5), (511, 6), (600, None), (4999 if k == 1 else 4000, 7))]
    df = spark.createDataFrame(hits, "k bigint, slot bigint, v bigint").repartition(4)
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def records():
        stages = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    got = {(r["k"], r["slot"]): r["v"] for r in series.densify(df, ["k"], "v").collect()}
    want = {(k, s): 0 for k in (1, 2, None) for s in range(5000)}
    for k, s, v in hits:
        want[k, s] += v or 0
    assert got == want
    assert records() - before < 1000
    assert series.densify(df.where("k = 9"), ["k"], "v").count() == 0


def test_candidates_are_scored_without_a_shuffle_of_their_rows(spark):
    """Decisions are exchanged once; the copies of a decision for every candidate stay where it is."""
    d = spark.range(64).select((F.col("id") % 4).alias("link_id"), (F.col("id") % 2).alias("epoch"), F.col("id").alias("cell_id"), F.lit(3.0).alias("cap"))
    many = search.tried(d, spark.range(5).withColumnRenamed("id", "candidate"))
    group = ["link_id", "epoch", "candidate"]
    each = many.withColumn("s", F.sum("cap").over(W.partitionBy(*group).orderBy("cell_id"))).groupBy(*group).agg(F.max("s").alias("s"))
    assert [tuple(r) for r in each.select("s").distinct().collect()] == [(48.0,)] and each.count() == 20
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(link_id" in plan and "candidate#" not in plan.split("hashpartitioning")[1].split(")")[0], plan


def test_offsets_are_those_of_the_plain_fold_bit_by_bit(spark):
    """Also the sign of an offset that rounds to nothing."""
    rng = random.Random(5)
    miss = {c: [int(rng.random() < 0.1) for _ in range(150)] for c in range(60)}
    df = spark.createDataFrame([(c, k, m) for c, v in miss.items() for k, m in enumerate(v)], "cell long, k long, miss int")
    off = CAL.offsets(df, ["cell"], "k", "miss", 2, lo=-0.05, hi=0.1, chunk=16)
    got = {(r["cell"], r["k"]): (repr(r["delta"]), repr(r["short"])) for r in off.select("cell", "k", "delta", signed("delta").alias("short")).collect()}
    con, want = duckdb.connect(), {}
    for c, v in miss.items():
        d = 0.0
        for k in range(150):
            if k >= 2:
                d = min(max(d + 0.02 * (v[k - 2] - (1 - 0.9)), -0.05), 0.1)
            want[c, k] = d
    short = con.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [list(want.values())]).fetchall()
    assert got == {at: (repr(d), repr(s)) for (at, d), (s,) in zip(want.items(), short, strict=True)}
    assert any(s == "-0.0" for _, s in got.values())


def test_rolling_rates_hold_flat_arrays_only(spark):
    """About 24 bytes a position beside the input; empty and missing series give empty rates."""
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 50, n).astype(float) for n in (0, 1, 300, 7)] + [rng.integers(0, 50, 400).astype(float) for _ in range(2000)]
    series_, deadline = pa.array([*lists, None], pa.list_(pa.float64())), pa.array([1 + i % 16 for i in range(len(lists) + 1)])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    got = demand._rolled(series_.slice(1), deadline.slice(1), 5)
    held = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 45 * sum(map(len, lists)), held
    for g, v, d in zip(got.to_pylist(), lists[1:], deadline.to_pylist()[1:]):
        rate, crit = demand._rolling(v, d, 5)
        assert g["rate"] == rate.tolist() and g["crit"] == crit.tolist()
    assert got[-1].as_py() == {"rate": [], "crit": []}
    plan = spark.sql("SELECT array(1D, 2D) AS a, 3 AS d").select(demand.rolling_rates(5)("a", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and demand.rolling_rates(5).evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_many_groups_travel_in_one_frame(spark):
    """A rule of one group sees each group once and whole, also those that frames cut and keys that are null."""
    light = spark.newSession()
    light.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(None if i % 9 == 8 else i % 9, i % 5, i, None if i == 3 else i) for i in range(400)] + [(77, 1, 400 + i, 1) for i in range(30)]
    df = light.createDataFrame(rows, "link_id long, epoch long, cell_id long, x long").withColumns({"cap": F.lit(1e9), "capacity": F.lit(1e9)})

    def rule(pdf):
        assert pdf["x"].dtype == ("float64" if pdf["x"].isna().any() else "int64") and list(pdf.index) == list(range(len(pdf)))
        return pdf.assign(budget=float(len(pdf)) + pdf["cell_id"].min() / 1000)

    RG.register_allocator("by_size", rule, df.schema.add("budget", "double"))
    budgets = RG.apply_rule("by_size", df, series.Clock())
    want = pd.DataFrame(rows, columns=["l", "e", "c", "x"]).groupby(["l", "e"], dropna=False)["c"].agg(lambda c: len(c) + c.min() / 1000)
    got = {(r["link_id"], r["epoch"]): r["budget"] for r in budgets.select("link_id", "epoch", "budget").distinct().collect()}
    assert got == {(None if pd.isna(l) else l, e): b for (l, e), b in want.items()} and budgets.count() == len(rows)
    assert "FlatMapGroups" not in budgets._jdf.queryExecution().executedPlan().toString()


def test_runs_are_glued_from_stretches(spark):
    """Idle slots are not written out: rows shuffled and sorted go with the events, and the runs are those of the dense grid."""
    hits = [(k, s, v) for k in (1, 2, None) for s, v in ((0, 3), (1, 2), (255, 4), (256, 5), (300, 0), (511, 6), (512, None), (4999 if k == 1 else 4000, 7))]
    df = spark.createDataFrame(hits, "k bigint, slot bigint, v bigint")
    parts = series.filled(df, ["k"], "v").select("k", F.inline(F.array(
        F.struct(F.col("_from").alias("a"), F.col("_from").alias("b"), (F.col("_v") > 0).alias("busy")),
        F.struct((F.col("_from") + 1).alias("a"), F.col("_to").alias("b"), F.lit(False).alias("busy"))))).where("a <= b")
    assert parts.count() <= 2 * (len(hits) + 3 * 20)
    got = sorted(series.sojourns(parts, ["k"], "a", "busy", 256, until="b").collect(), key=str)
    dense = series.densify(df, ["k"], "v").select("k", "slot", (F.col("v") > 0).alias("busy"))
    assert got == sorted(series.sojourns(dense, ["k"], "slot", "busy", 256).collect(), key=str) and len(got) > 9


class _Handle:
    """State of one key in memory; counts the messages that a real one would send."""
    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def _sent(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._sent(self.value is not None)

    def get(self):
        return self._sent(self.value)

    def update(self, value):
        self.value = self._sent(value)

    def iterator(self):
        return self._sent(iter(list(self.map.items())))

    def removeKey(self, key):
        self._sent(self.map.pop(key))

    def updateValue(self, key, value):
        self.map[key] = self._sent(value)


def test_queue_stream_reads_and_writes_its_state_once_a_batch():
    """And serves as the batch replay does, in order and with a row ahead of its turn."""
    rng, h = np.random.default_rng(4), _Handle()
    arrived, allowed = rng.integers(0, 40, 60) * (rng.random(60) < 0.5), rng.integers(0, 20, 60) * 1.5
    p, out, calls = stateful.FifoProcessor(64), [], []
    p.init(h)
    for slots in (range(20), range(20, 40), [*range(40, 50), *range(51, 60)], [50]):
        frame = pd.DataFrame({"slot": list(slots), "deadline": 6, "arrived": arrived[list(slots)].astype(float), "allowed": allowed[list(slots)]})
        before = h.calls
        out += list(p.handleInputRows((7,), iter([frame.iloc[:9], frame.iloc[9:]]), None))
        calls.append(h.calls - before)
    got, ages = pd.concat(out, ignore_index=True), np.zeros((1, 7))
    assert calls[:2] == [2, 2] and not h.map and got["slot"].tolist() == list(range(60)) and set(got["cell_id"]) == {7}
    for r in got.itertuples():
        ages, taken, dropped = replay.step(ages, arrived[[r.slot]], allowed[[r.slot]], np.array([6]))
        waiting = np.nonzero(ages[0] > 0)[0]
        assert (r.served, r.violated, r.queue, r.hol, list(r.taken)) == (taken.sum(), dropped[0], ages.sum(), max(waiting, default=0), taken[0].tolist())


def test_members_of_a_mixture_are_not_exploded(spark):
    """Only knots are exchanged; members without a forecast do not count, a key that has no other keeps its row."""
    rows = [(1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (1, None), (1, [2.0, 2.0, 2.0, 2.0, 2.0, 2.0]), (2, None), (None, [1.0] * 6)]
    got = predicates.mixture(spark.createDataFrame(rows, "k long, q array<double>"), ["k"])
    values = {r["k"]: r["q"] for r in got.collect()}
    one = spark.createDataFrame(rows[:1], "k long, q array<double>").select(read_at_grid("q").alias("v")).first()["v"]
    assert np.allclose(values[1], np.maximum(np.quantile([*one, *[2.0] * 99], LEVELS), 0), atol=1e-12)
    assert values[2] is None and values[None] == [1.0] * 6 and len(values) == 3
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_words_reach_the_merges_without_the_whole_tokenizer():
    """Line ends inside a word and runs of marks behind it; what is in use stays when the cache turns over; ids are those of the tokenizer on the whole text."""
    import public_tokenizers
    from capshare.llm import packing
    e, rng = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), cache_words=60), random.Random(2)
    atoms = ["a", "the", "Dó", "'s", "$$$", ".%%%", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\x1c", "\x85", "\xa0", "42", "日本", "ⅷ", "\u200b", "😀", "'ll", "<|"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert [t for t in texts if e.encode(t) != e.whole(t)] == []
    e, calls = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), cache_words=100), []
    whole, word = e.whole, e.word
    e.whole = lambda text: calls.append(text) or whole(text)
    e.encode("x " + " ".join(f"ab{chr(97 + i)}.\nCd{chr(97 + i)},\nef{chr(97 + i)}$$$" for i in range(20)))
    assert sorted(calls) == ["$$$", ",", ".", "x"]
    made = []
    e.word = lambda w: made.append(w) or word(w)
    for i in range(400):
        e.encode("x often " + "".join(chr(97 + int(d)) for d in str(i)))
    assert made.count("often") == 1


def test_a_finished_step_gives_its_disk_back(spark):
    """Its shuffle files go at once and not with the query after the next; of repeated passages only what the result reads stays."""
    from capshare.llm import common, suffix_dedup
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    before = shuffles()
    common.settle(spark.range(100_000).repartition(8, "id"), "step")
    step = shuffles() - before
    common.release(spark)
    until = time.time() + 10
    while step & shuffles() and time.time() < until:
        time.sleep(0.1)
    assert step and not step & shuffles()
    folder, rng = shared_dir(spark), random.Random(6)
    had, passage = set(os.listdir(folder)), "".join(rng.choice("abcdefgh ") for _ in range(400))
    docs = spark.createDataFrame([(i, f"{i} {rng.random()} {passage} {rng.random()}") for i in range(20)], "doc_id long, text string")
    out = suffix_dedup.dedup(docs)
    assert sorted(f.split("-")[1] for f in set(os.listdir(folder)) - had if f.startswith("llm-")) == ["marked", "rows", "texts"]
    assert {len(r["spans"]) for r in out.collect()} == {1} and out.where("n_removed >= 400").count() == 20


def test_marks_behind_a_word_cost_no_merges():
    """Whatever stands behind it, a word goes through the merges once; many texts together give the ids that the tokenizer gives for each."""
    import public_tokenizers
    from capshare.llm import packing
    e, rng = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    merged, made = e.merged, []
    e.merged = lambda letters: made.append(letters) or merged(letters)
    e.encode("x " + " ".join("zorblaki" + m for m in ("", ",", ".", "!?", "...", ")")))
    assert len([x for x in made if "zorblaki" in x]) == 1
    atoms = ["a", "Dó", "'s", "$$$", ".%", "\n", " ", " ", " ", "  ", "\t", "\xa0", "42", "日本", "😀", "Ġa", "\u0301", "»,", "_", "<|endoftext|>"]
    texts = ["", " ", "a", *["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(3000)]]
    got = [x.tobytes() for x in e.encode_all(texts)]
    assert [t for t, ids in zip(texts, got, strict=True) if ids != e.whole(t)] == []
    assert list(packing.spans(["aa", "b", "cccc", "", "d"], 2, 3)) == [(0, 2), (2, 3), (3, 5)] and list(packing.spans([], 2, 3)) == []
