"""Findings of the second review: each of these failed before."""
import numpy as np
import pytest

from capshare.llm import jaccard_join as J, line_dedup, mixing, suffix_dedup
from capshare.llm.common import numbered


def test_join_counts_distinct_ngrams(spark):
    once = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, once), (2, " ".join([once] * 3)), (3, "ha " * 7), (4, "ha " * 90), (5, "something else of no account here")], "doc_id bigint, text string")
    got = {r.id: (r.class_id, r.n_links) for r in J.join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_sketches_miss_less_than_the_runs():
    k, rng = J.least_of(0.8) * J.SKETCH, np.random.default_rng(0)
    assert k == 35 and (rng.binomial(J.SKETCH, 0.8 + 0.2 / 256, 1_000_000) < k).mean() < 1e-5


def test_dense_child_settles_its_own_parent_only(spark):
    """x is in a dense child in runs 0 and 3, y and x are alone together in large buckets of runs 1 and 2, z and y in one of run 4."""
    rng = np.random.default_rng(1)
    fresh = lambda n: rng.integers(1, 2 ** 62, n).tolist()
    tail, paths = fresh(J.SPLITS), []
    x, y, z = fresh(J.RUNS), fresh(J.RUNS), fresh(J.RUNS)
    for run in (1, 2):
        y[run] = x[run]
    z[4] = y[4]
    paths += [x + tail, y + tail, z + tail]
    for run, v, own in [(0, x, tail), (3, x, tail), (1, x, None), (2, x, None), (4, z, None)]:
        for _ in range(30):
            head = fresh(J.RUNS)
            head[run] = v[run]
            paths.append(head + (own or fresh(J.SPLITS)))
    rows = J.buckets(spark.createDataFrame(list(enumerate(paths)), "uid bigint, path array<bigint>"), limit=16).where("uid < 3").collect()
    meet = {}
    for r in rows:
        meet.setdefault(r.bucket, set()).add(r.uid)
    assert {0, 1} in meet.values() and {1, 2} in meet.values() and sum({0, 1} == m for m in meet.values()) >= 2


@pytest.fixture
def moved(spark, tmp_path):
    """Six files of four rows, rows 0..11 again as 12..23, and a function that moves the splits: from a file each to all files in one."""
    text = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(20)) for j in range(4))
    rows = [(i, text(i % 12), "en", f"s{i % 2}", i) for i in range(24)] + [(i, text(i), "de", "s0", i) for i in range(24, 32)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartitionByRange(6, "doc_id").write.parquet(str(tmp_path / "docs"))
    keys = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}

    def move():
        for k, v in keys.items():
            spark.conf.set(k, v)

    yield spark.read.parquet(str(tmp_path / "docs")), move
    for k in keys:
        spark.conf.unset(k)


def test_row_numbers_when_splits_move(moved):
    docs, move = moved
    numbers = numbered(docs, [docs["doc_id"]], "n", "t")
    lines, one, mixture, spans = line_dedup.dedup_lines(docs), J.one_of_each(docs), mixing.mixed(docs), suffix_dedup.dedup(docs)
    before, n = {r.doc_id: r.n for r in numbers.collect()}, docs.rdd.getNumPartitions()
    drawn = sorted(r.doc_id for r in mixture.collect())
    move()
    assert docs.select("*").rdd.getNumPartitions() < n
    assert {r.doc_id: r.n for r in numbers.select("*").collect()} == before and len(set(before.values())) == 32
    assert {r.doc_id: r.n_removed for r in lines.select("row.doc_id", "n_removed").collect()} == {i: 4 * (12 <= i < 24) for i in range(32)}
    assert sorted(r.doc_id for r in one.select("*").collect()) == [*range(12), *range(24, 32)]
    assert sorted(r.doc_id for r in mixture.select("*").collect()) == drawn
    assert {r.id: r.n_removed > 0 for r in spans.select("*").collect()} == {i: i < 24 for i in range(32)}
