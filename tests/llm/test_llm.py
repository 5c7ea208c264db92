"""Edge cases of every corpus operator, and brute force where SQL has no form of it."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import check
from capshare.llm import graph, jaccard_join as J, line_dedup, mixing, packing, quality, queries as Q, sharding, suffix_dedup as S, topk, toxicity, warc
from capshare.llm.common import shared_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars int, uid string, row string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    rows = [(1, "a b c\nd e f\ng h i\nj k", "en", "s1", 3), (2, "a b c\nd e f\ng h i\nz", None, "s1", None), (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n\t ", "xx", "s2", 4),
            (None, "one two", "en", "s2", 7), (7, long, "en", "s1", 1), (7, long, "en", "s1", 1), (9, "ß é 日本 x", "de", "s2", 9)]
    return spark.createDataFrame([(*r, "u", "r", "z") for r in rows], DOC)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.mark.parametrize("name", [n for n in Q.oracle_sql()])
def test_against_sql(spark, name):
    ok, note = check.compare(spark, check.duck(SF), SF, name, Q.queries()[name], Q.oracle_sql()[name])
    assert ok, note


def test_lines(spark, odd, none):
    got = line_dedup.dedup_lines(odd).select("row.doc_id", "text", "n_removed").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and by[2].text == "z" and by[2].n_removed == 3 and by[1].n_removed == 0 and by[3].text is None and by[5].text == " \n\t "
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.cleaned(odd).columns == odd.columns and line_dedup.cleaned(none).count() == 0


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-9 for r in got) and mixing.mix(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd).collect())) and mixing.mixed(odd).columns == odd.columns
    t = {(r.source, r.source_size): r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 90)], "source string, source_size long")).collect()}
    assert t["a", 10] == 30 and sum(t.values()) == pytest.approx(1100)


def test_sharding(spark, odd, none):
    docs = spark.range(5000).select((F.col("id") % 3000).alias("doc_id"), F.lit("t").alias("text")).union(spark.range(2500).select(F.lit(None).cast("bigint"), F.lit("t")))
    for n in (40, 41):
        got = sharding.shard(docs, n, chunk=100).toPandas()
        sizes = got.groupby("shard").slot.agg(["count", "max"])
        assert len(got) == 7500 and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and not got.duplicated(["shard", "slot"]).any()
    assert sharding.shard(odd).count() == 9 and sharding.shard(none).count() == 0
    spread = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = (sharding.shard(spread, n).toPandas().set_index("id").shard for n in (40, 41))
    assert (a != b.reindex(a.index)).mean() < 0.5        # hashing modulo the shard count would move 97 %


def test_quality(spark, odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == 9 and {r.id: r.n_words for r in got}[3] == 0 and not {r.id: r.kept for r in got}[4]
    assert quality.judge(none).count() == 0 and quality.kept_documents(odd).columns == odd.columns
    good = " ".join(f"the word{i} of and line{i * 7}" for i in range(60))
    rows = [(i, good + f" end{i}", "en", "s", 1, "", "", "") for i in range(20)] + [(99, " ".join(f"x{i}###$$$ | %%%" for i in range(80)), "en", "s", 1, "", "", "")]
    kept = {r.id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert all(kept[i] for i in range(20)) and not kept[99]


def test_quality_of_any_language(spark):
    rnd = random.Random(4)
    ru, el = (["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 9))) for _ in range(400)] for a in ("абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρσ"))
    text = lambda words, n: ". ".join(" ".join([rnd.choice(words).capitalize(), *rnd.choices(words, k=11)]) for _ in range(n // 12))
    en = "the of and to in house river sky stone garden window teacher morning answer little people water".split()
    rows = [(i, text(w, 300), lang) for i, (w, lang) in enumerate([(ru, "ru")] * 60 + [(el, "el")] * 5 + [(el, None)] * 5 + [(en, "en")] * 60)]
    rows += [(1000 + i, " ".join(f"{rnd.randrange(10 ** 6)}|#{rnd.randrange(99)}" for _ in range(n)), lang) for i, (n, lang) in enumerate([(200, "ru"), (200, "en"), (55, "en"), (200, "el")])]
    got = {r.id: r for r in quality.judge(spark.createDataFrame([(i, t, lang, "s", 1, "", "", "") for i, t, lang in rows], DOC)).collect()}
    assert not any(r.base_failed for r in got.values()) and all(got[i].kept for i in range(130))         # Greek has too few documents for a reference
    assert not got[1000].kept and not got[1001].kept and got[1002].kept and got[1003].kept               # too short to tell, no reference


@pytest.mark.parametrize("rows", [[(i, [float((i * 7 + j * 3) % 11 - 5) / 8 for j in range(6)]) for i in range(200)], [(i, [0.5, 0.5]) for i in range(90)], [(0, [1.0]), (20, [2.0])]])
def test_topk(spark, rows):
    odd = [(1000, None), (1020, [1.0, None]), (1040, [float("nan")]), (1060, [float("inf")]), (None, [1.0])]
    v = topk.quantised(spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>"))
    got = [tuple(r) for r in topk.search(v.where("id % 20 = 0"), v, 20).orderBy("query_id", "rank").collect()]
    q = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows}
    want = [(i, k + 1, j, s) for i in q if i % 20 == 0 for k, (s, j) in enumerate(sorted(((int(q[i] @ q[j]) if len(q[i]) == len(q[j]) else int(q[i][:1] @ q[j][:1]), j) for j in q if j != i), key=lambda x: (-x[0], x[1]))[:20])]
    assert got == want and topk.search(v.where("false"), v).count() == 0


def test_topk_keeps_rows_that_repeat_an_id(spark):
    rows = [(i % 10 * 20, [float(i % 7 - 3), float(i % 3)], i, "x") for i in range(20)] + [(5, [3.0, 2.0], 0, "x")] * 3
    v = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, row int, o string"))
    got = sorted(tuple(r) for r in topk.search(v.where("id % 20 = 0"), v, 30).collect())
    x = [(i, np.array([64 * c for c in e], int)) for i, e, *_ in rows]
    want = sorted((i, k + 1, j, s) for a, (i, e) in enumerate(x) if i % 20 == 0 for k, (s, j) in enumerate(sorted(((int(e @ f), j) for b, (j, f) in enumerate(x) if a != b), key=lambda t: (-t[0], t[1]))))
    assert got == want and len(got) == 20 * 22


def test_warc(spark):
    rows = [(2, "http://a b\n", "x\r\n\r\nWARC/1.1\r\n", 1), (1, None, "x\r\n\r\nWARC/1.1\r\n", 2), (None, "u", None, 3), (5, "u", "", 4), (5, "u", "", 4), (7, "u", "é" * 70000, 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    raw, out = shared_path(spark, "a"), shared_path(spark, "b")
    warc.write_archive(pages, raw)
    warc.deduplicate(spark, raw, out)
    got = warc.resolve(warc.read_archive(spark, out, payload=True)).collect()
    assert sorted(r.payload for r in got) == sorted(r[2] or "" for r in rows)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to_page) for r in got)
    assert kinds == {(1, "response", None): 1, (2, "revisit", 1): 1, (None, "revisit", 5): 1, (5, "response", None): 1, (5, "revisit", 5): 1, (7, "response", None): 1}
    warc.deduplicate(spark, raw, out + "-long", least=10)
    assert {r.record_type for r in warc.read_archive(spark, out + "-long").where("payload_bytes = 0").collect()} == {"response"}
    empty = shared_path(spark, "c")
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, e = Tokenizer.from_file(path), packing.Encoder(path)
    for s in ["", " ", "  a", "a  b", "a \nb", "a\n b", "a\tb c ", "<|endoftext|> x", " x  ", " a b  c", "a's b'll  \n\n c d", "日本 語x é. ß,"]:
        assert e.encode(s) == np.asarray(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), s
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd, allowMissingColumns=True)
    got = packing.pack(docs, path, max_open=40).toPandas()
    ends = got.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id").length.cumsum() - ends.length == ends.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.length.sum() > 0.97 * 1024 * got.sequence_id.nunique() - 1024 * docs.rdd.getNumPartitions()
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        want[len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1] += 1
    assert sum(k * v for k, v in want.items()) == got.length.sum() and packing.pack(none, path).count() == 0
    text = texts(spark).set_index("doc_id").text
    for r in got[got.doc_id.isin(range(20, 60))].itertuples():
        ids = np.asarray(tok.encode(text[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        t = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 40))] + [0]
        assert S.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def spans_of(data, length):
    seen = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                m[i:i + length] = b"\1" * length
        out.append((len(b), sum(m), bytes(x for x, y in zip(b, m) if not y)))
    return out


@pytest.mark.parametrize("limit", [50_000, 1])
def test_suffix_dedup(spark, odd, none, limit):
    extra = [(100, "ab" * 400), (101, "q" * 50 + "ab" * 150), (102, "z" * 199), (103, "z" * 199), (104, "k" * 900 + "é" * 120), (105, "é" * 120 + "end")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string")).union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80))
    rows = docs.collect()
    got = collections.Counter((r.id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in S.dedup(docs, limit=limit).collect())
    assert got == collections.Counter((r.doc_id, *x) for r, x in zip(rows, spans_of([(r.text or "").encode() for r in rows], 200)))
    assert S.dedup(none).count() == 0


def test_repeated_starts():
    """Regions around one anchor, with NUL bytes, cut at any place, without any rare byte; groups dealt to several suffix arrays."""
    rng = random.Random(5)
    for _ in range(60):
        groups, regions, offs = [], [], []
        for g in range(rng.randint(1, 5)):
            core = bytes(rng.choice(b"ab \0c") for _ in range(368))
            for _ in range(rng.randint(1, 9)):
                r = bytearray(core)
                for x in (rng.randrange(368) for _ in range(rng.randint(0, 4))):
                    if not 168 <= x < 200:
                        r[x] = rng.choice(b"xyz\0")
                lo, hi = rng.choice([0, 0, 50, rng.randint(0, 168)]), rng.choice([368, 368, rng.randint(200, 368)])
                groups.append(g), regions.append(bytes(r[lo:hi])), offs.append(168 - lo)
        starts = [range(min(o, len(r) - 200) + 1) for r, o in zip(regions, offs)]
        seen = collections.Counter((g, s - o, r[s:s + 200]) for g, r, o, t in zip(groups, regions, offs, starts) for s in t)
        want = [[s for s in t if seen[g, s - o, r[s:s + 200]] > 1] for g, r, o, t in zip(groups, regions, offs, starts)]
        groups, offs = np.array(groups), np.array(offs)
        assert [x.tolist() for x in S.repeated_starts(groups, regions, offs, 200)] == want
        for most in (300, 3000, 1 << 20):
            got = S._trimmed(groups, regions, offs, np.ones(len(groups), np.int64), 200, 32, most)
            assert [{i for a, b in x.tolist() for i in range(a, b)} for x in got] == [{i for s in w for i in range(s, s + 200)} for w in want]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)] + [(7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_join(spark, odd, none):
    rng = random.Random(3)
    base = [f"t{rng.randrange(400)}" for _ in range(120)]
    near = [(1000 + i, " ".join(base[:i] + [f"n{i}"] + base[i + 1:]), None) for i in range(0, 120, 2)]        # a dense bucket, cut into blocks
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is not null")).union(spark.createDataFrame([n[:2] for n in near], "doc_id bigint, text string"))
    docs = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    rows = docs.collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[a:a + k]) for a in range(len(w) - k + 1)) if k else frozenset())
    links, label = collections.Counter(), {r.doc_id: r.doc_id for r in rows}
    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and c >= .8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                links[rows[a].doc_id] += 1
                links[rows[b].doc_id] += 1
                x, y = label[rows[a].doc_id], label[rows[b].doc_id]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r.id: (r.class_id, r.n_links) for r in J.join(docs, limit=16).collect()}
    assert got == {r.doc_id: (label[r.doc_id], links[r.doc_id]) for r in rows}
    assert J.join(odd).count() == 9 and J.join(none).count() == 0 and J.one_of_each(odd).columns == odd.columns


@pytest.mark.parametrize("tenths", [2, 5, 8])
def test_toxicity(spark, odd, none, tenths):
    """Also where half or most of the labels are toxic."""
    rng = random.Random(5)
    bad = [i % 10 < tenths for i in range(400)]
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "tree", "house"]) for _ in range(30)) + (f" vile{rng.choice('abcdefgh')}" if bad[i] else ""), int(bad[i])) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").union(odd.select("doc_id", "text").where("doc_id is null or text is null"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r.id: r for r in toxicity.score(docs, labels, F.col("doc_id") % 4 != 0).collect()}
    assert all((got[str(i)].score >= .5) == bool(y) for i, _, y in rows if i % 4 == 0) and 0 <= got[None].score <= 1
    assert toxicity.score(none, labels, F.lit(True)).count() == 0 and toxicity.score(odd, labels.where("false"), F.lit(True)).count() == 9


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    rows = [(sorted(rng.choice(50, int(rng.integers(1, 8)), replace=False).tolist()), None, int(rng.integers(2)), str(i)) for i in range(1500)]
    rows = [(t, rng.integers(1, 4, len(t)).tolist(), y, i) for t, _, y, i in rows]
    ix = toxicity.Index(rows, rng.random(50) + 1)
    dense = np.zeros((1500, 50))
    for i, (t, tf, _, _) in enumerate(rows):
        dense[i, t] = ix.weights(t, tf)[1]
    for i in range(0, 1500, 50):
        s = dense @ dense[i]
        _, got = ix.nearest(rows[i][0], rows[i][1], 15)
        assert got == pytest.approx(np.sort(s[s > 0])[::-1][:15])


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns and d.count() > 0, name
    assert P.run(spark, SF).agg(F.sum("length")).first()[0] > 0
    empty = docs.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_tables_on_the_way_are_removed(spark):
    from pathlib import Path
    from capshare.llm.common import repeatable, settle, settled
    seen = []

    def build():
        inner = settle(spark.range(5).toDF("x"), "inner")
        seen.append(inner.inputFiles()[0])
        return inner.where("x > 1")

    out = settled(spark, "outer", build)
    assert sorted(r.x for r in out.collect()) == [2, 3, 4] and not Path(seen[0].removeprefix("file://")).exists()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert repeatable(docs, docs, "t") is docs
    shuffled = docs.distinct()
    assert repeatable(shuffled, shuffled, "t") is not shuffled
