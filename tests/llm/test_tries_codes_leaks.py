"""Prefix trie, vector codes and decontamination: edge cases and brute force; the SQL comparison of all operators is in test_llm.py."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capshare.llm import code_compression as C, decontamination as D, turn_trie as T

SF = "/root/testdata/sf0.001"
TURN = "conv_id bigint, turn bigint, role string, text string, base string, seq string, key string, shard string"


def nodes_of(convs: dict[int, list[tuple[str, str]]]):
    """Every node from all its members, without a trie."""
    members = collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[:len(path)] == path]
        parent = min(members[path[:-1]]) if path else None
        kids = lambda p: sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in under)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(path)))
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        out.append((min(cs), len(path), parent, len(cs), kids(path), sum(kids(p) == 0 for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items() if c is not None}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = lambda c: c - int(np.fmod(c, 20))
    return {c: own.get(base(c), [])[:heads[c]] + own[c][heads[c]:] for c in own}


def run_trie(spark, rows, shard_turns):
    df = spark.createDataFrame([(*r, "b", "s", "k", "x") for r in rows], TURN)
    seqs = T.grafted(T.sequences(df, F.col("conv_id") - F.col("conv_id") % 20), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    return sorted((tuple(r) for r in T.trie(seqs, shard_turns).collect()), key=str)


@pytest.mark.parametrize("shard_turns", [7, 10 ** 6])
def test_trie_against_all_prefixes(spark, shard_turns):
    rnd = random.Random(5)
    rows = []
    for c in range(-25, 60):        # short alphabets: many shared prefixes, equal conversations, ends inside others
        rows += [(c, t, rnd.choice("us"), rnd.choice(["a b", "c", "", None])) for t in range(rnd.randrange(1, 6))]
    rows += [(100 + c, t, "u", f"hot {t}") for c in range(30) for t in range(4)] + [(200, t, "u", f"long {t}") for t in range(300)]
    rows += [(7, None, None, None), (7, None, None, None), (8, 2, "u", "tie"), (8, 2, "u", "other"), (None, 1, "u", "lost"), (41, 0, "u", "x")]
    assert run_trie(spark, rows, shard_turns) == nodes_of(rebuilt(rows))


def test_trie_of_nothing_and_of_turnless(spark):
    assert run_trie(spark, [], 10) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert run_trie(spark, [(c, 1, "u", "only")], 10) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_double_array_finds_every_path_and_nothing_else():
    rnd = random.Random(2)
    seqs = sorted({tuple(rnd.randrange(40) for _ in range(rnd.randrange(6))) for _ in range(400)})
    ids = np.array([x for s in seqs for x in s], np.int64)
    length = np.array([len(s) for s in seqs])
    base, check, dense = T.pack(ids, np.cumsum(length) - length, length)
    paths = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    assert (check >= 0).sum() == len(paths) + 1 and len(check) < 3 * len(paths)
    slot = {(): 0}
    for p in sorted(paths, key=len):
        s = slot[p[:-1]]
        slot[p] = base[s] + dense[p[-1]]
        assert check[slot[p]] == s
    assert len(set(slot.values())) == len(paths) + 1
    for p in list(paths)[:200]:
        for x in range(40):
            if (*p, x) not in paths and 0 <= (at := base[slot[p]] + dense[x]) < len(check):
                assert check[at] != slot[p]


def lloyd(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, integers of equal length): codes, errors and entries by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in rows], object)
    w = x.shape[1] // parts
    out = [["", 0] for _ in rows]
    books = []
    for p in range(parts):
        part = [tuple(v) for v in x[:, p * w:(p + 1) * w]]
        book = part[:entries]
        near = lambda v: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True)), e))
        for _ in range(rounds):
            at = [near(v) for v in part]
            book = [tuple(sum(v[i] for v, a in zip(part, at, strict=True) if a == e) // at.count(e) for i in range(w)) if e in at else book[e] for e in range(len(book))]
        for o, v in zip(out, part, strict=True):
            e = near(v)
            o[0] += f"{e:02x}"
            o[1] += sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True))
        books.append(book)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = collections.Counter()
    for r, o in zip(rows, out, strict=True):
        total[r[1]] += o[1]
    return sorted(((r[0], o[0], o[1], total[r[1]], digest) for r, o in zip(rows, out, strict=True)), key=str)


@pytest.mark.parametrize("owner_rows", [9, 10 ** 6])
@pytest.mark.parametrize("n, size", [(150, 16), (5, 11), (1, 0)])
def test_codes_against_plain_loops(spark, owner_rows, n, size):
    rnd = random.Random(n)
    rows = [(i // 2 if i > 20 else i, rnd.choice([None, 1, 2]), [rnd.choice([-0.75, 0.5, 0.25, rnd.uniform(-1, 1)]) for _ in range(size)]) for i in range(n)]
    rows += [(None, 1, [0.5] * size)] + [(3, 1, [0.125] * size)] * 40
    odd = [(1, 1, None), (2, None, [None] + [1.0] * 15), (3, 1, [float("nan")] * 16), (4, 1, [float("-inf")] * 16)]
    df = spark.createDataFrame([(*r, "u", "p") for r in rows + odd], "vec_id bigint, label int, embedding array<double>, uid string, p string")
    wide = -(-size // 8) * 8
    want = lloyd([(i, lab, [int(np.floor(4096 * c)) for c in v] + [0] * (wide - size)) for i, lab, v in rows])
    assert sorted((tuple(r) for r in C.compress(df, owner_rows=owner_rows).collect()), key=str) == want


def test_codes_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([(1, 2, None)], "vec_id bigint, label int, embedding array<float>")
    assert C.compress(df).count() == 0 and C.compress(df.where("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="too large"):
        C.compress(spark.createDataFrame([(1, 2, [1e30])], df.schema))


def leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k:k + size])].add("" if i is None else str(i))
    sizes = sorted({len(w) for w in wins})
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (win := tuple(w[k:k + n])) in wins:
                    hit |= set(range(k, k + n))
                    met |= wins[win]
        out.append((i, len(w), len(hit), sorted(met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_chars", [200, 10 ** 6])
def test_leaks_against_sets_of_windows(spark, max_chars):
    rnd = random.Random(11)
    base = [rnd.choice("one two THREE vier fünf 日本 6 x".split()) for _ in range(400)]
    items = [(i, " ".join(base[a:a + n])) for i, (a, n) in enumerate([(0, 40), (20, 14), (60, 10), (100, 9), (100, 9), (200, 3), (390, 10), (0, 40)])] + [(None, "rare: word"), (77, ""), (78, None), (79, "?!"), (5, "Ölung nötig")]
    docs = [(i, " ,-".join(base[a:a + n])) for i, (a, n) in enumerate((rnd.randrange(380), rnd.randrange(5, 60)) for _ in range(60))]
    docs += [(1000, None), (1001, ""), (1002, "RARE\x00word ölung Nötig Ölung nötig"), (None, "rare.word"), (1003, "wordrare word"), (1004, ("pad " * 20000) + " ".join(base[:12]) + " pad" * 9), (0, "one"), (0, "one")]
    d = spark.createDataFrame([(*r, "u", "s", 1) for r in docs], "doc_id bigint, text string, uid string, spans string, items int")
    b = spark.createDataFrame([(*r, "w") for r in items], "item_id bigint, text string, window string")
    got = D.scan(d, b, max_chars=max_chars).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == leaks(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) == bool(r.spans) for r in got)
    text = {i: t for i, t in docs}
    for r in got:
        for s in r.spans if r.id not in (None, 0) else ():       # spans begin and end at words of the original
            part = text[r.id][s.start:s.end]
            assert len(re.findall(D.WORD, part.lower())) == s.last - s.first + 1 and re.match(D.WORD, part[0].lower()) and re.match(D.WORD, part[-1].lower())
    assert D.scan(d.where("false"), b).count() == 0 and {r.contaminated for r in D.scan(d, b.where("false")).collect()} == {False}


def test_leaks_of_the_whole_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in D.scan(docs, bench).collect()), key=str)
    assert got == leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]) and any(g[2] for g in got)
