"""N-gram Jaccard join by chosen paths.

A text is the set of its word five-grams (of all its words, if they are fewer). Equal texts form one class first. Then, per run, texts are split on a
sampled min-wise token; buckets above ``limit`` are split again on further sampled tokens; small buckets are brute-forced with
64-byte sketches. A bucket most of which shares a child is dense, and splitting it again would not help: its members meet in blocks of ``limit``, each
block pair a group of its own. A pair at Jaccard J shares a bucket of one run with probability J or so, and ``runs``
repeats: 1 - 0.2^8 > 0.99999 at 0.8 (0.36^8 < 0.0003 are missed inside dense buckets). Sketches miss a pair at the threshold with less than 2 in a million
(``least_of``); pairs whose sets differ too much in size to reach it are left out. What the sketches join into candidate groups is verified exactly, every
pair of a group once, in blocks; links are counted, never listed.

* null or empty texts, or texts of white space: no set, no link, a class of their own.
* equal texts count as linked; repeated rows are documents of their own.
* null ids: sort last when the smallest id of a class is taken. Ties are all links (the test is >=). Extra columns are ignored.
* very long texts are sets like any other. An empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle, settled
from .graph import components

SKETCH, RUNS, SPLITS = 64, 8, 16
_rng = np.random.default_rng(20240501)
_TABLE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = _rng.integers(1, 2 ** 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(1, 2 ** 63, SKETCH, dtype=np.uint64)
_PLACE = _rng.integers(1, 2 ** 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_cached: list = [0, None]


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts in order, and how many each text has (with repeats)."""
    parts = [(t or "").encode("utf-8") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    if _cached[0] < len(buf) + 1:
        _cached[:] = [2 * len(buf) + 1, _powers(2 * len(buf) + 1)]
    up, down = _cached[1]
    blank = _BLANK[buf]
    first, last = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * up[:len(buf)], dtype=np.uint64)])
    w = _mixed((total[last] - total[first]) * down[first])
    ends = np.cumsum([len(p) + 1 for p in parts])
    count = np.diff(np.searchsorted(first, np.concatenate([[0], ends]), side="right")) if len(parts) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(parts)), count)
    rank = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
    whole = np.minimum(count, size)[doc]
    start = np.flatnonzero(rank <= count[doc] - whole)
    h = np.zeros(len(start), np.uint64)
    for j in range(size):
        here = start[whole[start] > j]
        h[whole[start] > j] += w[here + j] * _PLACE[j]
    return _mixed(h + whole[start].astype(np.uint64)), np.where(count > 0, count - np.minimum(count, size) + 1, 0)


def distinct_counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes of the sets of n-grams: ``n`` without repeats."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(n))


def least_of(threshold: float, miss: float = 2e-6) -> float:
    """Share of equal sketch bytes that a pair at the threshold falls below with probability ``miss`` at most."""
    p, tail, k = threshold + (1 - threshold) / 256, 0.0, 0
    while k < SKETCH and (tail := tail + comb(SKETCH, k) * p ** k * (1 - p) ** (SKETCH - k)) < miss:
        k += 1
    return k / SKETCH


def signatures(docs: DataFrame, id_type: str) -> DataFrame:
    """``docs`` (rowid, id, text): rowid, id, key (MD5 of the text), n (distinct n-grams), path array<long>, sketch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), 200):
                part = pdf.iloc[a:a + 200]
                h, n = shingles(part["text"].tolist())
                mins = np.full((len(part), SKETCH), np.iinfo(np.uint64).max, np.uint64)
                some = np.flatnonzero(n > 0)
                if len(some):
                    starts = (np.cumsum(n) - n)[some]
                    for k in range(SKETCH):
                        x = (h ^ _XOR[k]) * _MIX[k]
                        mins[some, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
                yield pd.DataFrame({"rowid": part["rowid"], "id": part["id"].astype(object), "key": [md5((t or "").encode("utf-8")).digest() for t in part["text"]], "n": distinct_counts(h, n), "path": list(mins[:, :RUNS + SPLITS].view(np.int64)), "sketch": [r.tobytes() for r in (mins >> np.uint64(7)).astype(np.uint8)]})

    found = docs.select("rowid", F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "rowid long, id string, key binary, n long, path array<long>, sketch binary")
    return found.withColumn("id", F.col("id").cast(id_type))


def _groups(it: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of whole groups from rows that come sorted by group."""
    held = None
    for pdf in it:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = np.ones(len(pdf), bool)
        for c in by:
            same &= (pdf[c] == pdf[c].iloc[-1]).to_numpy()
        if not same.all():
            yield pdf[~same]
        held = pdf[same].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def _group_of(by: list[str], pdf: pd.DataFrame) -> np.ndarray:
    v = pdf[by].to_numpy()
    return np.concatenate([[0], np.cumsum((v[1:] != v[:-1]).any(axis=1))])


def _sketched(least: float, threshold: float):
    by = ["bucket", "a", "b"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(it, by):
            g, uid, n, chunk, cross = _group_of(by, pdf), pdf["uid"].to_numpy(), pdf["n"].to_numpy(), pdf["chunk"].to_numpy(), (pdf["a"] != pdf["b"]).to_numpy()
            s = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), SKETCH)
            left, right, at, lag = [], [], np.arange(len(pdf)), 1
            while len(at):
                at = at[at + lag < len(pdf)]
                at = at[g[at] == g[at + lag]]
                i, j = at, at + lag
                ok = (~cross[i] | (chunk[i] != chunk[j])) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[ok], j[ok]
                near = (s[i] == s[j]).mean(axis=1) >= least
                left.append(i[near])
                right.append(j[near])
                lag += 1
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            root = _roots(len(pdf), i, j)
            out = np.flatnonzero(root != np.arange(len(pdf)))
            yield pd.DataFrame({"a": uid[out], "b": uid[root[out]]})

    return run


def buckets(texts: DataFrame, limit: int, branches: int = 4, depth: int = 8) -> DataFrame:
    """(uid, bucket, size) of all buckets of two or more texts that are brute-forced."""
    member = texts.select("uid", F.posexplode(F.slice("path", 1, RUNS)).alias("run", "v")).select("uid", F.xxhash64("run", "v").alias("bucket"))

    def sized(m: DataFrame) -> DataFrame:
        n = settle(m.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        return m.join(n, "bucket")

    now, leaves = settle(sized(member), "members"), []
    for _ in range(depth):
        leaves.append(now.where(F.col("size") <= limit).select("uid", "bucket", "size"))
        big = now.where(F.col("size") > limit)
        if not big.limit(1).count():
            return _all(leaves)
        pick = lambda j: RUNS + 1 + F.pmod(F.xxhash64("bucket", F.lit(j)), F.lit(SPLITS)).cast("int")
        child = F.array(*[F.struct(F.lit(j).alias("j"), F.xxhash64("bucket", F.lit(j), F.element_at("path", pick(j))).alias("child")) for j in range(branches)])
        split = settle(big.join(texts.select("uid", "path"), "uid").select("uid", F.col("bucket").alias("parent"), F.col("size").alias("whole"), F.explode(child).alias("c")).select("uid", "parent", "whole", "c.j", F.col("c.child").alias("bucket")), "split")
        split = sized(split).withColumn("dense", F.col("size") * 2 >= F.col("whole"))
        split = settle(split, "split")
        # a text in dense children stays in the first of them and in no other child of that parent
        first = split.where("dense").groupBy("uid", "parent").agg(F.min("j").alias("keep"))
        kept = settle(split.join(first, ["uid", "parent"], "left"), "split")
        leaves.append(kept.where((F.col("dense")) & (F.col("j") == F.col("keep"))).select("uid", "bucket", "size"))
        now = kept.where(F.col("keep").isNull()).select("uid", "bucket", "size")
    return _all([*leaves, now.select("uid", "bucket", "size")])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _blocked(rows: DataFrame, limit: int) -> DataFrame:
    """Adds chunk and the block pairs (a <= b) that a row takes part in; one pair for groups up to ``limit``."""
    m = F.ceil(F.col("size") / limit)
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "uid"), m))
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    return cut.withColumn("other", pairs).withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")).drop("other", "size")


def _verified(threshold: float):
    by = ["cid", "a", "b"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _groups(it, by):
            cut = np.concatenate([np.flatnonzero(np.diff(_group_of(by, batch), prepend=-1)), [len(batch)]])
            for x, y in zip(cut[:-1], cut[1:]):
                pdf = batch.iloc[x:y].drop_duplicates("uid")
                h, n = shingles(pdf["text"].tolist())
                row = np.repeat(np.arange(len(pdf)), n)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
                h, row = h[new], row[new]
                size = np.bincount(row, minlength=len(pdf)).astype(np.float64)
                col = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                common = np.zeros((len(pdf), len(pdf)), np.float64)
                edges = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + 4097, 4096))
                for s, e in zip(edges[:-1], edges[1:]):
                    m = np.zeros((len(pdf), 4096), np.float32)
                    m[row[s:e], col[s:e] % 4096] = 1
                    common += m @ m.T
                link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
                np.fill_diagonal(link, False)
                if pdf["a"].iloc[0] != pdf["b"].iloc[0]:
                    chunk = pdf["chunk"].to_numpy()
                    link &= chunk[:, None] != chunk[None, :]
                i, j = np.nonzero(link)
                root = _roots(len(pdf), i, j)
                uid = pdf["uid"].to_numpy()
                yield pd.DataFrame({"uid": uid, "root": uid[root], "text_links": link.sum(1), "links": link @ pdf["copies"].to_numpy()})

    return run


def join(docs: DataFrame, threshold: float = 0.8, limit: int = 1000, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: rowid, id, text_id (smallest id with the same text), class_id (smallest id linked directly or not), n_links, n_text_links, first (whether the row stands for its class)."""
    return _joined(numbered(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], "rowid", "texts"), threshold, limit, least)


def _joined(src: DataFrame, threshold: float = 0.8, limit: int = 1000, least: float | None = None) -> DataFrame:
    """``join`` of ``src`` (rowid, id, text), whose row numbers are the same in every scan."""
    id_type = dict(src.dtypes)["id"]
    sig = settle(signatures(src, id_type), "signatures")
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("rowid").alias("rowid"))
    texts = settle(sig.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min(place).alias("rep"), F.first("n").alias("n"), F.first("path").alias("path"), F.first("sketch").alias("sketch"))
                   .withColumn("uid", F.monotonically_increasing_id()), "texts")

    def drawn() -> DataFrame:
        leaves = _blocked(settle(buckets(texts, limit), "leaves"), limit).join(texts.select("uid", "n", "sketch"), "uid")
        by = ["bucket", "a", "b"]
        near = leaves.select(*by, "chunk", "uid", "n", "sketch").repartition(*by).sortWithinPartitions(*by, "uid").mapInPandas(_sketched(least_of(threshold) if least is None else least, threshold), "a long, b long")
        return components(settle(near, "drawn"))

    groups = settled(src.sparkSession, "groups", drawn)
    size = settle(groups.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    chosen = settle(groups.join(size, "label").select(F.col("node").alias("uid"), F.col("label").alias("cid"), "size").join(texts.select("uid", "copies", "rep.rowid"), "uid"), "chosen")
    # grows with the documents: never broadcast, so that small inputs run the plan that large ones need
    whole = src.select("rowid", "text").join(chosen.hint("merge"), "rowid")
    by = ["cid", "a", "b"]
    checked = _blocked(whole, limit // 2).select(*by, "chunk", "uid", "copies", "text").repartition(*by).sortWithinPartitions(*by, "uid")
    links = settle(checked.mapInPandas(_verified(threshold), "uid long, root long, text_links long, links long"), "links")
    label = settled(src.sparkSession, "labels", lambda: components(links.select(F.col("uid").alias("a"), F.col("root").alias("b"))))
    degree = links.groupBy("uid").agg(F.sum("text_links").alias("text_links"), F.sum("links").alias("links"))
    result = texts.select("uid", "key", "copies", "rep").join(degree, "uid", "left").join(label.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    result = settle(result, "result")
    least_rep = settle(result.groupBy("label").agg(F.min("rep").alias("class")), "classes")
    known = settle(result.join(least_rep, "label").select("key", "copies", "rep", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links")), "known")
    out = settle(sig.select("rowid", "id", "key", (F.col("n") > 0).alias("has")), "rows").join(known, "key", "left")
    has = F.col("has")
    return out.select("rowid", "id", F.when(has, F.col("rep.id")).otherwise(F.col("id")).alias("text_id"), F.when(has, F.col("class.id")).otherwise(F.col("id")).alias("class_id"),
                      F.when(has, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(has, F.col("text_links")).otherwise(F.lit(0)).cast("long").alias("n_text_links"),
                      (~has | (F.col("rowid") == F.col("class.rowid"))).alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents, one of each class (the smallest id)."""
    held = numbered(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("row")], "rowid", "docs")
    src = held.select("rowid", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"))
    stay = settled(docs.sparkSession, "stay", lambda: _joined(src, **kw).where("first").select("rowid"))
    # grows with the documents: never broadcast, so that small inputs run the plan that large ones need
    return held.join(stay.hint("merge"), "rowid").select("row.*")
