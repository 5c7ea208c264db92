"""Removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if it is covered by a string of ``length`` bytes that also starts elsewhere, in this or another text. Every such string
holds a winnowed anchor (the least hash of its ``gram``-byte grams, leftmost), the same one in all its copies; so the surroundings of
all anchors with one hash are brought together, equal surroundings once with their count, and sorted by suffix.

``suffix_array`` is the linear grouping construction: suffixes are grouped by first symbol; groups are processed in descending order, every suffix
finds its previous suffix in a lower group, and those predecessors are split off into higher groups by how often the group follows
them, which leaves the groups of equal Lyndon prefixes; one ascending pass then emits the order of each group without renaming. Matches count only at equal
distance to the anchor, so an occurrence never meets itself, and symbols are blocks of bytes counted from the anchor; strings that start inside a
symbol are matched through the suffix at its end and the bytes before it.

* null or empty text, or shorter than ``length``: nothing to remove. Equal texts of ``length`` bytes or more go whole, all of them.
* repeated rows are texts of their own. Texts of any length are handled; extra columns are ignored; null ids pass. An empty table gives an empty table.
* a hash with more than ``limit`` distinct surroundings is settled exactly by counting its strings one by one, in an aggregation.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_of, numbered, release, settle, settled
from .jaccard_join import _groups, _mixed, _powers

_rng = np.random.default_rng(77)
_TABLE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
LOW = (1 << 24) - 1
PART = 8 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``, whose last symbol must be smaller than all others."""
    n = len(text)
    lists: list[list[int]] = []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    group = [0] * n
    for c in sorted(first):
        for i in first[c]:
            group[i] = len(lists)
        lists.append(first[c])
    length = [1] * len(lists)
    lower, upper = list(range(-1, len(lists) - 1)), [*range(1, len(lists)), -1]
    before, done = [-1] * n, bytearray(n)
    g = len(lists) - 1
    while g >= 0:
        members = [i for i in lists[g] if group[i] == g]
        lists[g] = members
        follows: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            done[i] = 1
            if j >= 0:
                follows[j] = follows.get(j, 0) + 1
        if follows:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in follows.items():
                split.setdefault((group[p], k), []).append(p)
            # the more often the group follows, the higher: the last inserted stands right above its old group
            for old, k in sorted(split, reverse=True) if len(split) > 1 else split:
                new, u = len(lists), upper[old]
                moved = split[old, k]
                lists.append(moved)
                length.append(length[old] + k * length[g])
                lower.append(old)
                upper.append(u)
                upper[old] = new
                if u >= 0:
                    lower[u] = new
                for p in moved:
                    group[p] = new
        g = lower[g]
    g, at, place = 0, 0, [0] * len(lists)
    while g >= 0:
        place[g] = at
        at += len(lists[g])
        g = upper[g]
    order = [0] * n
    order[0] = n - 1
    place[group[n - 1]] += 1
    for s in map(order.__getitem__, range(n)):
        j = s - 1
        while j >= 0 and j + length[group[j]] == s:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            j = before[j]
    return order


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed anchors of all strings of ``length`` bytes."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) > PART:
        parts = [anchors(data[a:a + PART + length - 1], length, gram) for a in range(0, len(data) - length + 1, PART)]
        pos = np.concatenate([p + i * PART for i, (p, _) in enumerate(parts)])
        pos, keep = np.unique(pos, return_index=True)
        return pos, np.concatenate([h for _, h in parts])[keep]
    buf = np.frombuffer(data, np.uint8)
    if _cached[0] < len(buf) + 1:
        _cached[:] = [2 * len(buf) + 1, _powers(2 * len(buf) + 1)]
    up, down = _cached[1]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * up[:len(buf)], dtype=np.uint64)])
    h = _mixed((total[gram:] - total[:-gram]) * down[:len(buf) - gram + 1])
    v = (h & ~np.uint64(LOW)) | np.arange(len(h), dtype=np.uint64)
    w = length - gram + 1
    pad = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:len(v)] = v
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:len(v) - w + 1], ahead[w - 1:len(v)])
    pos = np.unique((least & np.uint64(LOW)).astype(np.int64))
    return pos, h[pos].view(np.int64)


_cached: list = [0, None]


def _scan(length: int, gram: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), 200):
                out = []
                for rowid, text in zip(pdf["rowid"].iloc[a:a + 200], pdf["text"].iloc[a:a + 200]):
                    data = (text or "").encode("utf-8")
                    pos, h = anchors(data, length, gram)
                    out.append((rowid, pos.astype(np.int32), h))
                yield pd.DataFrame(out, columns=["rowid", "at", "h"])

    return run


def _surroundings(length: int, gram: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), 100):
                out = []
                part = pdf.iloc[a:a + 100]
                for rowid, text, at, copies in zip(part["rowid"], part["text"], part["anchors"], part["copies"]):
                    data = (text or "").encode("utf-8")
                    for x in at:
                        p = x["p"]
                        lo = max(0, p - length + gram)
                        region = data[lo:p + length]
                        out.append((rowid, p, x["h"], hashlib.md5(region + (p - lo).to_bytes(4, "little")).digest(), p - lo, region, copies))
                yield pd.DataFrame(out, columns=["rowid", "p", "h", "rkey", "off", "region", "copies"])

    return run


def _blocks(sizes: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Region and start of every symbol: runs of ``width`` bytes counted from the anchor, the last one of a region cut short. Matches lie at equal
    distance to the anchor, so all occurrences of a string are cut alike, whatever their bytes are."""
    first = offs % width
    counts = np.maximum(-(-(sizes - first) // width), 0)
    number = np.repeat(np.arange(len(sizes)), counts)
    return number, first[number] + width * (np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts))


def repeated_starts(groups: np.ndarray, regions: list[bytes], offs: np.ndarray, length: int, width: int = 32) -> list[np.ndarray]:
    """For each region, the places where a string of ``length`` bytes starts that another region of its group has at the same distance to the anchor."""
    k = len(regions)
    sizes = np.array([len(r) for r in regions], np.int64)
    flat = np.frombuffer(b"".join(regions) + bytes(2 * length), np.uint8)
    base = np.cumsum(sizes) - sizes
    number, begin = _blocks(sizes, offs, width)
    if not len(number):
        return [np.empty(0, np.int64)] * k
    place, room = base[number] + begin, np.minimum(sizes[number] - begin, length)
    # a symbol is its group, its place relative to the anchor and its bytes; one that its region cuts short stands before those that go on with zeros
    step, held = np.arange(width), np.minimum(sizes[number] - begin, width)
    body = np.where(step < held[:, None], flat[place[:, None] + step], 0).astype(np.uint8)
    block = ((begin - offs[number]) // width + (1 << 15)).astype(">u2").view(np.uint8).reshape(-1, 2)
    name = np.concatenate([groups[number].astype(">u8").view(np.uint8).reshape(-1, 8), block, body, held.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    _, rank = np.unique(np.ascontiguousarray(name).view(f"S{width + 12}").ravel(), return_inverse=True)
    # region ends are symbols of their own, below all others, the last one lowest
    text, where = np.empty(len(number) + k, np.int64), np.full(len(number) + k, -1)
    text[np.cumsum(np.bincount(number, minlength=k)) + np.arange(k)] = k - 1 - np.arange(k)
    text[np.arange(len(number)) + number] = rank + k
    where[np.arange(len(number)) + number] = np.arange(len(number))
    order = where[suffix_array(text.tolist())]
    order = order[order >= 0]
    x, y = order[:-1], order[1:]
    common = np.zeros(len(x), np.int64)
    alike = np.flatnonzero(rank[x] == rank[y])
    step = np.arange(length)
    for a in range(0, len(alike), 4096):
        i = alike[a:a + 4096]
        differ = flat[place[x[i]][:, None] + step] != flat[place[y[i]][:, None] + step]
        common[i] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, np.minimum(room[x], room[y]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[flat[:sizes.sum()]] * _up(int(sizes.sum()))[0], dtype=np.uint64)])
    down = _up(int(sizes.sum()))[1]
    # a string that starts d bytes before a symbol: equal suffixes are neighbours, the d bytes are compared by hash; one that starts behind its anchor is judged at its own
    back, near = np.minimum(width, begin + 1)[order], (begin - offs[number])[order]
    best = np.maximum(np.append(common, 0), np.append(0, common))
    found_n, found_s = [], []
    for d in range(width):
        live = np.flatnonzero((back > d) & (best >= length - d) & (near <= d))
        if not len(live):
            continue
        run = np.concatenate([[0], np.cumsum(common < length - d)])[live]
        s = order[live]
        head = (total[place[s]] - total[place[s] - d]) * down[place[s] - d]
        _, at, n = np.unique(_mixed(run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(head)), return_inverse=True, return_counts=True)
        hit = s[n[at] > 1]
        found_n.append(number[hit])
        found_s.append(begin[hit] - d)
    if not found_n:
        return [np.empty(0, np.int64)] * k
    fn, fs = np.concatenate(found_n), np.concatenate(found_s)
    o = np.lexsort((fs, fn))
    return np.split(fs[o], np.searchsorted(fn[o], np.arange(1, k)))


def _up(n: int):
    if _cached[0] < n + 1:
        _cached[:] = [2 * n + 1, _powers(2 * n + 1)]
    return _cached[1][0][:n], _cached[1][1]


def _spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Merged [a, b) of the strings at ascending starts, as rows."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    new = np.concatenate([[True], starts[1:] > np.maximum.accumulate(starts)[:-1] + length])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return np.stack([starts[first], starts[last] + length], axis=1)


def _shared(group: np.ndarray, sides: list[bytes], most: int) -> np.ndarray:
    """Longest prefix that each byte string shares with another of its group, up to ``most``."""
    n = len(sides)
    size = np.array([len(x) for x in sides])
    flat = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in sides), np.uint8).reshape(n, most)
    # the shorter first where only zeros are added, or it would part two that share zeros of their own
    keys = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), flat, size.astype(">u4").view(np.uint8).reshape(n, 4)], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{most + 12}").ravel(), kind="stable")
    best = np.zeros(n, np.int64)
    for a in range(0, n - 1, 8192):
        x, y = order[a:a + 8192][:n - 1 - a], order[a + 1:a + 8193]
        differ = flat[x] != flat[y]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        common = np.where(group[x] == group[y], np.minimum(common, np.minimum(size[x], size[y])), 0)
        np.maximum.at(best, x, common)
        np.maximum.at(best, y, common)
    return best


def _trimmed(group: np.ndarray, regions: list[bytes], offs: np.ndarray, copies: np.ndarray, length: int, gram: int, most: int = 2 << 20) -> list[np.ndarray]:
    """Spans per region of the groups. What a region shares with no other of its group on either side of the anchor is cut off first, and
    what is then equal becomes one: no repeated string is lost, since it lies in the shared part of all its occurrences."""
    side = length - gram
    left = _shared(group, [r[max(0, o - side):o][::-1] for r, o in zip(regions, offs.tolist())], side)
    right = _shared(group, [r[o + gram:o + length] for r, o in zip(regions, offs.tolist())], side)
    out: list = [np.empty((0, 2), np.int64)] * len(regions)
    number: dict[tuple[int, int, bytes], int] = {}
    users: list[list[int]] = []
    for i in np.flatnonzero(left + right + gram >= length).tolist():
        lo, hi = int(offs[i] - left[i]), int(offs[i] + gram + right[i])
        k = number.setdefault((int(group[i]), int(left[i]), regions[i][lo:hi]), len(users))
        if k == len(users):
            users.append([])
        users[k].append(i)
    keys = list(number)
    groups = np.array([k[0] for k in keys], np.int64)
    own = [np.array([[0, len(k[2])]]) if len(u) > 1 or copies[u[0]] > 1 else np.empty((0, 2), np.int64) for k, u in zip(keys, users)]
    # groups of several, some of them not settled yet, as many at a time as make ``most`` bytes
    whole = np.array([len(x) > 0 for x in own], bool)
    several = np.flatnonzero((np.bincount(groups)[groups] > 1) & (np.bincount(groups, ~whole)[groups] > 0)) if len(keys) else np.empty(0, np.int64)
    total = np.cumsum([len(keys[i][2]) for i in several.tolist()])
    cuts, start = np.flatnonzero(np.diff(groups[several], append=-1)) + 1, 0
    while start < len(several):
        ends = cuts[cuts > start]
        end = int(ends[max(np.searchsorted(total[ends - 1], most + (total[start - 1] if start else 0), "right") - 1, 0)])
        part, start = several[start:end], end
        found = repeated_starts(groups[part], [keys[i][2] for i in part.tolist()], np.array([keys[i][1] for i in part.tolist()]), length)
        for i, s in zip(part.tolist(), found):
            if not whole[i]:
                own[i] = _spans(s, length)
    for k, u, spans in zip(keys, users, own):
        for i in u:
            out[i] = spans + (offs[i] - k[1])
    return out


def _matched(length: int, gram: int, batch: int = 8192):
    """Rows sorted by h: per distinct surrounding the spans that repeat, relative to its anchor."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        h, offs, regions, copies = pdf["h"].to_numpy(), pdf["off"].to_numpy(), list(pdf["region"]), pdf["copies"].to_numpy()
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        several = np.bincount(group)[group] > 1
        out: list = [np.empty((0, 2), np.int64)] * len(pdf)
        idx = np.flatnonzero(several)
        if len(idx):
            for i, s in zip(idx, _trimmed(group[idx], [regions[i] for i in idx], offs[idx], copies[idx], length, gram)):
                out[i] = s
        for i in np.flatnonzero(copies > 1):
            if len(regions[i]) >= length:
                out[i] = np.array([[0, len(regions[i])]])
        out = [o - offs[i] for i, o in enumerate(out)]
        keep = [i for i, o in enumerate(out) if len(o)]
        return pd.DataFrame({"h": h[keep], "rkey": pdf["rkey"].to_numpy()[keep], "lo": [out[i][:, 0].astype(np.int32) for i in keep], "hi": [out[i][:, 1].astype(np.int32) for i in keep]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in _groups(it, ["h"]):
            # whole groups, about ``batch`` rows at a time
            h = pdf["h"].to_numpy()
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            start = 0
            while start < len(h):
                fit = max(int(np.searchsorted(ends, start + batch - size, "right")) - 1, int(np.searchsorted(ends, start, "right")))
                held.append(pdf.iloc[start:ends[fit]])
                size, start = size + int(ends[fit]) - start, int(ends[fit])
                if size >= batch or start < len(h):
                    yield solve(pd.concat(held))
                    held, size = [], 0
        if held:
            yield solve(pd.concat(held))

    return run


def _counted(length: int):
    """Every string of a hot anchor: its hash, and where it is."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for h, rkey, off, region, copies in zip(pdf["h"], pdf["rkey"], pdf["off"], pdf["region"], pdf["copies"]):
                s = range(min(off, len(region) - length) + 1)
                yield pd.DataFrame({"h": h, "rkey": [rkey] * len(s), "rel": [x - off for x in s], "s": [hashlib.md5(region[x:x + length]).digest() for x in s], "copies": copies})

    return run


def repeats(docs: DataFrame, length: int = 200, gram: int = 32, limit: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: rowid, id, text, whole (goes altogether), spans (arrays lo, hi of places that repeat, overlapping)."""
    spark = docs.sparkSession
    src = numbered(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], "rowid", "texts")

    def standing() -> DataFrame:
        """One row for each distinct text stands for all; the others of long equal texts go whole."""
        keys = settle(src.select("rowid", key_of(F.col("text")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes")), "keys")
        many = settle(keys.groupBy("key").agg(F.count("*").alias("copies"), F.min("rowid").alias("rep")).where("copies > 1"), "copies")
        return keys.join(many, "key", "left").select("rowid", F.coalesce("copies", F.lit(1)).alias("copies"), (F.col("rep").isNull() | (F.col("rep") == F.col("rowid"))).alias("stands"),
                                                     ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("whole"))

    def around() -> DataFrame:
        """The surroundings of every anchor whose hash is found again."""
        scan = src.select("rowid", "text").mapInPandas(_scan(length, gram), "rowid long, at array<int>, h array<long>")
        grams = scan.join(marked.where("stands").select("rowid", "copies"), "rowid").select("rowid", "copies", F.explode(F.arrays_zip("at", "h")).alias("x"))
        grams = settle(grams.select("rowid", "copies", F.col("x.at").alias("p"), F.col("x.h").alias("h")), "grams")
        again = settle(grams.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h"), "again")
        release(spark)
        by_text = grams.join(again, "h").groupBy("rowid", "copies").agg(F.collect_list(F.struct("p", "h")).alias("anchors"))
        return src.select("rowid", "text").join(by_text, "rowid").mapInPandas(_surroundings(length, gram), "rowid long, p int, h long, rkey binary, off int, region binary, copies long")

    def found() -> DataFrame:
        """The spans of each row that has any; surroundings and all that is settled from them go when it is written."""
        placed = settled(spark, "surroundings", around)
        release(spark)
        distinct = settle(placed.groupBy("h", "rkey").agg(F.sum("copies").alias("copies"), F.first("off").alias("off"), F.first("region").alias("region")), "distinct")
        release(spark)
        sizes = settle(distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit), "hot")
        shape = "h long, rkey binary, lo array<int>, hi array<int>"
        if sizes.limit(1).count():
            hot = distinct.join(sizes.select("h"), "h")
            strings = hot.mapInPandas(_counted(length), "h long, rkey binary, rel int, s binary, copies long")
            twice = settle(strings.groupBy("h", "rel", "s").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"), "twice")
            exact = strings.join(twice, ["h", "rel", "s"]).groupBy("h", "rkey").agg(F.array_sort(F.collect_list("rel")).alias("lo")).select("h", "rkey", "lo", F.transform("lo", lambda x: x + length).alias("hi"))
            distinct = distinct.join(sizes.select("h"), "h", "left_anti")
        else:
            exact = None
        spans = distinct.repartition("h").sortWithinPartitions("h").mapInPandas(_matched(length, gram), shape)
        spans = settle(spans if exact is None else spans.union(exact), "spans")
        release(spark)
        plus = lambda c: F.transform(c, lambda x: x + F.col("p"))
        single = placed.where("copies = 1").select("rowid", "p", "h", "rkey").join(spans, ["h", "rkey"]).select("rowid", plus("lo").alias("lo"), plus("hi").alias("hi"))
        return single.groupBy("rowid").agg(F.flatten(F.collect_list(F.arrays_zip("lo", "hi"))).alias("spans"))

    marked = settled(spark, "marked", standing)
    per_row = settled(spark, "rows", found)
    release(spark)
    info = marked.select("rowid", "whole").join(per_row, "rowid", "left")
    return src.join(info, "rowid")


def dedup(docs: DataFrame, length: int = 200, **kw) -> DataFrame:
    """Per row: id, n_bytes, n_removed, spans (merged removed [lo, hi)), kept (bytes that are left)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), 200):
                part, out = pdf.iloc[a:a + 200], []
                for id_, text, whole, spans in zip(part["id"], part["text"], part["whole"], part["spans"]):
                    data = (text or "").encode("utf-8")
                    merged: list[list[int]] = []
                    for lo, hi in [(0, len(data))] if whole and data else sorted((s["lo"], s["hi"]) for s in spans) if spans is not None else []:
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(hi, merged[-1][1])
                        else:
                            merged.append([lo, hi])
                    cuts = [0, *[x for m in merged for x in m], len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                    out.append((id_, len(data), len(data) - len(kept), [{"lo": x, "hi": y} for x, y in merged], kept))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept"]).astype({"id": object})

    id_type = dict(docs.dtypes)[kw.get("id_col", "doc_id")]
    rows = repeats(docs, length, **kw)
    return rows.select(F.col("id").cast("string").alias("id"), "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans").mapInPandas(
        run, "id string, n_bytes long, n_removed long, spans array<struct<lo long, hi long>>, kept binary").withColumn("id", F.col("id").cast(id_type))
