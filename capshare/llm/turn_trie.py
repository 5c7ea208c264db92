"""Prefix tries of conversations: double arrays per shard of the sorted conversations, shared upper nodes merged globally.

A conversation is the sequence of its turns; a turn is 16 bytes that stand for role and text. Texts are hashed where they are read and never shuffled.
Conversations are range-partitioned in lexicographic order (ties by id), so a first turn, a prefix or a group of equal conversations spreads over
as many shards as it fills, and a node lies in several shards only if it is a prefix of the last sequence of one and the first of the next. A shard

* numbers its turns densely in the order in which a breadth-first walk meets them (siblings get neighbouring numbers),
* packs its trie into BASE and CHECK: the child of slot s by turn t is BASE[s] + t, if CHECK there is s,
* walks all its conversations through the arrays, level by level, which gives the members of each node, and sums subtrees from the lowest level up.

Each node is counted by the last shard that holds it. So all figures of a node add up over shards; only nodes shared between shards, at most two paths a shard,
are merged by the digest of their path, and nodes below them learn their parent's id from there. Ids that end at a shared node stream through its hash in order.

* order of turns: turn (null first), ties by the MD5 of role and text, repeated rows stay. Null role or text: empty. Rows with a null conv_id take no part.
* empty table: no node. Extra columns are ignored, whatever their names.
* A conversation is one row (28 bytes a turn), so one is limited to about 7 * 10^7 turns.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, settle

NODE = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), ("shard", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                  ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.binary()), ("ends_sha256", pa.string())])
SCHEMA = "key binary, parent_key binary, shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, ends_sha256 string"


def sequences(turns: DataFrame, base: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, base (the conversation whose first turns ``grafted`` may take), seq array<struct<key, n>> in the order of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(F.col(id_col).isNotNull()).select(base.cast("long").alias("base"), F.col(id_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), key.alias("key"), n_words(text).cast("int").alias("n")).alias("t"))
    packed = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("s"))
    return packed.select("base", "conv_id", F.transform("s", lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("seq"))


def grafted(found: DataFrame, head: Column, most: int = 3) -> DataFrame:
    """The first ``head`` (at most ``most``) turns of the base conversation, then the own turns behind as many. conv_id, seq."""
    of_base = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("seq", 1, most))).over(Window.partitionBy("base"))
    rows = found.withColumn("first", of_base).withColumn("h", F.least(head, F.lit(most)).cast("int"))
    front = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.slice("seq", 1, 0)), 1, F.greatest("h", F.lit(1)))).otherwise(F.slice("seq", 1, 0))
    return rows.select("conv_id", F.concat(front, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))).alias("seq"))


class DoubleArray:
    """BASE and CHECK over dense labels. A base may be negative; CHECK is -1 where a slot is free, and the root is slot 0."""

    def __init__(self):
        self.base, self.check, self.free = [0], [0], 1

    def _room(self, upto: int) -> None:
        if upto >= len(self.check):
            more = upto + 1 - len(self.check)
            self.check += [-1] * more
            self.base += [0] * more

    def _next_free(self) -> int:
        while self.free < len(self.check) and self.check[self.free] != -1:
            self.free += 1
        return self.free

    def place(self, parent: int, labels: list[int], tries: int = 16) -> list[int]:
        """Slots of the children by the ascending labels: the first gap that fits them all, or room at the end after some tries."""
        check, gaps = self.check, [x - labels[0] for x in labels]
        at = self._next_free()
        for _ in range(tries):
            if all(at + g >= len(check) or check[at + g] == -1 for g in gaps):
                break
            at += 1
            while at < len(check) and check[at] != -1:
                at += 1
        else:
            at = len(check)
        self._room(at + gaps[-1])
        self.base[parent] = at - labels[0]
        slots = [at + g for g in gaps]
        for s in slots:
            check[s] = parent
        return slots

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.base, np.int64), np.array(self.check, np.int64)


def pack(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the dense number of each id, from sequences (slices of ``ids``) in lexicographic order: level by level."""
    trie, dense, numbered = DoubleArray(), np.full(ids.max(initial=-1) + 1, -1, np.int64), 0
    rows, slot = np.arange(len(start)), np.zeros(len(start), np.int64)
    depth = 0
    while len(rows := rows[length[rows] > depth]):
        turn, parent = ids[start[rows] + depth], slot[rows]
        new = np.concatenate([[True], (turn[1:] != turn[:-1]) | (parent[1:] != parent[:-1])])
        unseen, first = np.unique(turn[new], return_index=True)
        unseen = unseen[np.argsort(first)]
        unseen = unseen[dense[unseen] < 0]
        dense[unseen] = np.arange(numbered, numbered + len(unseen))
        numbered += len(unseen)
        parents, labels = parent[new], dense[turn[new]]
        order = np.lexsort((labels, parents))
        cut = np.flatnonzero(np.concatenate([[True], parents[order][1:] != parents[order][:-1]]))
        ends = [*cut[1:].tolist(), len(order)]
        slots = np.empty(len(order), np.int64)
        by_parent, by_label = parents[order].tolist(), labels[order].tolist()
        for a, b in zip(cut.tolist(), ends, strict=True):
            slots[order[a:b]] = trie.place(by_parent[a], by_label[a:b])
        slot[rows] = slots[np.cumsum(new) - 1]
        depth += 1
    return *trie.arrays(), dense


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of one shard: those that no other shard holds with their own digest of ends, the others with what they add."""
    table = table.combine_chunks()
    conv = table.column("conv_id").to_numpy()
    keys = table.column("keys").combine_chunks()
    flat = keys.flatten().dictionary_encode()
    words = table.column("words").combine_chunks().flatten().to_numpy()
    length = keys.value_lengths().to_numpy().astype(np.int64)
    values = flat.dictionary.to_pylist()
    rank = np.empty(len(values), np.int64)
    rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    ids = rank[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    values.sort()
    begin = np.cumsum(length) - length
    raw = ids.astype(">u4").tobytes()
    order = np.array(sorted(range(len(conv)), key=lambda i: (raw[4 * begin[i]:4 * (begin[i] + length[i])], conv[i])))
    conv, length, begin = conv[order], length[order], begin[order]
    base, check, dense = pack(ids, begin, length)
    label = dense[ids]
    # members walk the arrays
    size = len(check)
    n, least, weight = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    state, rows, levels = np.zeros(len(conv), np.int64), np.arange(len(conv)), []
    n[0], least[0] = len(conv), conv.min()
    while len(rows := rows[length[rows] > len(levels)]):
        at = begin[rows] + len(levels)
        to = base[state[rows]] + label[at]
        if (check[to] != state[rows]).any():
            raise AssertionError("a conversation left the trie")
        n += np.bincount(to, minlength=size)
        np.minimum.at(least, to, conv[rows])
        weight[to] = words[at]
        state[rows] = to
        levels.append(np.unique(to))
    first, last = (_path(base, label[begin[i]:begin[i] + length[i]]) for i in (0, -1))
    before, after = table.column("before")[0].as_py(), table.column("after")[0].as_py()
    owned = np.ones(size, bool)
    owned[last[:after + 1]] = False
    shared = np.zeros(size, bool)
    shared[first[:before + 1]] = shared[last[:after + 1]] = True
    # figures of subtrees: what the members would read, less each node once
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), n * weight - owned * weight
    local = np.zeros(size, bool)
    for slots in reversed(levels):
        leaves[slots] += owned[slots] & ~local[slots]
        parents = check[slots]
        local[parents] = True
        np.add.at(children, parents, owned[slots].astype(np.int64))
        np.add.at(leaves, parents, leaves[slots])
        np.add.at(saved, parents, saved[slots])
    leaves[0] += owned[0] and not local[0]
    digests = {}
    for path, upto, i in ((first, before, 0), (last, after, -1)):
        digest = b""
        for d, s in enumerate(path[:upto + 1]):
            digest = hashlib.md5(digest + (values[ids[begin[i] + d - 1]] if d else b"")).digest()
            digests[int(s)] = digest
    ends: dict[int, list[str]] = {}
    for s, c in zip(state.tolist(), conv.tolist(), strict=True):
        ends.setdefault(s, []).append(str(c))
    slots = np.concatenate([[0], *levels]).astype(np.int64)
    depth = np.repeat(np.arange(len(levels) + 1), [1, *map(len, levels)])
    joined = [",".join(ends.get(s, ())).encode() for s in slots.tolist()]
    is_shared = shared[slots]
    up = check[slots]
    lone = ~is_shared & (slots != 0) & ~shared[up]       # neither the node nor its parent is shared
    null = lambda x, keep: pa.array(x, pa.int64(), mask=~keep)
    shards = np.full(len(slots), table.column("shard")[0].as_py())
    return pa.Table.from_arrays([
        pa.array([digests.get(s) for s in slots.tolist()], pa.binary()), pa.array([digests.get(p) if s else None for s, p in zip(slots.tolist(), up.tolist(), strict=True)], pa.binary()), pa.array(shards, pa.int64()),
        pa.array(least[slots]), pa.array(depth, pa.int64()), null(least[up], lone), pa.array(n[slots]), pa.array(children[slots]), pa.array(leaves[slots]), pa.array(saved[slots]),
        pa.array([j if s and j else None for j, s in zip(joined, is_shared.tolist(), strict=True)], pa.binary()),
        pa.array([None if s else hashlib.sha256(j).hexdigest() for j, s in zip(joined, is_shared.tolist(), strict=True)], pa.string())], schema=NODE)


def _path(base: np.ndarray, labels: np.ndarray) -> np.ndarray:
    out = [0]
    for x in labels.tolist():
        out.append(int(base[out[-1]]) + x)
    return np.array(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ends of each key; chunks come sorted by key and shard, and none is kept."""
    key, digest = None, None
    make = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        for k, chunk in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    yield make()
                key, digest = k, hashlib.sha256(chunk)
            else:
                digest.update(b"," + chunk)
    if digest is not None:
        yield make()


def trie(found: DataFrame, shard_turns: int = 500_000) -> DataFrame:
    """One row per node of the trie of (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = found.sparkSession
    rows = settle(found.select("conv_id", F.transform("seq", lambda t: t["key"]).alias("keys"), F.transform("seq", lambda t: t["n"]).alias("words")), "sequences")
    turns = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(1, -(-turns // shard_turns), min(4 * spark.sparkContext.defaultParallelism, turns // 2000))
    dealt = settle(rows.repartitionByRange(shards, "keys", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")), "shards")
    ends = dealt.groupBy("shard").agg(F.min(F.struct("keys", "conv_id"))["keys"].alias("lo"), F.max(F.struct("keys", "conv_id"))["keys"].alias("hi"))
    by_shard = Window.orderBy("shard")      # one row a shard
    same = lambda a, b: F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    common = lambda a, b: F.when(F.array_contains(same(a, b), False), F.array_position(same(a, b), False) - 1).otherwise(F.size(a))
    near = ends.select("shard", "lo", "hi", F.lead("lo").over(by_shard).alias("next"), F.lag("hi").over(by_shard).alias("previous"))
    # turns of the first sequence shared with the shard before, of the last with the shard after; -1: there is none
    marks = near.select("shard", *[F.when(other.isNull(), F.lit(-1)).otherwise(common(other, own)).cast("long").alias(name) for name, other, own in (
        ("before", F.col("previous"), F.col("lo")), ("after", F.col("next"), F.col("hi")))])
    nodes = settle(dealt.join(F.broadcast(marks), "shard").groupBy("shard").applyInArrow(_shard, SCHEMA), "nodes")
    shared, alone = nodes.where(F.col("key").isNotNull()), nodes.where(F.col("key").isNull())
    digest = shared.where(F.col("ends").isNotNull()).select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hashed, "key binary, ends_sha256 string")
    add = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shared.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *add)
    merged = settle(merged.join(digest, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "merged")
    own = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = alone.where(F.col("parent_key").isNotNull()).select("parent_key", *own).unionByName(merged.select("parent_key", *own))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole = ["conv_id", "depth", "parent_conv_id", *own[2:]]
    return alone.where(F.col("parent_key").isNull()).select(whole).unionByName(below.join(parents, "parent_key", "left").select(whole))


#: CRC-32 of the decimal id: -1 in the list is one shift of the register
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

SQL = f"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(n ORDER BY turn NULLS FIRST, k) AS ns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ks, ns, conv_id - conv_id % 20 AS base, CAST({_CRC} % 4 AS BIGINT) AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ks, [])[1:h.h], h.ks[h.h + 1:]) AS ks, list_concat(coalesce(b.ns, [])[1:h.h], h.ns[h.h + 1:]) AS ns FROM h LEFT JOIN s b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(ks) AS size, unnest(range(0, len(ks) + 1)) AS depth, ks, ns FROM r),
q AS (SELECT conv_id, size, depth, array_to_string(ks[1:depth], '') AS path, CASE WHEN depth > 0 THEN ns[depth] ELSE 0 END AS n FROM p),
m AS (SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(n) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends FROM q GROUP BY path),
c AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY 1),
f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN c USING (path)),
u AS (SELECT left(path, 32 * e) AS path, n_children, (n_convs - 1) * n AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM f)),
a AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN a USING (path) LEFT JOIN m o ON f.depth > 0 AND o.path = left(f.path, 32 * (f.depth - 1))
"""
