"""Vector codes by product quantisation, with member-resident Lloyd rounds.

Vectors are cut into parts; the parts of a position share a codebook. An owner is a (position, entry, salt) and keeps the parts that are assigned
to its entry, as matrices, in the one partition that its key hashes to. A round works where members live: owners add up their members, the few sums make
the next codebook, every owner finds the entries of its members anew, and only parts whose entry changes move in the next shuffle. Stayers and arrivals have the
same partitioner, so their union moves nothing. Salts come with the batch that a part is read in and are as many as keep an owner at about
``owner_rows`` members, even if one entry held all parts. The driver sees codebooks and their sums: parts x entries x width numbers.

Rounds are deterministic functions of the stored input and of the codebooks, so lost partitions are computed again from shuffle files.

* vectors that are null or hold null or non-finite components take no part. Shorter vectors, and lengths that the parts do not divide, are padded with zeros.
* first entries: the vectors of the smallest ids (null ids last, ties by vector); fewer rows than entries: so many entries. Entries without members stay.
* repeated ids and rows stay separate rows; null labels are one group. Empty table, or no usable vector: empty result. Extra columns are ignored.
* all sums are exact; components whose squared distances could leave 64 bits are refused with an error.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle


def _place(owner: int) -> int:
    """Spreads neighbouring owners over the partitions."""
    return ((owner + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20


class Shape:
    """Sizes of a run, and the search for the nearest entry."""

    def __init__(self, parts: int, width: int, salts: int, exact: bool):
        self.parts, self.width, self.salts, self.exact = parts, width, salts, exact

    def nearest(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (the lowest of the nearest) and squared distance of each row."""
        if self.exact:      # every intermediate sum is below 2 ** 53
            f, b = x.astype(np.float64), book.astype(np.float64)
            d = ((b * b).sum(1) - 2 * (f @ b.T) + (f * f).sum(1)[:, None]).astype(np.int64)
        else:
            d = np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)
        entry = d.argmin(1)
        return entry, d[np.arange(len(d)), entry]

    def owner(self, position: int, entry: int, salt: int) -> int:
        return (position * 256 + entry) * self.salts + salt

    def of(self, owner: int) -> tuple[int, int, int]:
        return owner // self.salts // 256, owner // self.salts % 256, owner % self.salts

    def split(self, position: int, salt: int, uids: np.ndarray, x: np.ndarray, book: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        entry, _ = self.nearest(x, book)
        for e in np.unique(entry):
            at = entry == e
            yield self.owner(position, int(e), salt), (uids[at], x[at])


def _deal(shape: Shape, books: np.ndarray):
    """Parts of the vectors read, by owner: the first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            salt = (TaskContext.get().partitionId() * 7919 + number) % shape.salts
            uids, x = batch.column("uid").to_numpy(), _matrix(batch.column("v"), shape.parts * shape.width)
            out = [o for p in range(shape.parts) for o in shape.split(p, salt, uids, x[:, p * shape.width:(p + 1) * shape.width], books[p])]
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([u.tobytes() for _, (u, _) in out], pa.binary()),
                                              pa.array([np.ascontiguousarray(m).tobytes() for _, (_, m) in out], pa.binary())], ["owner", "uids", "m"])

    return run


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _members(blocks):
    """One block an owner: what stayed and what arrived."""
    found: dict[int, list] = {}
    for owner, block in blocks:
        found.setdefault(owner, []).append(block)
    for owner, parts in found.items():
        yield owner, parts[0] if len(parts) == 1 else (np.concatenate([u for u, _ in parts]), np.concatenate([x for _, x in parts]))


def _sums(shape: Shape, entries: int):
    """Members and component sums of each entry, over the owners of a partition."""

    def run(blocks):
        n, total = np.zeros((shape.parts, entries), object), np.zeros((shape.parts, entries, shape.width), object)
        for owner, (uids, x) in blocks:
            p, e, _ = shape.of(owner)
            n[p, e] += len(uids)
            total[p, e] += x.sum(0).astype(object)
        yield n, total

    return run


def _again(shape: Shape, books: np.ndarray, stay: bool):
    """Members whose entry stays, or those that move."""

    def run(blocks):
        for owner, (uids, x) in blocks:
            p, _, salt = shape.of(owner)
            for to, block in shape.split(p, salt, uids, x, books[p]):
                if (to == owner) == stay:
                    yield to, block

    return run


def _coded(shape: Shape, books: np.ndarray):
    def run(blocks):
        for owner, (uids, x) in blocks:
            p = shape.of(owner)[0]
            entry, error = shape.nearest(x, books[p])
            yield p, uids.tobytes(), entry.astype(np.int64).tobytes(), error.tobytes()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, *cols in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            uid, entry, error = (np.frombuffer(c, np.int64) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.full(len(uid), p, np.int32)), pa.array(entry), pa.array(error)], ["uid", "p", "entry", "error"])


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6,
             scale: float = 4096.0, owner_rows: int = 50_000) -> DataFrame:
    """One row per usable vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries must be 1 to 256, parts at least 1")
    spark = df.sparkSession
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = numbered(df, [F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x")], "uid", "vectors").where(fine)
    stat = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))).alias("most")).first()
    id_type = df.schema[id_col].dataType.simpleString()
    if not stat.n:
        return spark.createDataFrame([], f"vec_id {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    most, width = (stat.most or 0.0) * scale + 1, -(-stat.dim // parts)
    if 4 * most * most * max(stat.dim, 1) >= 2 ** 62:
        raise ValueError(f"components up to {stat.most} are too large for exact 64-bit distances")
    shape = Shape(parts, width, -(-stat.n // owner_rows), 4 * most * most * max(width, 1) < 2 ** 52)
    rows = rows.withColumn("v", F.transform("x", lambda c: F.floor(c * scale))).drop("x")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "uid").limit(entries).select("v").collect()
    seeds = np.array([[*r.v, *[0] * (parts * width - len(r.v))] for r in first], np.int64)
    books = seeds.reshape(len(first), parts, width).transpose(1, 0, 2)
    places = max(spark.sparkContext.defaultParallelism, -(-parts * stat.n // (4 * owner_rows)))
    dealt = rows.select("uid", "v").mapInArrow(_deal(shape, books), "owner long, uids binary, m binary").rdd
    blocks = dealt.map(lambda r, w=width: (r.owner, (np.frombuffer(r.uids, np.int64), np.frombuffer(r.m, np.int64).reshape(len(r.uids) // 8, w))))
    held = blocks.partitionBy(places, _place).mapPartitions(_members, True).persist(StorageLevel.MEMORY_AND_DISK)
    for number in range(rounds):
        n, total = held.mapPartitions(_sums(shape, len(first))).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        books = np.where((n > 0)[:, :, None], total // np.where(n > 0, n, 1)[:, :, None], books).astype(np.int64)
        if number + 1 < rounds:
            stay = held.mapPartitions(_again(shape, books, True), True)
            move = held.mapPartitions(_again(shape, books, False)).partitionBy(held.getNumPartitions(), _place)
            # held again only once the next round has read it
            before, held = held, stay.union(move).mapPartitions(_members, True).persist(StorageLevel.MEMORY_AND_DISK)
            held.foreachPartition(lambda blocks: None)
            before.unpersist()
    packed = spark.createDataFrame(held.mapPartitions(_coded(shape, books)), "p int, uids binary, entries binary, errors binary", verifySchema=False)
    coded = settle(packed.mapInArrow(_rows, "uid long, p int, entry long, error long"), "codes")
    held.unpersist()
    digits = F.transform(F.array_sort(F.collect_list(F.struct("p", "entry"))), lambda c: F.lower(F.lpad(F.hex(c["entry"]), 2, "0")))
    whole = coded.groupBy("uid").agg(F.array_join(digits, "").alias("code"), F.sum("error").alias("error"))
    found = settle(rows.select("uid", "vec_id", "label").join(whole, "uid"), "coded")
    labels = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return found.join(labels.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [f"""
v AS (SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT uid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) AS r(p)),
o AS (SELECT uid, row_number() OVER (ORDER BY vec_id NULLS LAST, v, uid) - 1 AS e FROM v),
c0 AS (SELECT x.p, o.e, x.x AS c FROM x JOIN o USING (uid) WHERE e < {entries})"""]
    gap = "list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT uid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.uid, x.p, c.e, coalesce({gap}, 0) AS d FROM x JOIN c{r} c ON x.p = c.p) GROUP BY uid, p)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.x) AS y, generate_subscripts(x.x, 1) AS i FROM a{r} a JOIN x ON a.uid = x.uid AND a.p = x.p) GROUP BY p, e, i)")
            steps.append(f"u{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY p, e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.c, b.c) AS c FROM c{r} b LEFT JOIN u{r} u USING (p, e))")
    return "WITH " + ",\n".join(steps) + f"""
, h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
w AS (SELECT uid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY uid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN w USING (uid), h
"""


SQL = _sql()
