"""The ring walked row by row: first token clockwise with room, overflow after all rows that fit at home."""
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from capshare.llm import sharding


@pytest.mark.parametrize("hot", [0, 150])
def test_sharding_equals_a_walk_row_by_row(spark, hot):
    shards, vnodes, cells = 7, 5, 64
    rows = [(i, None if i % 11 == 0 else "é" * (i % 40), "x") for i in range(300)] + [(3, "same", "y")] * hot + [(None, "no id", "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, uid string").repartition(4)     # an extra column with a name used inside
    got = sharding.shard(docs, shards, vnodes, cells, chunk=20).collect()
    ids = {r.doc_id: r.cell for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("row"), "doc_id"), F.lit(cells)).alias("cell")).distinct().collect()}
    tokens = sharding.ring(spark, shards, vnodes, cells)
    n = len(rows)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    want, late = Counter(), []
    for cell in sorted(ids[r[0]] for r in rows):
        home = next((k for k, (place, _) in enumerate(tokens) if place >= cell), 0)
        if room[tokens[home][1]]:
            room[tokens[home][1]] -= 1
            want[cell, tokens[home][1]] += 1
        else:
            late.append((cell, home))
    for cell, at in late:
        while not room[tokens[at][1]]:
            at = (at + 1) % len(tokens)
        room[tokens[at][1]] -= 1
        want[cell, tokens[at][1]] += 1
    assert not any(room) and late
    assert Counter((ids[r.id], r.shard) for r in got) == want
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n // shards + (s < n % shards)))
    size = lambda t: (16 + len((t or "").encode()), zlib.crc32((t or "").encode()))
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, *size(t)) for i, t, _ in rows)
