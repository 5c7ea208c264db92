"""First-in-first-out replay with deadline drops: what a stream of budgets would have served, dropped and left waiting.

Per key and slot: arrivals join at age 0, service takes the oldest first up to the slot's allowance, what is left at age D is
dropped, ages shift by one.  The state is D + 1 counters.

A key's series is cut into chunks that are replayed in parallel.  Each round replays the chunks whose starting state has
changed (at first all of them, from empty), then hands every chunk's final state to its successor; the loop ends when nothing
changes.  Busy periods are short, so a few rounds settle all chunks, and the result is exact whatever the number of rounds.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import col
from ..session import shared_dir

OUT = ("struct<served:array<double>,violated:array<double>,queue:array<double>,hol:array<bigint>,"
       "hist:array<double>,final:array<double>>")


def allowance(budget, unit, efficiency, max_units) -> Column:
    """User bits that a budget can carry in one slot: whole units, capped by the air interface."""
    return F.least(col(max_units), F.floor(col(budget) / col(unit))) * col(efficiency)


def step(state: np.ndarray, arrived: np.ndarray, allowed: np.ndarray, deadline: np.ndarray):
    """One slot for many keys at once. ``state`` is keys x (Dmax + 1), index = age."""
    state = state.copy()
    state[:, 0] += arrived
    # oldest first: what older ages leave over of the allowance
    older = np.cumsum(state[:, ::-1], axis=1)[:, ::-1] - state
    taken = np.clip(allowed[:, None] - older, 0.0, state)
    state -= taken
    rows = np.arange(len(state))
    dropped = state[rows, deadline].copy()
    shifted = np.zeros_like(state)
    shifted[:, 1:] = state[:, :-1]
    shifted[np.arange(state.shape[1])[None, :] > deadline[:, None]] = 0.0
    return shifted, taken, dropped


def _replay(arrivals: pd.Series, allowed: pd.Series, deadline: pd.Series, start: pd.Series) -> pd.DataFrame:
    n, d = len(arrivals), deadline.to_numpy().astype(int)
    sizes = np.array([len(a) for a in arrivals])
    width, ages = int(sizes.max(initial=0)), int(d.max(initial=0)) + 1
    a, s = np.zeros((n, width)), np.zeros((n, width))
    state = np.zeros((n, ages))
    for i, (x, y, z) in enumerate(zip(arrivals, allowed, start)):
        a[i, :len(x)], s[i, :len(y)] = x, y
        if z is not None:
            state[i, :len(z)] = z
    served, violated, queue = (np.zeros((n, width)) for _ in range(3))
    hol = np.zeros((n, width), dtype=np.int64)
    hist, final = np.zeros((n, ages)), state.copy()
    for t in range(width):
        live = sizes > t
        state, taken, dropped = step(state, a[:, t], s[:, t], d)
        served[:, t], violated[:, t], queue[:, t] = taken.sum(1), dropped, state.sum(1)
        waiting = state > 0
        hol[:, t] = np.where(waiting.any(1), ages - 1 - waiting[:, ::-1].argmax(1), 0)
        hist[live] += taken[live]
        final[live] = state[live]
    return pd.DataFrame({"served": [served[i, :k] for i, k in enumerate(sizes)], "violated": [violated[i, :k] for i, k in enumerate(sizes)],
                         "queue": [queue[i, :k] for i, k in enumerate(sizes)], "hol": [hol[i, :k] for i, k in enumerate(sizes)],
                         "hist": [hist[i, :d[i] + 1] for i in range(n)], "final": [final[i, :d[i] + 1] for i in range(n)]})


def replay_kernel(arrivals, allowed, deadline, start) -> Column:
    return F.pandas_udf(_replay, OUT)(col(arrivals), col(allowed), col(deadline), col(start))


def packed(slots: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    return (slots.withColumn("chunk", F.floor(F.col("slot") / chunk).cast("bigint")).groupBy(*keys, "chunk")
            .agg(F.first("deadline").alias("deadline"), F.sort_array(F.collect_list(F.struct("slot", "arrived", "allowed"))).alias("rows"))
            .select(*keys, "chunk", "deadline", F.col("rows.slot").alias("slots"), F.col("rows.arrived").cast("array<double>").alias("a"),
                    F.col("rows.allowed").cast("array<double>").alias("s")))


def replay(slots: DataFrame, keys: Sequence[str], n_slots: int, chunk: int = 4096) -> DataFrame:
    """(keys, chunk, deadline, slots, out) for rows (keys, slot, deadline, arrived, allowed) of dense series."""
    p = packed(slots, keys, chunk)
    if math.ceil(n_slots / chunk) <= 1:
        return p.withColumn("out", replay_kernel("a", "s", "deadline", F.array().cast("array<double>"))).drop("a", "s")
    shared_dir(slots.sparkSession)
    p = p.checkpoint()
    empty = F.array().cast("array<double>")
    done = p.select(*keys, "chunk", empty.alias("start"), replay_kernel("a", "s", "deadline", empty)["final"].alias("final")).checkpoint()
    while True:
        before = F.lag("final").over(W.partitionBy(*keys).orderBy("chunk"))
        nxt = done.withColumn("want", F.coalesce(before, empty)).withColumn(
            "stale", F.filter("want", lambda x: x != 0) != F.filter("start", lambda x: x != 0))
        nxt = nxt.withColumn("stale", F.col("stale") | ((F.size("start") > 0) & (F.col("want") != F.col("start"))))
        todo = nxt.where("stale").select(*keys, "chunk", F.col("want").alias("start"))
        if todo.isEmpty():
            break
        redo = p.join(todo, [*keys, "chunk"]).select(*keys, "chunk", "start", replay_kernel("a", "s", "deadline", "start")["final"].alias("final"))
        done = nxt.where("not stale").select(*keys, "chunk", "start", "final").unionByName(redo).checkpoint()
    return p.join(done.select(*keys, "chunk", "start"), [*keys, "chunk"]).withColumn("out", replay_kernel("a", "s", "deadline", "start")).drop("a", "s", "start")


def per_slot(replayed: DataFrame, keys: Sequence[str]) -> DataFrame:
    z = F.arrays_zip("slots", F.col("out.served").alias("served"), F.col("out.violated").alias("violated"), F.col("out.queue").alias("queue"), F.col("out.hol").alias("hol"))
    return replayed.select(*keys, "chunk", F.explode(z).alias("z")).select(*keys, "chunk", F.col("z.slots").alias("slot"), "z.served", "z.violated", "z.queue", "z.hol")


def delay_histogram(replayed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return replayed.select(*keys, F.posexplode("out.hist").alias("age", "b")).groupBy(*keys, "age").agg(F.sum("b").alias("bits"))


def fluid_drops(values, deadline, rate) -> Column:
    """Volume dropped when one horizon is served at a constant rate from empty; service goes on until the deadline of its end."""
    d = col(deadline)
    tail = F.array_repeat(F.lit(0.0), F.lit(1) + d)
    arrivals = F.concat(col(values).cast("array<double>"), tail)
    out = replay_kernel(arrivals, F.transform(arrivals, lambda _: col(rate)), d, F.array().cast("array<double>"))
    return F.aggregate(out["violated"], F.lit(0.0), lambda a, x: a + x)
