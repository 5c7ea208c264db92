"""Keyed state: first-in-first-out replay with deadline drops, online calibration, and sums of delayed telemetry.

State per key is of fixed size plus rows that came before their turn. Rows are taken in the order of their slots or epochs, and what is missing holds a key up
for a bounded time only. Rows that come after their turn are counted (``late``, so far) and not applied. So results do not depend on how a stream is cut into
batches, as long as no row is late.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIFO_OUT = "cell_id bigint, slot bigint, served double, violated double, queue double, hol bigint, taken array<double>, late bigint"
CAL_OUT = "cell_id bigint, k bigint, delta double, late bigint"
SEEN_OUT = "cell_id bigint, id bigint, seen bigint, total bigint"


def _served(ages: list[float], arrived: float, allowed: float) -> tuple[list[float], float, list[float]]:
    """``replay.step`` for one key, the oldest first: (taken by age, dropped, ages one slot later). Frames of one key are too small for arrays."""
    ages[0] += arrived
    taken, through = [0.0] * len(ages), 0.0
    for i in range(len(ages) - 1, -1, -1):
        if ages[i]:
            through += ages[i]
            taken[i] = min(max(allowed - (through - ages[i]), 0.0), ages[i])
            ages[i] -= taken[i]
    return taken, ages[-1], [0.0, *ages[:-1]]


class FifoProcessor(StatefulProcessor):
    """State: next slot, newest slot seen, the D + 1 age counters, late rows so far, and rows that arrived ahead of their turn with their number."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", "next bigint, newest bigint, ages array<double>, late bigint, waiting bigint")
        self.ahead = handle.getMapState("ahead", "slot bigint", "arrived double, allowed double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        # each call to the state is a message to the JVM: one to read and one to write, unless rows wait
        nxt, newest, ages, late, waiting = self.state.get() or (0, -1, [0.0] * (int(got["deadline"].iloc[0]) + 1), 0, 0)
        ages = list(ages)
        before = {k[0]: tuple(v) for k, v in self.ahead.iterator()} if waiting else {}
        todo = dict(before)
        for slot, arrived, allowed in zip(got["slot"].tolist(), got["arrived"].tolist(), got["allowed"].tolist(), strict=True):
            if slot < nxt:
                late += 1
            else:
                todo[slot] = (arrived, allowed)
            newest = max(newest, slot)
        first, served, violated, queue, hol, by_age = nxt, [], [], [], [], []
        # nothing arrives and nothing is allowed in a slot that has not come ``patience`` slots later
        while nxt in todo or nxt < newest - self.patience:
            taken, dropped, ages = _served(ages, *todo.pop(nxt, (0.0, 0.0)))
            served.append(sum(taken))
            violated.append(dropped)
            queue.append(sum(ages))
            hol.append(max((i for i, a in enumerate(ages) if a > 0), default=0))
            by_age.append(taken)
            nxt += 1
        for slot in before.keys() - todo.keys():
            self.ahead.removeKey((slot,))
        for slot in todo.keys() - before.keys():
            self.ahead.updateValue((slot,), todo[slot])
        self.state.update((nxt, newest, ages, late, len(todo)))
        yield pd.DataFrame({"cell_id": key[0], "slot": range(first, nxt), "served": served, "violated": violated, "queue": queue, "hol": hol, "taken": by_age, "late": late})

    def close(self) -> None:
        pass


def fifo(stream: DataFrame, key: str = "cell_id", patience: int = 64) -> DataFrame:
    """Replay of (key, slot, deadline, arrived, allowed) rows; slots of a key count from 0. A missing slot is waited for until a row ``patience`` slots newer
    has come. ``taken``: served by age."""
    return stream.groupBy(key).transformWithStateInPandas(FifoProcessor(patience), FIFO_OUT, "Append", "None")


def delay_histogram(rows: DataFrame, key: str = "cell_id") -> DataFrame:
    """Bits served by age, from the rows of ``fifo``."""
    return rows.select(key, F.posexplode("taken").alias("age", "bits")).groupBy(key, "age").agg(F.sum("bits").alias("bits"))


class CalibrationProcessor(StatefulProcessor):
    """State: the offset, the last epoch whose outcome was due, late outcomes so far, opened epochs that wait for their moment, outcomes that are not due."""

    def __init__(self, lag: int, gamma: float, level: float, lo: float, hi: float):
        self.lag, self.gamma, self.level, self.lo, self.hi = lag, gamma, level, lo, hi

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("offset", "delta double, due bigint, late bigint, opens array<bigint>, times array<bigint>, epochs array<bigint>, misses array<int>")

    def _get(self):
        return self.state.get() if self.state.exists() else (0.0, -1, 0, [], [], [], [])

    def _put(self, delta, due, late, opens, pending) -> None:
        self.state.update((delta, due, late, [k for _, k in opens], [t for t, _ in opens], list(pending), list(pending.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        delta, due, late, ks, ts, epochs, misses = self._get()
        opens, pending = set(zip(ts, ks, strict=True)), dict(zip(epochs, misses, strict=True))
        for got in rows:
            for kind, k, miss, ms in zip(got["kind"], got["k"], got["miss"], got["ms"], strict=True):
                if kind == "open":
                    opens.add((int(ms), int(k)))
                elif k <= due:
                    late += 1
                else:
                    pending[int(k)] = int(miss)
        opens = sorted(opens)
        if opens:       # it opens once all that happened before it is known
            self.handle.registerTimer(opens[0][0])
        self._put(delta, due, late, opens, pending)
        yield pd.DataFrame({"cell_id": [], "k": [], "delta": [], "late": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        delta, due, late, ks, ts, epochs, misses = self._get()
        opens, pending, out = list(zip(ts, ks, strict=True)), dict(zip(epochs, misses, strict=True)), []
        now = timerValues.getCurrentWatermarkInMs()
        while opens and opens[0][0] <= now:
            k = opens.pop(0)[1]
            for j in sorted(j for j in pending if j <= k - self.lag):
                delta = min(max(delta + self.gamma * (pending.pop(j) - (1.0 - self.level)), self.lo), self.hi)
            due = max(due, k - self.lag)
            out.append((key[0], k, float(delta), late))
        if opens:
            self.handle.registerTimer(opens[0][0])
        self._put(delta, due, late, opens, pending)
        yield pd.DataFrame(out, columns=["cell_id", "k", "delta", "late"])

    def close(self) -> None:
        pass


def calibrate(stream: DataFrame, lag: int, gamma: float = 0.02, level: float = 0.9, lo: float = -0.3, hi: float = 0.3, key: str = "cell_id", ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Two kinds of rows (key, kind, k, miss, ts): 'open' when epoch k opens (at ``ts``), 'outcome' when its horizon has been observed. The offset in force at
    epoch k leaves as soon as the watermark of the openings reaches k's, without any later outcome; an outcome that comes when its step was due already is counted
    and not applied. Only openings have an event time, so that the watermark drops no outcome unseen."""
    rows = stream.withColumn("clock", F.when(F.col("kind") == "open", F.col(ts))).withWatermark("clock", late).withColumn("ms", F.unix_millis("clock"))
    return rows.groupBy(key).transformWithStateInPandas(CalibrationProcessor(lag, gamma, level, lo, hi), CAL_OUT, "Append", "EventTime")


class DelayedSums(StatefulProcessor):
    """State: times and prefix sums of the telemetry that a decision may still see, and decisions whose telemetry may still come (all in microseconds)."""

    def __init__(self, delay: int, span: int):
        self.delay, self.span = delay, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sums", "times array<bigint>, prefix array<bigint>, at array<bigint>, ids array<bigint>")

    def _get(self):
        times, prefix, at, ids = self.state.get() if self.state.exists() else ([], [0], [], [])
        return np.array(times, np.int64), np.array(prefix, np.int64), list(zip(at, ids, strict=True))

    def _go_on(self, key, times, prefix, waiting, watermark_ms: int) -> pd.DataFrame:
        due = [d for d in waiting if d[0] - self.delay <= watermark_ms * 1000]
        waiting = sorted(d for d in waiting if d[0] - self.delay > watermark_ms * 1000)
        at = np.array([t for t, _ in due], np.int64)
        lo, hi = np.searchsorted(times, at - self.span, "right"), np.searchsorted(times, at - self.delay, "right")
        out = pd.DataFrame({"cell_id": key[0], "id": [i for _, i in due], "seen": hi - lo, "total": prefix[hi] - prefix[lo]})
        # no decision to come is older than the watermark
        old = int(np.searchsorted(times, min([t for t, _ in waiting[:1]] + [watermark_ms * 1000]) - self.span, "right"))
        if waiting:
            self.handle.registerTimer(-((self.delay - waiting[0][0]) // 1000))
        self.state.update((times[old:].tolist(), prefix[old:].tolist(), [t for t, _ in waiting], [i for _, i in waiting]))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, prefix, waiting = self._get()
        got = pd.concat(list(rows))
        new = got[got["kind"] == "telemetry"]
        waiting += [(int(t), int(i)) for t, i in got.loc[got["kind"] == "decision", ["us", "id"]].itertuples(index=False)]
        both = np.concatenate([times, new["us"].to_numpy(np.int64)])
        values = np.concatenate([np.diff(prefix), new["bits"].to_numpy(np.int64)])
        order = np.argsort(both, kind="stable")
        prefix = prefix[0] + np.concatenate([[0], np.cumsum(values[order])])
        yield self._go_on(key, both[order], prefix, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._go_on(key, *self._get(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def delayed_sums(stream: DataFrame, delay_s: int, span_s: int, late: str, key: str = "cell_id", ts: str = "ts") -> DataFrame:
    """Rows (key, kind, id, bits, ts): each 'decision' gets number and sum of the 'telemetry' of its key that is at least ``delay_s`` and less than ``span_s``
    seconds old. Two reads of a prefix sum a decision: work and state grow with the rows of a key, never with its pairs."""
    rows = stream.withWatermark(ts, late).withColumn("us", F.unix_micros(ts))
    return rows.groupBy(key).transformWithStateInPandas(DelayedSums(delay_s * 1_000_000, span_s * 1_000_000), SEEN_OUT, "Append", "EventTime")
