"""Dense per-key series, cut into time chunks so that one long or hot key never lands in one task.

Every operator here has a bounded look-back and look-ahead.  A slot is copied to the chunks whose halo needs
it, windows are partitioned by (key, chunk), and only the rows a chunk owns are kept: the work of one key
spreads over as many tasks as it has chunks, at the price of a small overlap.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.demand import rolling_rates
from ..functions.quantiles import sorted_quantiles
from ..session import shared_dir

KEYS = ("link_id", "cell_id")


@dataclass(frozen=True)
class Clock:
    """Control timing: an epoch every ``interval`` slots (from ``phase``), telemetry ``delay`` slots old."""
    interval: int = K.INTERVAL_SLOTS
    delay: int = K.TELEMETRY_DELAY
    phase: int = 0
    history: int = K.FORECAST_WINDOW        # horizons of look-back that the halo of a chunk must hold

    @property
    def horizon(self) -> int:
        return self.interval + self.delay

    @property
    def chunk(self) -> int:
        return 200 * self.interval

    @property
    def lookback(self) -> int:
        return max((max(self.history, K.FORECAST_WINDOW) + 1) * self.horizon, 60 * self.interval) + 1

    def holds(self, slots: int) -> None:
        """Refuse a look-back that the halo does not cover, instead of reading short series."""
        if slots > self.lookback - 1:
            raise ValueError(f"{slots} slots of look-back exceed the halo of {self.lookback - 1}; give the clock more history")


def slot_events(events: DataFrame, keys: Sequence[str], ts: str, bits: str, origin: str, seconds: float,
                n_slots: int | None = None) -> DataFrame:
    """Sized events -> dense (key, slot, bits), from slot 0 at ``origin`` to the last slot that holds an event.

    ``n_slots`` cuts the range on purpose: events outside are then dropped. Events without a time belong to no slot.
    Zero rows for the starts of chunks are added by union before the one aggregation, so densifying costs no join.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(origin)))
    slot = F.floor(micros / F.lit(int(seconds * 1_000_000))).cast("bigint")
    hits = events.select(*keys, slot.alias("slot"), F.col(bits).cast("bigint").alias("bits"))
    return densify(hits, keys, "bits", n_slots)


def span(hits: DataFrame) -> int:
    """How many slots the events reach: last slot + 1, one aggregate. Events before slot 0 are refused, not dropped."""
    ends = hits.agg(F.min("slot").alias("first"), F.max("slot").alias("last")).first()
    if ends["last"] is None:
        return 0
    if ends["first"] < 0:
        raise ValueError(f"events from slot {ends['first']}: give an earlier origin")
    return int(ends["last"]) + 1


def filled(hits: DataFrame, keys: Sequence[str], value: str, n_slots: int | None = None, chunk: int = 256) -> DataFrame:
    """The full grid 0..n_slots-1 in stretches (keys, _c, _from, _to, _v): the sum of ``value`` at slot ``_from``, nothing behind it up to ``_to``.
    No stretch crosses a multiple of ``chunk``; ``_c`` counts those.

    The events and a zero at the start of every ``chunk`` slots of a key are summed; each sum then reaches up to the next one of its chunk.
    """
    if n_slots is None:
        n_slots = span(hits.select("slot"))
    hits = hits.where(F.col("slot").between(0, n_slots - 1)).select(*keys, "slot", value)
    last = max(n_slots - 1, 0)
    starts = (hits.select(*keys).distinct()
              .select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"), F.lit(chunk).cast("bigint"))).alias("slot"),
                      F.lit(0).cast("bigint").alias(value)))
    sums = hits.unionByName(starts).groupBy(*keys, "slot").agg(F.coalesce(F.sum(value), F.lit(0).cast("bigint")).alias("_v"))
    # every event lies behind the start of its chunk
    at = F.floor(F.col("slot") / chunk).cast("bigint")
    upto = F.coalesce(F.lead("slot").over(W.partitionBy(*keys, "_c").orderBy("slot")) - 1, F.least((F.col("_c") + 1) * chunk - 1, F.lit(last)))
    return sums.withColumn("_c", at).withColumn("_to", upto).select(*keys, "_c", F.col("slot").alias("_from"), "_to", "_v")


def densify(hits: DataFrame, keys: Sequence[str], value: str, n_slots: int | None = None, chunk: int = 256) -> DataFrame:
    """Sum of ``value`` per (key, slot) on the full grid 0..n_slots-1, all slots of the events if not given. The grid is written out behind the last
    shuffle and never held."""
    return (filled(hits, keys, value, n_slots, chunk).withColumn("slot", F.explode(F.sequence("_from", "_to")))
            .select(*keys, "slot", F.when(F.col("slot") == F.col("_from"), F.col("_v")).otherwise(F.lit(0).cast("bigint")).alias(value)))


def with_chunks(slots: DataFrame, chunk: int, lookback: int, lookahead: int) -> DataFrame:
    """Copy each slot to every chunk whose halo covers it (column ``chunk``)."""
    first = F.greatest(F.floor((F.col("slot") - lookahead) / chunk), F.lit(0)).cast("bigint")
    last = F.floor((F.col("slot") + lookback) / chunk).cast("bigint")
    return slots.withColumn("chunk", F.explode(F.sequence(first, last)))


def owned(chunk: int) -> Column:
    return F.floor(F.col("slot") / chunk).cast("bigint") == F.col("chunk")


def packed_rates(slots: DataFrame, clock: Clock, keys: Sequence[str] = KEYS, value: str = "fh_bits",
                 carry: Sequence[str] = ("se",)) -> DataFrame:
    """One row per (keys, chunk): the dense slots of the chunk and its halo, and per slot the rate and critical length of the
    last horizon ending *with* it. One shuffle; everything that reads rates starts from here."""
    chunked = with_chunks(slots.select(*keys, "deadline", "slot", value, *carry), clock.chunk, clock.lookback, clock.horizon)
    packed = (chunked.groupBy(*keys, "chunk")
              .agg(F.first("deadline").alias("deadline"),
                   F.sort_array(F.collect_list(F.struct("slot", value, *carry))).alias("rows")))
    kernel = rolling_rates(clock.horizon)
    return packed.withColumn("k", kernel(F.col(f"rows.{value}").cast("array<double>"), F.col("deadline")))


def rate_series(slots: DataFrame, clock: Clock, keys: Sequence[str] = KEYS, value: str = "fh_bits",
                carry: Sequence[str] = ("se",)) -> DataFrame:
    """``packed_rates`` as one row per slot; the windows of this module reuse its partitioning on (keys, chunk)."""
    rated = packed_rates(slots, clock, keys, value, carry)
    zipped = F.arrays_zip(F.col("rows"), F.col("k.rate").alias("rate"), F.col("k.crit").alias("crit"))
    return (rated.select(*keys, "chunk", "deadline", F.explode(zipped).alias("z"))
            .select(*keys, "chunk", "deadline", "z.rows.slot", F.col(f"z.rows.{value}").alias(value),
                    *[F.col(f"z.rows.{c}").alias(c) for c in carry], "z.rate", "z.crit"))


def at_epochs(packed: DataFrame, clock: Clock, fields, keys: Sequence[str] = KEYS, value: str = "fh_bits") -> DataFrame:
    """One row per (keys, epoch) read straight from the packed chunk: ``fields(slot, pos)`` gives columns, ``pos`` is the place
    of the observation slot in the arrays. Only epoch slots are evaluated and exploded."""
    p = packed.withColumns({"base": F.get("rows.slot", F.lit(0)), "vals": F.col(f"rows.{value}").cast("array<double>"),
                            "rate": F.col("k.rate"), "crit": F.col("k.crit").cast("array<double>")})
    start = F.col("chunk") * clock.chunk
    stop = F.least(start + clock.chunk, F.col("base") + F.size("rows")) - 1
    first = start + F.pmod(F.lit(clock.phase - clock.delay) - start, F.lit(clock.interval))
    anchors = F.when(first <= stop, F.sequence(first, stop, F.lit(clock.interval).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def read(slot):
        pos = (slot - F.col("base")).cast("int")
        return F.struct((slot + clock.delay).alias("epoch"), slot.alias("obs_slot"), *[c.alias(n) for n, c in fields(slot, pos).items()])

    return p.select(*keys, "deadline", F.inline(F.transform(anchors, read)))


def total(array) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def before(array: str, pos: Column, back: int, count: int) -> Column:
    """Values of the ``count`` places that end ``back`` places before ``pos`` (clipped at the start of the series)."""
    stop = F.greatest(pos - back, F.lit(0))
    begin = F.greatest(pos - back - count, F.lit(0))
    return F.slice(F.col(array), begin + 1, stop - begin)


def block_ends(array: str, slot: Column, pos: Column, clock: Clock, count: int) -> Column:
    """``array`` at the last slots of the last full blocks before ``pos``, newest first, at most ``count``."""
    clock.holds((count + 1) * clock.horizon)
    n = F.least(F.floor(slot / clock.horizon), F.lit(count)).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda j: F.get(F.col(array), pos - 1 - j * clock.horizon))


def chunk_window(keys: Sequence[str] = KEYS):
    return W.partitionBy(*keys, "chunk").orderBy("slot")


def epoch_anchor(clock: Clock) -> Column:
    """Rows whose slot is the observation slot of an epoch with history."""
    return ((F.col("slot") + clock.delay - clock.phase) % clock.interval == 0) & owned(clock.chunk)


def ewma(value: str, window: int, clock: Clock, keys: Sequence[str] = KEYS) -> Column:
    """Normalised finite EWMA of the values before the row, over at most ``6 * window`` of them.

    Running sums of ``v * (1-a)^-s`` are differenced; ``s`` counts from the start of the halo, so the powers stay
    far inside the double range for the chunk lengths of ``Clock``.
    """
    w = chunk_window(keys)
    clock.holds(6 * window)
    if window == 1:
        return F.coalesce(F.lag(value, 1).over(w), F.lit(0.0)).cast("double")
    decay = 1.0 - 2.0 / (window + 1.0)
    span = 6 * window
    base = F.greatest(F.col("chunk") * clock.chunk - clock.lookback, F.lit(0))
    age = (F.col("slot") - base).cast("double")
    grown = F.sum(F.col(value) * F.pow(F.lit(decay), -age))
    upto = F.coalesce(grown.over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    before = F.coalesce(grown.over(w.rowsBetween(W.unboundedPreceding, -span - 1)), F.lit(0.0))
    used = F.least(F.col("slot"), F.lit(span)).cast("double")
    norm = (F.lit(1.0) - F.pow(F.lit(decay), used)) / F.lit(1.0 - decay)
    return F.when(used > 0, (upto - before) * F.pow(F.lit(decay), age - 1) / norm).otherwise(F.lit(0.0))


def lag_block_means(value: str, clock: Clock, keys: Sequence[str] = KEYS, blocks: int = K.LAG_BLOCKS) -> list[Column]:
    """Means of back-to-back horizons counted back from the row; a short first block averages what exists."""
    w, h = chunk_window(keys), clock.horizon

    def before(back: int) -> Column:
        return F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -back - 1)), F.lit(0))

    out = []
    for k in range(blocks):
        hi = F.col("slot") - k * h
        n = F.least(hi, F.lit(h))
        out.append(F.when(hi > 0, (before(k * h) - before((k + 1) * h)) / n).otherwise(F.lit(0.0)))
    return out


def features(rates: DataFrame, clock: Clock, keys: Sequence[str] = KEYS, value: str = "fh_bits",
             ewma_windows: Sequence[int] | None = None) -> DataFrame:
    """One row per (key, epoch): raw (unscaled) lag, EWMA, last-slot and rate features, and the label.

    ``label`` is the rate of ``[obs_slot, epoch + interval)``: it looks ahead and must be used as a target only.
    """
    w, h = chunk_window(keys), clock.horizon
    wins = list(ewma_windows or (clock.interval, 10 * clock.interval))
    full = rates
    # two passes over the same window keep the frame list short: running reads first, derived columns after
    full = full.withColumns({f"lag_mean_{k + 1}": c for k, c in enumerate(lag_block_means(value, clock, keys))}
                            | {f"ewma_{n}": ewma(value, n, clock, keys) for n in wins}
                            | {f"last_slot_{k}": F.coalesce(F.lag(value, k).over(w), F.lit(0)).cast("double")
                               for k in range(1, K.LAST_SLOTS + 1)}
                            | {f"rstar_lag_{k + 1}": F.coalesce(F.lag("rate", 1 + k * h).over(w), F.lit(0.0))
                               for k in range(K.RATE_LAGS)}
                            | {"label": F.lead("rate", h - 1).over(w),
                               "label_mean": F.avg(value).over(w.rowsBetween(0, h - 1))})
    rows = full.where(epoch_anchor(clock))
    lags = F.array(*[F.col(f"lag_mean_{k + 1}") for k in range(K.LAG_BLOCKS)])
    mean = F.aggregate(lags, F.lit(0.0), lambda a, x: a + x) / K.LAG_BLOCKS
    rows = rows.withColumn("lag_mean", mean).withColumn(
        "lag_std", F.sqrt(F.aggregate(lags, F.lit(0.0), lambda a, x: a + (x - F.col("lag_mean")) ** 2) / K.LAG_BLOCKS)
    ).withColumn("lag_max", F.array_max(lags))
    cols = ([f"lag_mean_{k + 1}" for k in range(K.LAG_BLOCKS)] + ["lag_mean", "lag_std", "lag_max"]
            + [f"ewma_{n}" for n in wins] + [f"last_slot_{k}" for k in range(1, K.LAST_SLOTS + 1)]
            + [f"rstar_lag_{k + 1}" for k in range(K.RATE_LAGS)])
    return rows.select(*keys, (F.col("slot") + clock.delay).alias("epoch"), F.col("slot").alias("obs_slot"), "deadline",
                       "se", *cols, "label", "label_mean")


def enough_history(clock: Clock, blocks: int = K.LAG_BLOCKS + 1) -> Column:
    return F.col("obs_slot") >= blocks * clock.horizon


def window_forecast(packed: DataFrame, clock: Clock, keys: Sequence[str] = KEYS, window: int = K.FORECAST_WINDOW,
                    levels=K.QUANTILE_LEVELS) -> DataFrame:
    """Empirical quantiles of the rate over the last ``window`` horizons of each key, per epoch (from ``packed_rates``).

    With less than one full horizon the rate of what exists is repeated at every level.
    """
    rows = at_epochs(packed, clock, lambda slot, pos: {
        "recent": F.sort_array(block_ends("rate", slot, pos, clock, window)),
        "partial": F.coalesce(F.get("rate", pos - 1), F.lit(0.0))}, keys)
    q = F.when(F.size("recent") > 0, sorted_quantiles("recent", levels)).otherwise(F.array(*[F.col("partial") for _ in levels]))
    return rows.select(*keys, "epoch", "obs_slot", q.alias("q"))


def persistence(rates: DataFrame, slots: DataFrame, clock: Clock, horizons: int, keys: Sequence[str] = KEYS,
                value: str = "fh_bits") -> DataFrame:
    """One rate over the last ``horizons`` blocks of observed slots (fewer when history is short)."""
    if horizons == 1:
        w = chunk_window(keys)
        return (rates.withColumn("persist", F.coalesce(F.lag("rate", 1).over(w), F.lit(0.0)))
                .where(epoch_anchor(clock))
                .select(*keys, (F.col("slot") + clock.delay).alias("epoch"), F.col("slot").alias("obs_slot"), "persist"))
    # the block count is min(horizons, full blocks seen), so read the series of each possible length
    h, out = clock.horizon, None
    for k in range(1, horizons + 1):
        longer = Clock(clock.interval, clock.delay + (k - 1) * h, clock.phase)
        part = rate_series(slots, longer, keys, value)
        w = chunk_window(keys)
        here = ((F.col("slot") + clock.delay - clock.phase) % clock.interval == 0) & owned(longer.chunk)
        seen = F.greatest(F.floor(F.col("slot") / h), F.lit(1))
        fits = (seen >= k) if k == horizons else (seen == k)
        part = (part.withColumn("persist", F.coalesce(F.lag("rate", 1).over(w), F.lit(0.0))).where(here & fits)
                .select(*keys, (F.col("slot") + clock.delay).alias("epoch"), F.col("slot").alias("obs_slot"), "persist"))
        out = part if out is None else out.unionByName(part)
    return out


def volume_of(lengths, deadline, interval: int) -> Column:
    """``min(D + mean critical length, T)``; a single slot stands in for the mean when there is no history."""
    n = F.size(lengths)
    mean = F.when(n > 0, total(lengths) / n).otherwise(F.lit(1.0))
    return F.least(deadline + mean, F.lit(float(interval)))


def volume_factor(packed: DataFrame, clock: Clock, keys: Sequence[str] = KEYS, window: int = K.FORECAST_WINDOW) -> DataFrame:
    """Slots that one unit of rate can fill, from the critical lengths of the recent horizons."""
    rows = at_epochs(packed, clock, lambda slot, pos: {"recent": block_ends("crit", slot, pos, clock, window)}, keys)
    return rows.select(*keys, "epoch", "obs_slot", volume_of(F.col("recent"), F.col("deadline"), clock.interval).alias("volume"))


def patches(packed: DataFrame, scale: float, clock: Clock, keys: Sequence[str] = KEYS, count: int = K.NUM_PATCHES) -> DataFrame:
    """Patch tokens: the last ``count`` blocks, oldest first, each with its values, rate, mean and max; zero padded."""
    h = clock.horizon
    clock.holds((count + 1) * h)

    def fields(slot, pos):
        def patch(j):
            back = (F.lit(count - 1) - j) * h
            full = slot >= back + h
            vals = F.transform(F.slice(F.col("vals"), F.greatest(pos - back - h, F.lit(0)) + 1, F.lit(h)), lambda x: x / scale)
            return F.struct(j.alias("idx"), F.when(full, vals).otherwise(F.array_repeat(F.lit(0.0), h)).alias("vals"),
                            F.when(full, F.get("rate", pos - back - 1) / scale).otherwise(F.lit(0.0)).alias("rate"))
        return {"p": F.transform(F.sequence(F.lit(0), F.lit(count - 1)), patch)}

    rows = at_epochs(packed, clock, fields, keys)
    full = F.transform("p", lambda t: F.struct(t["idx"].alias("idx"), t["vals"].alias("vals"), t["rate"].alias("rate"),
                                               (total(t["vals"]) / h).alias("mean"), F.array_max(t["vals"]).alias("max")))
    return rows.select(*keys, "epoch", "obs_slot", full.alias("patches"))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, chunk: int) -> DataFrame:
    """Cumulative sum along an integer order, in two levels so that no key is summed in one task.

    Totals per (key, chunk) are small; their exclusive running sum is joined back and added to the sum in the chunk.
    """
    df = df.withColumn("_c", F.floor(F.col(order) / chunk).cast("bigint"))
    totals = df.groupBy(*keys, "_c").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*keys, "_c", F.coalesce(before, F.lit(0)).alias("_b"))
    inner = F.sum(value).over(W.partitionBy(*keys, "_c").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return (df.withColumn("_s", inner).join(totals, [*keys, "_c"])
            .withColumn(out, F.col("_s") + F.col("_b")).drop("_s", "_b", "_c"))


def hold_last(df: DataFrame, keys: Sequence[str], order: str, value: str, every: int, out: str) -> DataFrame:
    """Value refreshed at every multiple of ``every`` and held in between.

    On a dense series the refresh slot is known, so a group aggregate plus join replaces an unbounded window.
    """
    anchor = F.floor(F.col(order) / every).cast("bigint")
    df = df.withColumn("_a", anchor)
    fresh = (df.where(F.col(order) % every == 0).select(*keys, "_a", F.col(value).alias(out)))
    return df.join(fresh, [*keys, "_a"], "left").drop("_a")


def _glued(runs: DataFrame, keys: Sequence[str], state: str, width: int | None) -> DataFrame:
    """Touching runs (_s .. _e) of equal state joined inside each stretch of ``width`` (none: of a key); ``_border``: first or last run of its stretch."""
    part = [*keys] if width is None else [*keys, "_c"]
    runs = runs if width is None else runs.withColumn("_c", F.floor(F.col("_s") / width).cast("bigint"))
    w = W.partitionBy(*part).orderBy("_s")
    touches = F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.lag("_e").over(w) == F.col("_s") - 1)
    runs = runs.withColumn("_g", F.sum(F.when(touches, 0).otherwise(1)).over(w))
    joined = runs.groupBy(*part, "_g", state).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    border = (F.col("_g") == 1) | (F.col("_g") == F.max("_g").over(W.partitionBy(*part)))
    return joined.withColumn("_border", border).select(*keys, state, "_s", "_e", "_border")


def sojourns(df: DataFrame, keys: Sequence[str], order: str, state: str, chunk: int, levels: int = 1, fan: int = 64, until: str | None = None) -> DataFrame:
    """Runs of equal state along an integer order: (keys, state, start, length). A null state is a state; a gap in the order ends a run. With ``until`` a
    row stands for all of ``order`` .. ``until``, which must not cross a multiple of ``chunk``.

    A chunk is summed up as its first run, its last run and the runs between, which are closed. Only the two border runs go on: to stretches of ``fan`` chunks,
    ``levels`` times, and at last to their key. So a key of any length meets in one window with two rows per ``chunk * fan ** levels`` of its order.
    """
    shared_dir(df.sparkSession)
    runs = df.select(*keys, state, F.col(order).alias("_s"), F.col(until or order).alias("_e"))
    closed = []
    for level in range(levels + 1):
        runs = _glued(runs, keys, state, chunk * fan ** level).checkpoint()      # read twice: what is closed, and what goes on
        closed.append(runs.where(~F.col("_border")))
        runs = runs.where("_border").drop("_border")
    out = _glued(runs, keys, state, None)
    for c in closed:
        out = out.unionByName(c)
    return out.select(*keys, state, F.col("_s").alias("start"), (F.col("_e") - F.col("_s") + 1).alias("length"))


def state_ages(slots: DataFrame, clock: Clock, keys: Sequence[str] = KEYS, value: str = "fh_bits", recent: int = 3,
               cap: str = "deadline") -> DataFrame:
    """Stand-in for logged queue state at an epoch: bits of the last visible slots and slots since the last idle one.

    Both are functions of slots before the observation slot only.
    """
    w = chunk_window(keys)
    chunked = with_chunks(slots, clock.chunk, clock.lookback, 0)
    queue = F.coalesce(F.sum(value).over(w.rowsBetween(-recent, -1)), F.lit(0))
    idle = F.last(F.when(F.col(value) == 0, F.col("slot")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    idle = F.coalesce(idle, F.greatest(F.col("chunk") * clock.chunk - clock.lookback, F.lit(0)) - 1)
    rows = chunked.withColumns({"queue_fh": queue.cast("double"), "_idle": idle}).where(epoch_anchor(clock))
    hol = F.greatest(F.least(F.col("slot") - 1 - F.col("_idle"), F.col(cap)), F.lit(0))
    return rows.select(*keys, (F.col("slot") + clock.delay).alias("epoch"), F.col("slot").alias("obs_slot"),
                       "queue_fh", hol.cast("bigint").alias("hol_age"))
