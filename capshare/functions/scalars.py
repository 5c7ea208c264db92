"""Scalar column expressions: units, weights, budgets, text."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as K


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def bind(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; inside a lambda an expression is otherwise re-evaluated per element."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


# --- link units ------------------------------------------------------------------------------------
def prb_layer_bits(width, overhead=K.OVERHEAD) -> Column:
    """Link bits that one PRB-layer takes in one slot at a mantissa width."""
    per_symbol = F.lit(float(K.SUBCARRIERS_PER_PRB * 2)) * col(width) + F.lit(float(K.EXPONENT_BITS))
    return per_symbol * F.lit(float(K.SYMBOLS_PER_SLOT)) * col(overhead)


def link_bits(user_bits, efficiency, beta) -> Column:
    """User bits expressed as link bits: PRB-layers needed times link bits per PRB-layer."""
    return col(user_bits) / col(efficiency) * col(beta)


def usable_bits_per_slot(gbps, reserve) -> Column:
    return col(gbps) * F.lit(1e9) * F.lit(K.SLOT_SECONDS) * (F.lit(1.0) - col(reserve))


def peak_bits_per_slot(prbs, layers, beta) -> Column:
    return col(prbs) * col(layers) * col(beta)


def stream_gbps(streams, width) -> Column:
    symbol = F.lit(24.0) * col(width) + F.lit(8.0)
    return (col(streams) * F.lit(float(K.PRBS_PER_CELL * K.SYMBOLS_PER_SLOT)) * symbol * F.lit(K.OVERHEAD)
            * F.lit(float(K.SLOTS_PER_SECOND)) / F.lit(1e9))


def weight_update_gbps(antennas, users, width, every_slots, prbs_per_group: int = 3) -> Column:
    groups = float(-(-K.PRBS_PER_CELL // prbs_per_group))
    bits = col(users) * (col(antennas) * F.lit(2.0) * col(width) + F.lit(float(K.EXPONENT_BITS)))
    return F.lit(groups) * bits * F.lit(K.OVERHEAD) * F.lit(float(K.SLOTS_PER_SECOND)) / col(every_slots) / F.lit(1e9)


# --- weights and rates --------------------------------------------------------------------------------
def deadline_weight(priority, deadline, horizon: int, w_min=K.W_MIN) -> Column:
    urgency = F.least(F.greatest(F.lit(float(horizon)) / col(deadline), col(w_min)), F.lit(1.0))
    return col(priority) * urgency


def backlog_rate(backlog, deadline, hol_age, interval: int, delay: int) -> Column:
    """Rate that clears a backlog within its slack; the upper bound wins over the lower one."""
    slack = F.greatest(col(deadline) - col(hol_age) - F.lit(delay) + F.lit(1), F.ceil(col(deadline) / F.lit(2.0)))
    return col(backlog) / F.least(slack.cast("double"), F.lit(float(interval)))


def is_low_latency(deadline) -> Column:
    return col(deadline) <= F.lit(K.LL_DEADLINE)


def clean(x, default=0.0) -> Column:
    """NaN and NULL become a default."""
    return F.coalesce(F.nanvl(col(x), F.lit(default)), F.lit(default))


def is_finite(x) -> Column:
    c = col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


# --- rounding --------------------------------------------------------------------------------------
def round_mantissa(x, bits) -> Column:
    """Nearest value with ``bits`` mantissa bits, unbounded exponent, halves to even."""
    v = col(x).cast("double")
    e = F.floor(F.log2(F.abs(v))) + F.lit(1)
    scaled = F.rint(v * F.pow(F.lit(2.0), col(bits) - e)) * F.pow(F.lit(2.0), e - col(bits))
    return F.when(v == 0.0, F.lit(0.0)).otherwise(scaled)


def units_up(bits, unit) -> Column:
    return F.ceil(col(bits) / col(unit)) * col(unit)


def units_down(bits, unit) -> Column:
    return F.floor(col(bits) / col(unit)) * col(unit)


def units_used(bits, unit) -> Column:
    """Whole units needed for served bits, with a guard against rounding noise."""
    return F.ceil(col(bits) / col(unit) - F.lit(1e-9)) * col(unit)


# --- decibel -----------------------------------------------------------------------------------------
def to_db(x) -> Column:
    return F.lit(10.0) * F.log10(col(x))


def from_db(x) -> Column:
    return F.pow(F.lit(10.0), col(x) / F.lit(10.0))


def attenuated_shannon(sinr) -> Column:
    """Spectral efficiency of a linear SINR, cut below the lowest usable level and capped at the highest."""
    db = to_db(F.greatest(col(sinr), F.lit(1e-12)))
    se = F.least(F.lit(K.SHANNON_ALPHA) * F.log2(F.lit(1.0) + col(sinr)), F.lit(K.CQI_EFFICIENCY[-1]))
    return F.when(db < F.lit(K.SINR_MIN_DB), F.lit(0.0)).otherwise(se)


def warm_residual(users, antennas, one_minus_rho, corr=1.0) -> Column:
    return (col(corr) * F.lit(2.0) * F.sqrt(col(users) / (col(antennas) - col(users))) * F.sqrt(col(one_minus_rho)))


def warm_speed_limit_kmh(users, antennas, r_max=0.3, carrier_hz=3.5e9, corr=1.0) -> Column:
    coef = col(corr) * F.lit(2.0) * F.sqrt(col(users) / (col(antennas) - col(users)))
    doppler = col(r_max) / (coef * F.pi() * F.lit(K.SLOT_SECONDS))
    return doppler * F.lit(299792458.0) / F.lit(carrier_hz) * F.lit(3.6)


# --- text ------------------------------------------------------------------------------------------
def spell_label(label) -> Column:
    """Letters only: digits become words, anything else that is not alphanumeric goes."""
    return reduce(lambda c, d: F.replace(c, F.lit(str(d)), F.lit(K.DIGIT_WORDS[d])), range(10),
                  F.regexp_replace(col(label), "[^A-Za-z0-9]", ""))


def significance_mark(p) -> Column:
    return F.when(col(p) < 0.01, F.lit("**")).when(col(p) < 0.05, F.lit("*")).otherwise(F.lit(""))


def signed_int(x) -> Column:
    v = F.rint(col(x)).cast("bigint")
    return F.when(v == 0, F.lit("0")).when(v > 0, F.concat(F.lit("+"), v.cast("string"))).otherwise(v.cast("string"))


def two_decimals(x) -> Column:
    """Half-up at two decimals, as text."""
    return F.format_string("%.2f", F.round(col(x), 2))


def mean_pm_std(mean, std) -> Column:
    return F.concat(two_decimals(mean), F.lit("±"), two_decimals(std))


def run_key(*parts) -> Column:
    return F.concat_ws("_", *[col(p) for p in parts])


def json_param(params, key: str, default=None, dtype: str = "double") -> Column:
    got = F.get_json_object(col(params), f"$.{key}").cast(dtype)
    return got if default is None else F.coalesce(got, F.lit(default).cast(dtype))
