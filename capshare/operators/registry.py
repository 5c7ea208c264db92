"""Named allocation rules and forecasters, built in or supplied by the user.

A rule is a function ``(decisions DataFrame, **params) -> DataFrame with budget``; whatever it returns passes the budget
projection.  A forecaster is a function ``(rates DataFrame, clock) -> DataFrame with q ARRAY<DOUBLE>``; wrappers compose.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import quantiles as Q
from . import allocation as A, equal_risk as R, series
from .series import Clock

_RULES: dict[str, Callable] = {}
_FORECASTERS: dict[str, Callable] = {}


_WHOLE = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "boolean": "bool"}


def _group_by_group(rule: Callable, whole: dict[str, str], **params) -> Callable:
    """A function of frames that holds the rows of each group together, marked where a group begins (``_first``): the rule sees one group at a
    time, many of them for each frame that comes and goes. A group that a frame cuts waits for its rest."""
    def given(pdf: pd.DataFrame) -> pd.DataFrame:
        # a null elsewhere in the frame makes whole numbers doubles
        back = {c: t for c, t in whole.items() if pdf[c].dtype != t and pdf[c].notna().all()}
        return rule(pdf.astype(back) if back else pdf, **params)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            starts = np.flatnonzero(pdf.pop("_first").to_numpy())
            if len(starts) == 0:
                held.append(pdf)
                continue
            parts = [*held, pdf.iloc[:starts[0]]] if held else []
            done = [given(pd.concat(parts, ignore_index=True))] if parts else []
            done += [given(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(starts[:-1], starts[1:])]
            held = [pdf.iloc[starts[-1]:]]
            done = [d for d in done if len(d)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield given(pd.concat(held, ignore_index=True))

    return run


def register_allocator(name: str, rule: Callable, per_group: str | None = None) -> None:
    """``per_group`` is the output schema of a pandas function that sees one (link, epoch) at a time; a DataFrame rule is faster."""
    if per_group is None:
        _RULES[name] = rule
    else:
        def grouped(decisions: DataFrame, **params) -> DataFrame:
            begins = F.row_number().over(W.partitionBy(*A.GROUP).orderBy(*A.GROUP)) == 1
            whole = {f.name: _WHOLE[f.dataType.typeName()] for f in decisions.schema if f.dataType.typeName() in _WHOLE}
            return decisions.withColumn("_first", begins).mapInPandas(_group_by_group(rule, whole, **params), per_group)
        _RULES[name] = grouped


def apply_rule(name: str, decisions: DataFrame, clock: Clock, **params) -> DataFrame:
    """The bare rule by name; interval and horizon come from the clock where it asks for them."""
    rule = _RULES[name]
    needs = rule.__code__.co_varnames[:rule.__code__.co_argcount]
    for key, value in (("interval", clock.interval), ("horizon", clock.horizon)):
        if key in needs:
            params.setdefault(key, value)
    return rule(decisions, **params)


def tuned_params(table: DataFrame, name: str, like: str | None = None, **where) -> dict[str, float]:
    """Parameters of a rule in a table (*where, method, params) of ``search.tune``: its own row, else the row of the rule it is ``like``, else
    none. One row is read, when the query is planned."""
    rows = table.where(F.col("method").isin(name, like or name))
    for key, value in where.items():
        rows = rows.where(F.col(key).eqNullSafe(F.lit(value)))
    found = rows.orderBy(F.col("method") != name).select("params").first()
    return dict(found["params"]) if found and found["params"] else {}


def allocate(name: str, decisions: DataFrame, clock: Clock, tuned: DataFrame | None = None, family: str | None = None, like: str | None = None, **params) -> DataFrame:
    """Budgets of a rule by name, projected onto what the link allows. ``tuned`` gives the parameters that are not given here: those of
    ``family`` if there are families."""
    if tuned is not None:
        params = tuned_params(tuned, name, like, **({} if family is None else {"family": family})) | params
    return A.project_budgets(apply_rule(name, decisions, clock, **params)).withColumn("method", F.lit(name))


def rules() -> list[str]:
    return sorted(_RULES)


def register_forecaster(name: str, forecaster: Callable) -> None:
    _FORECASTERS[name] = forecaster


def forecast(name: str, rates: DataFrame, clock: Clock) -> DataFrame:
    return _FORECASTERS[name](rates, clock)


def shifted(forecaster: Callable, eps: float) -> Callable:
    """Wrapper that reports the quantile at ``level + eps`` as the level's quantile."""
    return lambda rates, clock: forecaster(rates, clock).withColumn("q", Q.shift_levels("q", F.lit(float(eps))))


for _name, _rule in {
        "static_equal": A.static_equal, "reactive_prop": A.reactive_proportional, "queue_aware": A.deadline_aware, "maxweight": A.max_weight,
        "point_forecast": A.point_forecast, "fixed_quantile": A.fixed_quantile, "pred_maxweight": A.predictive_max_weight,
        "class_levels": A.class_levels, "equal_risk": R.equal_risk, "equal_risk_class": R.class_weighted, "two_stage": R.two_stage, "hindsight": A.hindsight,
        "hindsight_tiers": A.hindsight_tiers}.items():
    register_allocator(_name, _rule)
register_forecaster("window", series.window_forecast)
