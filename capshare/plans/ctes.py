"""DuckDB text of the shared views, and the builder that puts the needed ones in front of a query."""
from __future__ import annotations

from .. import constants as K

_classes = ", ".join(f"({c}, '{n}', {d}, {p}::DOUBLE, {K.DATA_RES!r}::DOUBLE * {se!r}::DOUBLE, {l})"
                     for c, n, d, p, se, l in K.CELL_CLASSES)
_scen = ", ".join(f"('{s}', '{f}', {l}::DOUBLE)" for s, f, l in K.SCENARIOS)
_levels = "[0.05, 0.25, 0.5, 0.75, 0.9, 0.95]"


def _roll(h: int) -> str:
    """Rate and critical length of the last ``h`` slots before boundary ``e`` (theta join over window pairs)."""
    return f"""SELECT cell_id, e, arg_max(len, k) AS crit, max(r) AS rate FROM (
        SELECT a.cell_id, unnest(range(b.slot, least(a.slot + {h}, (SELECT n FROM weeks)) + 1)) AS e, b.slot - a.slot AS len,
               (b.cs - a.cs) / (b.slot - a.slot + a.deadline)::DOUBLE AS r,
               {{'r': (b.cs - a.cs) / (b.slot - a.slot + a.deadline)::DOUBLE, 's': -a.slot, 'e': -b.slot}} AS k
        FROM pre a JOIN pre b ON a.cell_id = b.cell_id AND b.slot BETWEEN a.slot + 1 AND a.slot + {h}) GROUP BY ALL"""


def _feat(t: int, tau: int, roll: str) -> str:
    h = t + tau
    lags = ",\n".join(
        f"CASE WHEN o.obs_slot - {k * h} > 0 THEN (SELECT avg(s.fh_bits) FROM slots s WHERE s.cell_id = o.cell_id AND s.slot >= "
        f"greatest(o.obs_slot - {(k + 1) * h}, 0) AND s.slot < o.obs_slot - {k * h}) ELSE 0.0 END AS lag_mean_{k + 1}" for k in range(6))
    ew = ",\n".join(
        f"""coalesce((SELECT sum(s.fh_bits * pow({1 - 2 / (w + 1.0)!r}, o.obs_slot - 1 - s.slot)) / sum(pow({1 - 2 / (w + 1.0)!r}, o.obs_slot - 1 - s.slot))
        FROM slots s WHERE s.cell_id = o.cell_id AND s.slot < o.obs_slot AND s.slot >= o.obs_slot - {6 * w}), 0.0) AS ewma_{w}""" for w in (t, 10 * t))
    last = ",\n".join(
        f"coalesce((SELECT s.fh_bits::DOUBLE FROM slots s WHERE s.cell_id = o.cell_id AND s.slot = o.obs_slot - {k}), 0.0) AS last_slot_{k}"
        for k in range(1, 5))
    rl = ",\n".join(
        f"coalesce((SELECT r.rate FROM {roll} r WHERE r.cell_id = o.cell_id AND r.e = o.obs_slot - {k * h}), 0.0) AS rstar_lag_{k + 1}"
        for k in range(3))
    return f"""SELECT o.*, list_avg(lags) AS lag_mean, list_stddev_pop(lags) AS lag_std, list_max(lags) AS lag_max FROM (
      SELECT o.*, [lag_mean_1, lag_mean_2, lag_mean_3, lag_mean_4, lag_mean_5, lag_mean_6] AS lags FROM (
      SELECT o.*, {lags}, {ew}, {last}, {rl},
        (SELECT r.rate FROM {roll} r WHERE r.cell_id = o.cell_id AND r.e = o.obs_slot + {h}) AS label,
        (SELECT avg(s.fh_bits) FROM slots s WHERE s.cell_id = o.cell_id AND s.slot >= o.obs_slot AND s.slot < o.obs_slot + {h}) AS label_mean
      FROM (SELECT link_id, cell_id, deadline, se, slot AS obs_slot, slot + {tau} AS epoch FROM slots WHERE (slot + {tau}) % {t} = 0) o) o) o"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "classes": ((), f"SELECT * FROM (VALUES {_classes}) v(class, name, deadline, priority, se, layers)"),
    "scenarios": ((), f"SELECT * FROM (VALUES {_scen}) v(scenario, family, load)"),
    "hits": ((), """SELECT l_suppkey AS cell_id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7 AS slot,
        CAST(round(l_quantity) AS BIGINT) AS fh_bits FROM lineitem"""),
    "weeks": (("hits",), "SELECT max(slot) + 1 AS n FROM hits"),
    "slots": (("hits", "classes", "weeks"), """SELECT g.cell_id // 8 AS link_id, g.cell_id, g.slot, coalesce(h.fh_bits, 0)::BIGINT AS fh_bits,
        c.class, c.name, c.deadline, c.priority, c.se, c.layers, (coalesce(h.fh_bits, 0) * 100)::BIGINT AS arrivals_bits
        FROM (SELECT cell_id, s.slot FROM (SELECT DISTINCT cell_id FROM hits) CROSS JOIN range((SELECT n FROM weeks)) s(slot)) g
        JOIN classes c ON c.class = g.cell_id % 8
        LEFT JOIN (SELECT cell_id, slot, sum(fh_bits) AS fh_bits FROM hits GROUP BY ALL) h ON h.cell_id = g.cell_id AND h.slot = g.slot"""),
    "event_hits": ((), """SELECT user_id AS cell_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS slot,
        CAST(round(value * 100) AS BIGINT) AS bits, event_type, event_id FROM events"""),
    "event_slots": (("event_hits",), """SELECT g.cell_id, g.slot, coalesce(h.bits, 0)::BIGINT AS bits
        FROM (SELECT cell_id, s.slot FROM (SELECT DISTINCT cell_id FROM event_hits) CROSS JOIN range((SELECT max(slot) + 1 FROM event_hits)) s(slot)) g
        LEFT JOIN (SELECT cell_id, slot, sum(bits) AS bits FROM event_hits GROUP BY ALL) h ON h.cell_id = g.cell_id AND h.slot = g.slot"""),
    "pre": (("slots",), """SELECT cell_id, deadline, slot, sum(fh_bits) OVER (PARTITION BY cell_id ORDER BY slot)::BIGINT - fh_bits AS cs FROM slots
        UNION ALL SELECT cell_id, any_value(deadline), (SELECT n FROM weeks), sum(fh_bits)::BIGINT FROM slots GROUP BY cell_id"""),
    "roll5": (("pre",), _roll(5)),
    "roll22": (("pre",), _roll(22)),
    "feat5": (("slots", "roll5"), _feat(4, 1, "roll5")),
    "epochs5": (("slots",), """SELECT link_id, cell_id, deadline, priority, se, slot AS obs_slot, slot + 1 AS epoch FROM slots WHERE (slot + 1) % 4 = 0"""),
    "epochs22": (("slots",), """SELECT link_id, cell_id, deadline, priority, se, slot AS obs_slot, slot + 2 AS epoch FROM slots WHERE (slot + 2) % 20 = 0"""),
    "fc5": (("epochs5", "roll5"), f"""SELECT o.link_id, o.cell_id, o.epoch, o.obs_slot,
        quantile_cont(r.rate, {_levels}) AS q FROM epochs5 o JOIN roll5 r ON r.cell_id = o.cell_id AND r.e <= o.obs_slot
        AND r.e >= 5 AND (o.obs_slot - r.e) % 5 = 0 AND r.e > o.obs_slot - 150 GROUP BY ALL"""),
    "vol5": (("epochs5", "roll5"), """SELECT o.link_id, o.cell_id, o.epoch, o.obs_slot, least(any_value(o.deadline) + avg(r.crit), 4.0) AS volume
        FROM epochs5 o JOIN roll5 r ON r.cell_id = o.cell_id AND r.e <= o.obs_slot
        AND r.e >= 5 AND (o.obs_slot - r.e) % 5 = 0 AND r.e > o.obs_slot - 150 GROUP BY o.link_id, o.cell_id, o.epoch, o.obs_slot"""),
    "obs5": (("epochs5", "slots"), """SELECT o.link_id, o.cell_id, o.epoch, o.obs_slot, o.deadline,
        coalesce(sum(s.fh_bits) FILTER (s.slot >= o.obs_slot - 3), 0)::DOUBLE AS queue_fh,
        greatest(least(o.obs_slot - 1 - coalesce(max(s.slot) FILTER (s.fh_bits = 0), -1), o.deadline), 0)::BIGINT AS hol_age
        FROM epochs5 o LEFT JOIN slots s ON s.cell_id = o.cell_id AND s.slot < o.obs_slot AND s.slot >= o.obs_slot - 30 GROUP BY o.link_id, o.cell_id, o.epoch, o.obs_slot, o.deadline"""),
    "ewma5": (("epochs5", "slots"), """SELECT o.cell_id, o.epoch, sum(s.fh_bits * pow(0.6, o.obs_slot - 1 - s.slot)) / sum(pow(0.6, o.obs_slot - 1 - s.slot)) AS ewma
        FROM epochs5 o JOIN slots s ON s.cell_id = o.cell_id AND s.slot < o.obs_slot AND s.slot >= o.obs_slot - 24 GROUP BY ALL"""),
    # one row per (link, epoch, cell) of the decisions that have history and a full horizon
    "dec": (("obs5", "fc5", "vol5", "ewma5", "roll5", "classes", "slots"), """SELECT d.*, 150.0::DOUBLE AS cap, 360.0::DOUBLE AS capacity,
        d.queue_fh / least(greatest(d.deadline - d.hol_age - 1 + 1, ceil(d.deadline / 2.0)), 4.0)::DOUBLE AS backlog,
        d.priority * least(greatest(5.0 / d.deadline, 0.25), 1.0)::DOUBLE AS weight FROM (
        SELECT o.link_id, o.cell_id, o.epoch, o.obs_slot, o.deadline, c.priority, o.queue_fh, o.hol_age, w.ewma, p.rate AS persist, l.rate AS label,
          (SELECT avg(s.fh_bits) FROM slots s WHERE s.cell_id = o.cell_id AND s.slot >= o.obs_slot AND s.slot < o.obs_slot + 5) AS label_mean,
          f.q, v.volume
        FROM obs5 o JOIN classes c ON c.class = o.cell_id % 8
        JOIN fc5 f ON f.cell_id = o.cell_id AND f.epoch = o.epoch
        JOIN vol5 v ON v.cell_id = o.cell_id AND v.epoch = o.epoch
        JOIN ewma5 w ON w.cell_id = o.cell_id AND w.epoch = o.epoch
        JOIN roll5 p ON p.cell_id = o.cell_id AND p.e = o.obs_slot
        JOIN roll5 l ON l.cell_id = o.cell_id AND l.e = o.obs_slot + 5
        WHERE o.obs_slot >= 35 AND o.epoch <= (SELECT n FROM weeks) - 4 - 1) d"""),
    "runs": ((), """SELECT o_orderpriority AS scenario, c_mktsegment AS method, o_orderkey % 20 AS seed,
        sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 5e8 AS wvr,
        sum(CAST(round(c_acctbal * 100) AS BIGINT))::DOUBLE / count(*) / 1e7 AS vr,
        max(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e8 AS ll, min(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e8 AS embb,
        count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""),
    "run_slots": (("classes", "weeks"), """SELECT l_suppkey // 8 AS link_id, l_suppkey AS cell_id, slot, age, deadline, priority, name, bits AS arrived,
        CASE WHEN l_returnflag = 'R' THEN bits ELSE 0 END AS violated, CASE WHEN l_returnflag = 'R' THEN 0 ELSE bits END AS served FROM (
        SELECT l_suppkey, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7 AS slot,
        CAST(round(l_quantity) AS BIGINT) AS bits, l_returnflag, l_linenumber AS age FROM lineitem) JOIN classes c ON c.class = l_suppkey % 8
        WHERE slot >= 0"""),
    "bench_rows": ((), """SELECT l_linenumber::BIGINT AS dim, l_returnflag AS method, l_extendedprice AS ms, l_discount AS residual, l_tax AS rel_err FROM lineitem"""),
    "vectors": ((), "SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings"),
    "coords": (("vectors",), "SELECT id, label, unnest(range(64)) AS pos, unnest(vec) AS x FROM vectors"),
}


def build(using: list[str], body: str, recursive: bool = False) -> str:
    """``WITH`` the named views and all they need, in dependency order, then ``body``.

    A body that brings views of its own starts with ``, name AS (...)``.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in using:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    body = body.strip()
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"
