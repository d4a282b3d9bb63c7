"""Queries of the numbered problems that belong to the core, and the SQL that checks them."""

from __future__ import annotations

from almanac.operators.iblt_diff import session_changes
from almanac.operators.merkle_history import appended_history, p1_found, session_history
from almanac.plans.history_queries import SNAP
from almanac.session import table

QUERIES = {
    "p1_found": lambda spark, d: p1_found(table(spark, d, "snapshot_sessions"), table(spark, d, "snapshot_index")),
    "p1_history": lambda spark, d: session_history(table(spark, d, "snapshot_sessions"), table(spark, d, "snapshot_index")),
    "p1_appended": lambda spark, d: appended_history(table(spark, d, "snapshot_sessions"), table(spark, d, "snapshot_index"), 3),
    "p2_found": lambda spark, d: session_changes(table(spark, d, "snapshot_sessions"), table(spark, d, "snapshot_index")),
}

_WHITE = r"[\s\x{85}\p{Z}]+"
_FOLD = "nullif(trim(regexp_replace(replace(replace(replace(replace(lower({0}), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '{1}', ' ', 'g')), '')"
_TIME = "nullif(replace(trim(regexp_replace(lower(start_time_text), '{0}', ' ', 'g')), '.', ''), '')"
_HOUR = r"CAST(nullif(regexp_extract(s, '^(\d+):', 1), '') AS INTEGER)"
_ORDER = f"""
WITH {SNAP}, ord AS (SELECT order_index, row_number() OVER (ORDER BY snapshot_ts NULLS LAST, order_index) AS o FROM snapshot_index WHERE order_index IN (SELECT order_index FROM snapshot_sessions)),
v AS (SELECT session_id, o, order_index, remaining_capacity AS m, registrant_count AS g, {_FOLD.format("room", _WHITE)} AS r, {_FOLD.format("title", _WHITE)} AS t, {_TIME.format(_WHITE)} AS s FROM snap JOIN ord USING (order_index))
"""
_RUNS = (
    _ORDER
    + """, f AS (SELECT session_id, o, order_index, last_value(m IGNORE NULLS) OVER w AS m, last_value(g IGNORE NULLS) OVER w AS g, last_value(r IGNORE NULLS) OVER w AS r FROM v WINDOW w AS (PARTITION BY session_id ORDER BY o ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN lag(o) OVER w = o - 1 AND lag(m) OVER w IS NOT DISTINCT FROM m AND lag(g) OVER w IS NOT DISTINCT FROM g AND lag(r) OVER w IS NOT DISTINCT FROM r THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY session_id ORDER BY o)),
k AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY o) AS run FROM b)
"""
)

ORACLES = {
    "p1_found": _RUNS + "SELECT session_id, arg_min(order_index, o) AS from_index, arg_max(order_index, o) AS to_index FROM k GROUP BY session_id, run",
    "p1_history": _RUNS + "SELECT session_id, arg_min(order_index, o) AS from_index, arg_max(order_index, o) AS to_index, max(m) AS remaining_capacity, max(g) AS registrant_count, max(r) AS room FROM k GROUP BY session_id, run",
    "p1_appended": _RUNS + "SELECT session_id, arg_min(order_index, o) AS from_index, arg_max(order_index, o) AS to_index, max(m) AS remaining_capacity, max(g) AS registrant_count, max(r) AS room FROM k GROUP BY session_id, run",
    "p2_found": _ORDER
    + rf""", x AS (SELECT session_id, o, order_index, t, r, CASE WHEN s IS NULL THEN NULL WHEN s LIKE '%m' THEN {_HOUR} % 12 ELSE {_HOUR} END * 60 + CAST(nullif(regexp_extract(s, ':(\d+)', 1), '') AS INTEGER) + CASE WHEN s LIKE '%pm' THEN 720 ELSE 0 END AS s FROM v),
pair AS (SELECT a.o AS o, a.order_index AS prev_index, b.order_index AS cur_index FROM ord a JOIN ord b ON b.o = a.o + 1),
j AS (SELECT coalesce(p.o, c.o - 1) AS o, coalesce(p.session_id, c.session_id) AS session_id, p.o AS po, c.o AS co, (p.t IS DISTINCT FROM c.t OR p.r IS DISTINCT FROM c.r OR p.s IS DISTINCT FROM c.s) AS other FROM x p FULL JOIN x c ON p.session_id = c.session_id AND c.o = p.o + 1)
SELECT prev_index, cur_index, session_id, CASE WHEN po IS NULL THEN 'added' WHEN co IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j JOIN pair USING (o) WHERE po IS NULL OR co IS NULL OR other""",
}
