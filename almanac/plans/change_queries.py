"""Queries on what changed between bursts of snapshots, and the SQL that checks them."""

from __future__ import annotations

from almanac.operators import changes, diff, history
from almanac.plans.history_queries import _BAND, _TOK, SNAP
from almanac.plans.rollup_queries import S
from almanac.session import table


def _merged(spark, d):
    groups = history.burst_groups(table(spark, d, "snapshot_index"))
    return diff.with_previous(table(spark, d, "snapshot_sessions"), groups)


def _scores(spark, d):
    return changes.replacement_scores(changes.with_record(_merged(spark, d), table(spark, d, "classified_sessions")))


QUERIES = {
    "snapshot_comparison": lambda spark, d: changes.comparison(_merged(spark, d)),
    "snapshot_changes": lambda spark, d: changes.classified_changes(_merged(spark, d)),
    "replacement_scores": _scores,
}

_MERGED = f"""
WITH {SNAP}, {S}, apart AS (SELECT order_index, CASE WHEN snapshot_ts IS NULL OR lag(snapshot_ts) OVER w IS NULL OR epoch_us(snapshot_ts) - epoch_us(lag(snapshot_ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS a FROM snapshot_index WINDOW w AS (ORDER BY order_index)),
burst AS (SELECT order_index, sum(a) OVER (ORDER BY order_index) AS g FROM apart), last AS (SELECT max(order_index) AS order_index FROM burst WHERE order_index IN (SELECT order_index FROM snap) GROUP BY g),
pair AS (SELECT * FROM (SELECT lag(order_index) OVER (ORDER BY order_index) AS prev_index, order_index AS cur_index FROM last) WHERE prev_index IS NOT NULL),
prv AS (SELECT pair.*, snap.* FROM pair JOIN snap ON snap.order_index = prev_index), cur AS (SELECT pair.*, snap.* FROM pair JOIN snap ON snap.order_index = cur_index),
p AS (SELECT coalesce(p.session_id, c.session_id) AS session_id, coalesce(p.prev_index, c.prev_index) AS prev_index, coalesce(p.cur_index, c.cur_index) AS cur_index, p.session_id IS NOT NULL AS was, c.session_id IS NOT NULL AS here,
  p.title AS pt, c.title AS ct, p.room AS pr, c.room AS cr, p.date_text AS pd, c.date_text AS cd, p.start_time_text AS ps, c.start_time_text AS cs, p.remaining_capacity AS pc, c.remaining_capacity AS cc
  FROM prv p FULL JOIN cur c ON p.prev_index = c.prev_index AND p.session_id = c.session_id),
ch AS (SELECT prev_index, cur_index, session_id, concat_ws(',', CASE WHEN coalesce(pt, '') <> coalesce(ct, '') THEN 'title' END, CASE WHEN coalesce(pd, '') <> coalesce(cd, '') THEN 'date_text' END, CASE WHEN coalesce(ps, '') <> coalesce(cs, '') THEN 'start_time_text' END, CASE WHEN coalesce(pr, '') <> coalesce(cr, '') THEN 'room' END) AS material FROM p WHERE was AND here)
"""
_PB, _CB = _BAND.format("pc"), _BAND.format("cc")

ORACLES = {
    "snapshot_changes": _MERGED + "SELECT prev_index, cur_index, session_id, material, '' AS minor FROM ch WHERE material <> ''",
    "snapshot_comparison": _MERGED
    + f""", mv AS (SELECT prev_index, cur_index, CASE WHEN count(*) OVER (PARTITION BY session_id) >= 2 THEN 'unstable' WHEN here THEN 'added' ELSE 'removed' END AS kind FROM p WHERE was <> here),
k AS (SELECT * FROM mv UNION ALL SELECT prev_index, cur_index, 'material' FROM ch WHERE material <> '' UNION ALL SELECT prev_index, cur_index, 'reopened' FROM p WHERE was AND here AND {_PB} = 'f' AND {_CB} = 'n'
  UNION ALL SELECT prev_index, cur_index, 'filled' FROM p WHERE was AND here AND {_PB} <> 'f' AND {_CB} = 'f' UNION ALL SELECT prev_index, cur_index, 'full' FROM p WHERE here AND {_CB} = 'f'),
n AS (SELECT pair.prev_index, pair.cur_index, {", ".join(f"count(*) FILTER (kind = '{x}') AS \"{x}\"" for x in ("added", "removed", "unstable", "material", "minor", "reopened", "filled", "full"))} FROM pair LEFT JOIN k USING (prev_index, cur_index) GROUP BY ALL)
SELECT *, added + removed + unstable + material + reopened + "full" > 0 AS meaningful FROM n""",
    "replacement_scores": _MERGED
    + """, x AS (SELECT id, nullif(end_time_text, '') AS e, list_distinct(list_filter(list_transform(coalesce(topics, []), lambda t: trim(lower(t))), lambda t: t <> '')) AS t, list_distinct(list_filter(list_transform(coalesce(speakers, []), lambda s: trim(lower(s.name))), lambda t: t <> '')) AS s FROM s),
a AS (SELECT p.*, x.* FROM p LEFT JOIN x ON id = session_id WHERE was AND NOT here), b AS (SELECT p.*, x.* FROM p LEFT JOIN x ON id = session_id WHERE here AND NOT was),
j AS (SELECT a.prev_index, a.cur_index, a.session_id AS removed_id, b.session_id AS added_id, coalesce(a.pd <> '' AND a.pd = b.cd, false) AS d, coalesce(a.ps <> '' AND a.ps = b.cs, false) AS st, coalesce(a.e = b.e, false) AS en, coalesce(a.pr <> '' AND a.pr = b.cr, false) AS r, coalesce(len(list_intersect(a.t, b.t)), 0) AS nt, coalesce(len(list_intersect(a.s, b.s)), 0) AS ns FROM a JOIN b USING (prev_index)),
z AS (SELECT prev_index, cur_index, removed_id, added_id, CAST(CASE WHEN d THEN 3 ELSE 0 END + CASE WHEN st THEN 4 ELSE 0 END + CASE WHEN en THEN 2 ELSE 0 END + CASE WHEN r THEN 4 ELSE 0 END + least(nt, 3) + least(2 * ns, 4) AS INTEGER) AS score,
  concat_ws(',', CASE WHEN d THEN 'day' END, CASE WHEN st THEN 'start' END, CASE WHEN en THEN 'end' END, CASE WHEN r THEN 'room' END, CASE WHEN nt > 0 THEN 'topics' END, CASE WHEN ns > 0 THEN 'speakers' END) AS reasons FROM j)
SELECT * FROM z WHERE score >= 7""",
}
