"""Queries on snapshot history and on differences between snapshots, with the SQL that checks them."""

from __future__ import annotations

from almanac.operators import diff, history
from almanac.session import table


def _facts(spark, d):
    return table(spark, d, "snapshot_sessions")


def _index(spark, d):
    return table(spark, d, "snapshot_index")


def _summary(spark, d):
    return history.session_summary(_facts(spark, d), _index(spark, d))


def _pairs(spark, d):
    return diff.with_previous(_facts(spark, d))


def _crowded(spark, d):
    history.register_views(_facts(spark, d), _index(spark, d))
    return history.ask(spark, "SELECT date_text, count(*) AS sessions, max(latest_fill_pct) AS fullest FROM fast_fill_candidates WHERE presence_count >= :least AND latest_fill_pct >= :fill GROUP BY date_text", least=2, fill=50)


QUERIES = {
    "first_meaningful": lambda spark, d: history.first_meaningful(_facts(spark, d)),
    "crowded_days_sql": _crowded,
    "session_summary": _summary,
    "top_fillers": lambda spark, d: history.top_fillers(_summary(spark, d)),
    "flappy": lambda spark, d: history.flappy(_summary(spark, d)),
    "session_history": lambda spark, d: history.history_of(_facts(spark, d), _index(spark, d), "1000042"),
    "snapshot_sizes": lambda spark, d: history.snapshot_sizes(_facts(spark, d), _index(spark, d)),
    "burst_merge": lambda spark, d: history.burst_groups(_index(spark, d)),
    "pair_resolution": lambda spark, d: history.refresh_issues(_facts(spark, d), _index(spark, d)),
    "presence_runs": lambda spark, d: history.presence_runs(_facts(spark, d)),
    "pair_added_removed": lambda spark, d: diff.added_removed(_pairs(spark, d)),
    "pair_rescued": lambda spark, d: diff.rescued(_pairs(spark, d)),
    "pair_availability": lambda spark, d: diff.availability_comparison(_pairs(spark, d)),
    "pair_deltas_top": lambda spark, d: diff.largest_deltas(_pairs(spark, d)),
    "pair_field_changes": lambda spark, d: diff.field_changes(_pairs(spark, d)),
    "pair_moved_renamed": lambda spark, d: diff.moves_and_renames(_pairs(spark, d)),
    "pair_summary": lambda spark, d: diff.diff_summary(_pairs(spark, d)),
    "pair_change_kinds": lambda spark, d: diff.change_kinds(_pairs(spark, d)),
    "pair_unstable": lambda spark, d: diff.flappy_demoted(_pairs(spark, d)),
    "replacement_candidates": lambda spark, d: diff.replacement_candidates(_pairs(spark, d)),
    "replacement_greedy": lambda spark, d: diff.greedy_replacements(diff.replacement_candidates(_pairs(spark, d))),
}

#: The row of each session and snapshot that counts.
SNAP = r"""
snap AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, order_index ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, url DESC NULLS LAST, capacity DESC NULLS LAST, remaining_capacity DESC NULLS LAST, registrant_count DESC NULLS LAST, room DESC NULLS LAST, date_text DESC NULLS LAST, start_time_text DESC NULLS LAST) AS rn, count(*) OVER (PARTITION BY session_id, order_index) AS n_rows
  FROM (SELECT * REPLACE (regexp_replace(session_id, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS session_id) FROM snapshot_sessions WHERE order_index IS NOT NULL) WHERE session_id <> '') WHERE rn = 1)
"""
SUMMARY = f"""
WITH {SNAP}, r AS (SELECT s.*, i.snapshot_ts AS ts FROM snap s JOIN snapshot_index i USING (order_index)),
present AS (SELECT k.session_id, i.order_index, s.session_id IS NOT NULL AS here FROM (SELECT DISTINCT session_id FROM snap) k CROSS JOIN snapshot_index i LEFT JOIN snap s ON s.session_id = k.session_id AND s.order_index = i.order_index),
turns AS (SELECT session_id, count(*) FILTER (here <> was) AS transition_count FROM (SELECT *, lag(here) OVER (PARTITION BY session_id ORDER BY order_index) AS was FROM present) GROUP BY session_id),
base AS (SELECT session_id, arg_max({{'t': title, 'u': url, 'r': room, 'd': date_text, 's': start_time_text}}, order_index) AS l, arg_min(ts, order_index) AS first_seen_ts, arg_max(ts, order_index) AS last_seen_ts,
  CAST(sum(n_rows) AS BIGINT) AS presence_count,
  arg_min(registrant_count, order_index) FILTER (registrant_count IS NOT NULL) AS first_registrants, arg_max(registrant_count, order_index) FILTER (registrant_count IS NOT NULL) AS last_registrants, max(registrant_count) AS max_registrants,
  arg_min(remaining_capacity, order_index) FILTER (remaining_capacity IS NOT NULL) AS first_remaining, arg_max(remaining_capacity, order_index) FILTER (remaining_capacity IS NOT NULL) AS last_remaining, min(remaining_capacity) AS min_remaining,
  arg_min(capacity, order_index) FILTER (capacity > 0) AS capacity, arg_max(capacity, order_index) FILTER (capacity > 0) AS last_capacity,
  max(CASE WHEN capacity <> 0 THEN registrant_count::DOUBLE / capacity END) AS max_fill_ratio FROM r GROUP BY session_id),
days AS (SELECT *, greatest((epoch_us(last_seen_ts) - epoch_us(first_seen_ts)) / 86400e6, 0.0) AS days_observed, last_registrants - first_registrants AS registrant_growth, first_remaining - last_remaining AS remaining_drop FROM base),
summary AS (SELECT session_id, l.t AS title, l.u AS url, first_seen_ts, last_seen_ts, presence_count, (SELECT count(*) FROM snapshot_index) AS snapshot_count, transition_count, first_registrants, last_registrants, max_registrants, first_remaining, last_remaining, min_remaining, capacity, registrant_growth, remaining_drop, days_observed,
  CASE WHEN days_observed > 0 THEN registrant_growth / days_observed END AS registrants_per_day, CASE WHEN days_observed > 0 THEN remaining_drop / days_observed END AS seats_taken_per_day, last_registrants::DOUBLE / last_capacity AS latest_fill_ratio, max_fill_ratio, l.r AS room, l.d AS date_text, l.s AS start_time_text FROM days JOIN turns USING (session_id)),
scored AS (SELECT *, CASE WHEN capacity > 0 THEN round(100.0::DOUBLE * last_registrants / capacity, 1) END AS latest_fill_pct,
  round(coalesce(registrants_per_day, 0) * 0.55::DOUBLE + coalesce(100.0::DOUBLE * max_fill_ratio, 0) * 0.2::DOUBLE + coalesce(registrant_growth, 0)::DOUBLE * 0.15::DOUBLE + coalesce(seats_taken_per_day, 0) * 0.1::DOUBLE - transition_count * 8.0::DOUBLE, 2) AS fast_fill_score FROM summary)
"""
PAIRS = f"""
WITH {SNAP}, seq AS (SELECT order_index, lag(order_index) OVER (ORDER BY order_index) AS before FROM (SELECT DISTINCT order_index FROM snap)), pair AS (SELECT before AS prev_index, order_index AS cur_index FROM seq WHERE before IS NOT NULL),
prv AS (SELECT pair.*, snap.* FROM pair JOIN snap ON snap.order_index = prev_index), cur AS (SELECT pair.*, snap.* FROM pair JOIN snap ON snap.order_index = cur_index),
p AS (SELECT coalesce(p.session_id, c.session_id) AS session_id, coalesce(p.prev_index, c.prev_index) AS prev_index, coalesce(p.cur_index, c.cur_index) AS cur_index, p.session_id IS NOT NULL AS was, c.session_id IS NOT NULL AS here,
  p.title AS pt, c.title AS ct, p.url AS pu, c.url AS cu, p.room AS pr, c.room AS cr, p.date_text AS pd, c.date_text AS cd, p.start_time_text AS ps, c.start_time_text AS cs, p.remaining_capacity AS pc, c.remaining_capacity AS cc, p.registrant_count AS pg, c.registrant_count AS cg
  FROM prv p FULL JOIN cur c ON p.prev_index = c.prev_index AND p.session_id = c.session_id)
"""
_BAND = "CASE WHEN {0} IS NULL THEN 'u' WHEN {0} = 0 THEN 'f' ELSE 'n' END"
_CHANGED = PAIRS + ", ch AS (SELECT prev_index, cur_index, session_id, coalesce(pt, '') <> coalesce(ct, '') AS t, coalesce(pr, '') <> coalesce(cr, '') AS r, coalesce(pd, '') <> coalesce(cd, '') AS d, coalesce(ps, '') <> coalesce(cs, '') AS s FROM p WHERE was AND here)"
_CAND = PAIRS + """, cand AS (SELECT a.prev_index, a.cur_index, a.session_id AS removed_id, b.session_id AS added_id, CASE WHEN a.pd <> '' AND a.pd = b.cd THEN 3 ELSE 0 END + CASE WHEN a.ps <> '' AND a.ps = b.cs THEN 4 ELSE 0 END + CASE WHEN a.pr <> '' AND a.pr = b.cr THEN 4 ELSE 0 END AS score
FROM p a JOIN p b ON a.prev_index = b.prev_index AND a.was AND NOT a.here AND b.here AND NOT b.was)"""
_TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"

ORACLES = {
    "first_meaningful": f"WITH {SNAP}, m AS (SELECT session_id, order_index FROM snap WHERE registrant_count > 1 AND registrant_count < 1000) SELECT session_id, min(order_index) AS first_index, (SELECT min(order_index) FROM m) AS any_index FROM m GROUP BY session_id",
    "crowded_days_sql": SUMMARY + "SELECT date_text, count(*) AS sessions, max(latest_fill_pct) AS fullest FROM scored WHERE presence_count >= 2 AND latest_fill_pct >= 50 GROUP BY date_text",
    "session_summary": SUMMARY + "SELECT * FROM summary",
    "top_fillers": SUMMARY + "SELECT session_id, title, fast_fill_score, first_registrants, last_registrants, registrant_growth, round(registrants_per_day, 1) AS registrants_per_day, round(seats_taken_per_day, 1) AS seats_taken_per_day, latest_fill_pct, presence_count, transition_count, date_text, start_time_text, room FROM scored WHERE capacity IS NOT NULL AND last_registrants IS NOT NULL AND presence_count >= 2 ORDER BY fast_fill_score DESC NULLS LAST, registrant_growth DESC NULLS LAST, last_registrants DESC NULLS LAST, session_id LIMIT 20",
    "flappy": SUMMARY + "SELECT session_id, title, presence_count, snapshot_count, transition_count, first_seen_ts, last_seen_ts, first_registrants, last_registrants, room FROM summary WHERE transition_count >= 2 ORDER BY transition_count DESC, presence_count, title NULLS LAST, session_id LIMIT 20",
    "session_history": f"WITH {SNAP} SELECT file_name, snapshot_ts, registrant_count, remaining_capacity, capacity, date_text, start_time_text, room, title FROM (SELECT s.* EXCLUDE (file_name, snapshot_ts), i.file_name, i.snapshot_ts FROM snap s JOIN snapshot_index i USING (order_index)) WHERE session_id = '1000042'",
    "snapshot_sizes": f"WITH {SNAP} SELECT i.order_index, i.file_name, i.snapshot_ts, count(s.session_id) AS sessions, count(s.session_id) = 0 AS empty FROM snapshot_index i LEFT JOIN snap s USING (order_index) GROUP BY ALL",
    "burst_merge": "WITH a AS (SELECT order_index, file_name, CASE WHEN snapshot_ts IS NULL OR lag(snapshot_ts) OVER w IS NULL OR epoch_us(snapshot_ts) - epoch_us(lag(snapshot_ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS apart FROM snapshot_index WINDOW w AS (ORDER BY order_index)), g AS (SELECT *, CAST(sum(apart) OVER (ORDER BY order_index) - 1 AS BIGINT) AS group_id FROM a) SELECT order_index, file_name, group_id, max(order_index) OVER (PARTITION BY group_id) = order_index AS representative FROM g",
    "pair_resolution": f"WITH {SNAP}, n AS (SELECT i.order_index, i.file_name, i.snapshot_ts, count(s.session_id) AS sessions FROM snapshot_index i LEFT JOIN snap s USING (order_index) GROUP BY ALL), b AS (SELECT n.*, (SELECT max(m.order_index) FROM n m WHERE m.sessions > 0 AND m.order_index < n.order_index) AS prev_index FROM n), f AS (SELECT b.order_index, b.file_name, b.sessions, b.prev_index, b.sessions = 0 AS is_empty, b.prev_index IS NULL AS no_previous, coalesce(b.snapshot_ts < q.snapshot_ts, false) AS out_of_order, coalesce(b.sessions > 0 AND b.sessions < q.sessions * 0.8, false) AS shrunk FROM b LEFT JOIN n q ON q.order_index = b.prev_index) SELECT *, concat_ws(',', CASE WHEN is_empty THEN 'is_empty' END, CASE WHEN no_previous THEN 'no_previous' END, CASE WHEN out_of_order THEN 'out_of_order' END, CASE WHEN shrunk THEN 'shrunk' END) AS issues FROM f",
    "presence_runs": f"WITH {SNAP}, k AS (SELECT session_id, order_index, order_index - row_number() OVER (PARTITION BY session_id ORDER BY order_index) AS g FROM snap), r AS (SELECT session_id, min(order_index) AS first_index, max(order_index) AS last_index, count(*) AS n FROM k GROUP BY session_id, g) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first_index) AS run, first_index, last_index, n FROM r",
    "pair_added_removed": PAIRS + "SELECT prev_index, cur_index, session_id, CASE WHEN here THEN 'added' ELSE 'removed' END AS kind, coalesce(ct, pt) AS title FROM p WHERE was <> here",
    "pair_rescued": PAIRS + ", d AS (SELECT *, coalesce(cu, pu) AS url FROM p WHERE was <> here) SELECT prev_index, cur_index, session_id, CASE WHEN here THEN 'added' ELSE 'removed' END AS kind FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.prev_index = d.prev_index AND e.url = d.url AND d.url <> '' AND e.here <> d.here)",
    "pair_availability": PAIRS + f"SELECT prev_index, cur_index, count(*) FILTER (was AND here) AS overlap, count(*) FILTER (NOT was) AS added, count(*) FILTER (NOT here) AS removed, count(*) FILTER (was AND here AND {_BAND.format('pc')} <> {_BAND.format('cc')}) AS band_changes, count(*) FILTER (was AND here AND pc = 0 AND cc <> 0) AS reopened, count(*) FILTER (cc <> pc) AS seat_changes, CAST(coalesce(sum(cc - pc), 0) AS BIGINT) AS seat_delta, count(*) FILTER (cg <> pg) AS registrant_changes, CAST(coalesce(sum(cg - pg), 0) AS BIGINT) AS registrant_delta FROM p GROUP BY ALL",
    "pair_deltas_top": PAIRS + "SELECT * FROM (SELECT prev_index, cur_index, session_id, ct AS title, cc - pc AS delta, CAST(row_number() OVER (PARTITION BY prev_index ORDER BY abs(cc - pc) DESC, ct NULLS LAST, session_id) AS INTEGER) AS place FROM p WHERE cc <> pc) WHERE place <= 12",
    "pair_field_changes": _CHANGED + "SELECT prev_index, cur_index, session_id, concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN r THEN 'room' END, CASE WHEN d THEN 'date_text' END, CASE WHEN s THEN 'start_time_text' END) AS fields FROM ch WHERE t OR r OR d OR s",
    "pair_moved_renamed": _CHANGED + "SELECT prev_index, cur_index, session_id, r OR d OR s AS moved, t AS renamed FROM ch WHERE t OR r OR d OR s",
    "pair_summary": _CHANGED + ", k AS (SELECT prev_index, cur_index, CASE WHEN here THEN 'added' ELSE 'removed' END AS kind FROM p WHERE was <> here UNION ALL SELECT prev_index, cur_index, 'moved' FROM ch WHERE r OR d OR s UNION ALL SELECT prev_index, cur_index, 'renamed' FROM ch WHERE t) SELECT prev_index, cur_index, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'moved') AS moved, count(*) FILTER (kind = 'renamed') AS renamed, count(*) > 0 AS meaningful FROM k GROUP BY ALL",
    "pair_change_kinds": PAIRS + f", t AS (SELECT prev_index, cur_index, session_id, {_TOK.format('pt')} AS a, {_TOK.format('ct')} AS b FROM p WHERE was AND here AND coalesce(pt, '') <> coalesce(ct, '')), u AS (SELECT *, len(list_distinct(list_concat(a, b))) AS n FROM t), r AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(1 - len(list_intersect(a, b))::DOUBLE / n, 6) END AS ratio FROM u) SELECT prev_index, cur_index, session_id, ratio, CASE WHEN ratio >= 0.18 THEN 'material' ELSE 'minor' END AS kind FROM r",
    "pair_unstable": PAIRS + "SELECT prev_index, cur_index, session_id, CASE WHEN here THEN 'added' ELSE 'removed' END AS kind, count(*) OVER (PARTITION BY session_id) >= 2 AS unstable FROM p WHERE was <> here",
    "replacement_candidates": _CAND + "SELECT * FROM cand WHERE score >= 7",
}
