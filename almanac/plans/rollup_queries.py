"""Roll-up queries and the SQL that checks them."""

from __future__ import annotations

from almanac.operators import rollup as r
from almanac.plans.history_queries import SNAP
from almanac.session import table


def _s(spark, d):
    return table(spark, d, "classified_sessions")


def _seats(spark, d, *columns):
    return r.overlay(_s(spark, d), table(spark, d, "snapshot_sessions"), *([columns] if columns else []))


_BANDS = ("session_category", "remaining")
_TAKEN = ("date_text", "start_time_text", "end_time_text", "registrants")


HOSTS = ["zostalufasa motors", "ruzetririli systems", "fekrazetruge logistics", "danotastaho insurance", "mevorefede insurance", "vivuhipukro motors"]

QUERIES = {
    "availability_overlay": _seats,
    "availability_counts": lambda spark, d: r.availability_counts(_seats(spark, d, *_BANDS)),
    "category_fullness": lambda spark, d: r.category_fullness(_seats(spark, d, *_BANDS)),
    "label_counts": lambda spark, d: r.label_counts(_s(spark, d)),
    "label_places": lambda spark, d: r.label_places(_s(spark, d)),
    "type_and_tag_counts": lambda spark, d: r.type_and_tag_counts(_s(spark, d)),
    "heat_order": lambda spark, d: r.heat_order(_seats(spark, d, "title", *_TAKEN, "capacity", "remaining")),
    "flow_tree": lambda spark, d: r.flow_tree(_s(spark, d)),
    "company_counts": lambda spark, d: r.company_counts(_s(spark, d)),
    "company_sessions": lambda spark, d: r.company_sessions(_s(spark, d)),
    "distinct_companies": lambda spark, d: r.distinct_companies(_s(spark, d)),
    "speaker_rollup": lambda spark, d: r.speaker_rollup(_s(spark, d)),
    "word_stats": lambda spark, d: r.word_stats(_s(spark, d)),
    "hour_buckets": lambda spark, d: r.hour_buckets(_seats(spark, d, *_TAKEN)),
    "hourly_overview": lambda spark, d: r.hourly_overview(table(spark, d, "snapshot_sessions"), _s(spark, d)),
    "heat_rows": lambda spark, d: r.heat_rows(_seats(spark, d, *_TAKEN)),
    "fill_scale": lambda spark, d: r.fill_scale(_seats(spark, d, "remaining", "capacity", "registrants")),
    "time_bounds": lambda spark, d: r.time_bounds(_seats(spark, d, "start_time_text", "end_time_text")),
    "facet_values": lambda spark, d: r.facet_values(_s(spark, d)),
    "group_total": lambda spark, d: r.group_total(r.company_counts(_s(spark, d)), HOSTS),
    "day_buckets": lambda spark, d: r.day_buckets(_s(spark, d)),
    "affiliation_counts": lambda spark, d: r.affiliation_counts(table(spark, d, "sessions_25_speakers")),
    "insights": lambda spark, d: r.insights(_s(spark, d), _seats(spark, d, *_BANDS)),
}

S = "s AS (SELECT DISTINCT * FROM classified_sessions WHERE id IS NOT NULL)"
SEATS = f"""
WITH {SNAP}, {S}, latest AS (SELECT session_id, arg_max({{'m': remaining_capacity, 'c': capacity, 'g': registrant_count, 'r': room}}, order_index) AS f FROM snap GROUP BY session_id),
seats AS (SELECT id, title, session_category, start_time_text, end_time_text, date_text, CASE WHEN f IS NULL THEN try_cast(trim(s.remaining_capacity) AS INTEGER) ELSE f.m END AS remaining, CASE WHEN f IS NULL THEN try_cast(trim(s.capacity) AS INTEGER) ELSE f.c END AS capacity, CASE WHEN f IS NULL THEN try_cast(trim(s.registrant_count) AS INTEGER) ELSE f.g END AS registrants, CASE WHEN f IS NULL THEN s.room ELSE f.r END AS room FROM s LEFT JOIN latest ON session_id = id),
counts AS (SELECT category, count(*) FILTER (remaining IS NOT NULL) AS known, count(*) FILTER (remaining = 0) AS "full", count(*) FILTER (remaining <> 0) AS not_full, count(*) FILTER (remaining IS NULL) AS unknown FROM (SELECT remaining, unnest(['(all)', coalesce(session_category, '')]) AS category FROM seats) GROUP BY category)
"""
_CLOCK = r"(CAST(nullif(regexp_extract({0}, '^\s*(\d{{1,2}}):(\d{{2}})\s*([AaPp])[Mm]\s*$', 1), '') AS INTEGER) % 12 * 60 + CAST(nullif(regexp_extract({0}, '^\s*(\d{{1,2}}):(\d{{2}})\s*([AaPp])[Mm]\s*$', 2), '') AS INTEGER) + CASE WHEN regexp_extract({0}, '([AaPp])[Mm]\s*$', 1) IN ('p', 'P') THEN 720 ELSE 0 END)"
_TIMES = SEATS + f", t AS (SELECT *, {_CLOCK.format('start_time_text')} AS sm, {_CLOCK.format('end_time_text')} AS em FROM seats), h AS (SELECT *, sm // 60 AS sh, greatest(sm // 60 + 1, CAST(ceil(em / 60.0) AS INTEGER)) AS eh FROM t WHERE date_text <> '' AND sm IS NOT NULL AND em IS NOT NULL)"
_LABELS = "l AS (SELECT unnest(['ai_focus', 'theme', 'audience']) AS facet, unnest([llm.ai_focus, llm.theme, llm.audience]) AS label FROM s), labels AS (SELECT facet, label, count(*) AS n FROM l WHERE label <> '' AND NOT (facet = 'audience' AND label = 'General') GROUP BY ALL)"
_SPK = "sp AS (SELECT id, x.name AS name, x.company AS company, pos FROM (SELECT id, unnest(speakers) AS x, unnest(range(len(speakers))) AS pos FROM s)), k AS (SELECT *, regexp_replace(trim(regexp_replace(replace(lower(company), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +(inc|ltd|llc|corp|gmbh|co|plc|ag|limited|corporation)$', '') AS key FROM sp), ck AS (SELECT *, list_contains(string_split(key, ' '), 'orvanta') AS host FROM k WHERE key <> '')"
_COMP = "comp AS (SELECT key, count(DISTINCT id) AS sessions, min(company) AS company FROM ck WHERE NOT host GROUP BY key HAVING count(DISTINCT id) >= 2)"
_PLUR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in r.PLURALS.items()) + "}"
_LABEL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in r.LABELS.items()) + "}"
_WORDS = f"""raw AS (SELECT id, regexp_replace(unnest(regexp_extract_all(lower(concat_ws(' ', title, description, coalesce(array_to_string(topics, ' '), ''), coalesce(array_to_string(list_transform(speakers, lambda x: coalesce(x.company, '')), ' '), ''))), '[a-z][a-z0-9+.-]*')), '[^a-z0-9+#]+$', '') AS w FROM s),
norm AS (SELECT id, coalesce({_PLUR}[w], w) AS word FROM raw), words AS (SELECT word, count(*) AS n, count(DISTINCT id) AS sessions FROM norm WHERE (length(word) >= 3 OR word IN ('ai', 'ml', 'go')) AND word NOT IN ({", ".join(f"'{w}'" for w in [*r.STOP_WORDS, *r.HOST_WORDS])}) GROUP BY word)"""

ORACLES = {
    "availability_overlay": SEATS + "SELECT * FROM seats",
    "availability_counts": SEATS + "SELECT *, CASE WHEN known > 0 THEN round(\"full\" * 100.0::DOUBLE / known, 1) END AS full_pct FROM counts",
    "category_fullness": SEATS + ", f AS (SELECT category, \"full\", known, round(\"full\"::DOUBLE / known, 6) AS share FROM counts WHERE category <> '(all)' AND \"full\" > 0) SELECT *, row_number() OVER (ORDER BY share DESC, \"full\" DESC, category) AS place FROM f",
    "label_counts": f"WITH {S}, {_LABELS} SELECT * FROM labels",
    "flow_tree": f"WITH {S}, x AS (SELECT llm.ai_focus AS ai_focus, llm.theme AS theme, llm.audience AS audience FROM s WHERE llm.ai_focus IS NOT NULL) SELECT ai_focus, NULL AS theme, NULL AS audience, count(*) AS n, 1 AS level FROM x GROUP BY ALL UNION ALL SELECT ai_focus, theme, NULL, count(*), 2 FROM x GROUP BY ai_focus, theme UNION ALL SELECT ai_focus, theme, audience, count(*), 3 FROM x WHERE coalesce(audience, '') <> 'General' GROUP BY ai_focus, theme, audience",
    "company_counts": f"WITH {S}, {_SPK}, {_COMP} SELECT * FROM comp ORDER BY sessions DESC, key LIMIT 120",
    "company_sessions": f"WITH {S}, {_SPK} SELECT key, count(DISTINCT id) AS sessions, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM ck GROUP BY key HAVING count(DISTINCT id) >= 2",
    "distinct_companies": f"WITH {S}, {_SPK} SELECT count(DISTINCT key) AS companies, count(DISTINCT key) FILTER (NOT host) AS other_companies FROM ck",
    "speaker_rollup": rf"WITH {S}, {_SPK}, n AS (SELECT id, pos, company, trim(regexp_replace(name, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')) AS name FROM sp) SELECT name, count(*) AS n, count(DISTINCT id) AS sessions, arg_min(company, (id, pos)) FILTER (trim(coalesce(company, '')) <> '') AS company FROM n WHERE name <> '' GROUP BY name HAVING count(*) >= 2",
    "word_stats": f"WITH {S}, {_WORDS} SELECT word, coalesce({_LABEL}[word], word) AS label, n, sessions FROM words ORDER BY n DESC, word LIMIT 96",
    "label_places": f"WITH {S}, x AS (SELECT 'theme' AS level, llm.ai_focus AS parent, llm.theme AS label, list_position({r.THEME_ORDER}, llm.theme) AS pos FROM s UNION ALL SELECT 'audience', llm.theme, llm.audience, list_position({r.AUDIENCE_ORDER}, llm.audience) FROM s), c AS (SELECT level, parent, label, pos, count(*) AS n FROM x WHERE parent <> '' AND pos > 0 GROUP BY ALL) SELECT level, parent, label, n, CAST(row_number() OVER (PARTITION BY level, parent ORDER BY n DESC, pos) AS INTEGER) AS place FROM c",
    "type_and_tag_counts": f"WITH {S}, x AS (SELECT 'type' AS kind, session_category AS name FROM s UNION ALL SELECT 'tag', unnest(list_distinct(topics)) FROM s), c AS (SELECT kind, name, count(*) AS n FROM x WHERE name <> '' GROUP BY ALL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS INTEGER) AS place FROM c) SELECT * FROM p WHERE kind = 'type' OR place <= 20",
    "heat_order": _TIMES + "SELECT date_text, CAST(sh AS INTEGER) AS hour, id, CAST(row_number() OVER (PARTITION BY date_text, sh ORDER BY registrants DESC NULLS LAST, CASE WHEN capacity > 0 THEN round(100.0::DOUBLE * registrants / capacity, 6) END DESC NULLS LAST, remaining ASC NULLS LAST, title ASC NULLS LAST, id) AS INTEGER) AS place FROM h",
    "hour_buckets": _TIMES + ", e AS (SELECT date_text, id, coalesce(registrants, 0) AS reg, unnest(range(sh, eh)) AS hour FROM h) SELECT date_text, hour, count(*) AS sessions, CAST(sum(reg) AS BIGINT) AS reserved, arg_min(id, (-reg, id)) AS top_id, max(reg) AS top_registrants FROM e GROUP BY ALL",
    "hourly_overview": f"WITH {SNAP}, {S}, t AS (SELECT order_index, snap.date_text AS date_text, session_id, coalesce(snap.registrant_count, 0) AS reg, coalesce(len(s.speakers), 0) AS people, {_CLOCK.format('snap.start_time_text')} AS sm, coalesce({_CLOCK.format('s.end_time_text')}, {_CLOCK.format('snap.start_time_text')} + 60) AS em FROM snap LEFT JOIN s ON s.id = session_id), h AS (SELECT *, unnest(range(sm // 60, greatest(sm // 60 + 1, CAST(ceil(em / 60.0) AS INTEGER)))) AS hour FROM t WHERE date_text <> '' AND sm IS NOT NULL) SELECT order_index, date_text, CAST(hour AS INTEGER) AS hour, count(*) AS sessions, CAST(sum(reg) AS BIGINT) AS reserved, arg_min(session_id, (-reg, session_id)) AS top_id, max(reg) AS top_registrants, CAST(sum(people) AS BIGINT) AS speakers FROM h GROUP BY ALL",
    "heat_rows": _TIMES + "SELECT date_text, sh AS hour, CAST(sum(registrants) AS BIGINT) AS taken, count(*) AS sessions, arg_min(id, (-registrants, id)) AS top_id FROM h WHERE registrants > 1 AND registrants < 1000 GROUP BY ALL",
    "fill_scale": SEATS + ", v AS (SELECT *, coalesce(capacity < 100, true) AS is_small FROM seats WHERE registrants > 1 AND registrants < 1000), m AS (SELECT *, max(registrants) OVER (PARTITION BY is_small) AS most FROM v) SELECT id, round(coalesce(CASE WHEN capacity > 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * registrants / capacity)) END, CASE WHEN remaining <= 0 THEN 100.0::DOUBLE WHEN remaining <= 10 THEN 92.0::DOUBLE END), 4) AS fill_pct, registrants > capacity AS overbooked, is_small, round(greatest(8.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * registrants / most)), 4) AS marker_pct FROM m",
    "time_bounds": _TIMES + "SELECT CAST(greatest(0, least(95, coalesce(min(sm // 15), 0))) AS INTEGER) AS first_slot, CAST(greatest(0, least(95, coalesce(greatest(max(sm // 15), max(CAST(ceil(em / 15.0) AS INTEGER))), 95))) AS INTEGER) AS last_slot, min(sm) // 60 AS first_hour, max(sm) // 60 + 1 AS end_hour FROM t",
    "facet_values": f"WITH {S}, f AS (SELECT unnest(['date_text', 'session_category', 'room']) AS facet, unnest([date_text, session_category, room]) AS value FROM s UNION ALL SELECT 'topic', unnest(list_distinct(topics)) FROM s) SELECT facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY ALL",
    "group_total": f"WITH {S}, {_SPK}, {_COMP}, k2 AS (SELECT key, sessions, row_number() OVER (ORDER BY sessions DESC, key) AS place FROM comp), o AS (SELECT * FROM k2 WHERE place <= 120 AND key IN ({', '.join(repr(h) for h in HOSTS)})) SELECT key, place, sessions, CAST(sum(sessions) OVER () AS BIGINT) AS total FROM o",
    "day_buckets": f"WITH {S} SELECT CASE WHEN coalesce(date_text, '') = '' THEN 'UNSCHEDULED' ELSE coalesce(strftime(try_strptime(regexp_replace(date_text, '^\\w+, ', ''), '%B %d, %Y'), '%Y-%m-%d'), regexp_replace(regexp_replace(lower(date_text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) END AS bucket, count(*) AS sessions, count(DISTINCT room) AS rooms, min(id) AS first_id FROM s GROUP BY 1",
    "affiliation_counts": r"WITH o AS (SELECT DISTINCT code, speakers FROM sessions_25_speakers WHERE code IS NOT NULL), x AS (SELECT unnest(speakers) AS p FROM o), y AS (SELECT coalesce(p.affiliation, '') AS affiliation, trim(regexp_replace(p.company, '[\s\x{85}\p{Z}]+', ' ', 'g')) AS company FROM x) SELECT affiliation, company, count(*) AS n FROM y WHERE company <> '' AND company <> 'Independent' GROUP BY ALL",
    "insights": SEATS + f", {_LABELS}, {_SPK}, {_COMP}, {_WORDS} SELECT 'availability' AS section, unnest(['known', 'full', 'unknown']) AS name, unnest([known, \"full\", unknown]) AS value FROM counts WHERE category = '(all)' UNION ALL SELECT 'label:' || facet, label, n FROM labels UNION ALL SELECT * FROM (SELECT 'company', key, sessions FROM comp ORDER BY sessions DESC, key LIMIT 8) UNION ALL SELECT 'companies', 'other', count(DISTINCT key) FROM ck WHERE NOT host UNION ALL SELECT * FROM (SELECT 'word', word, n FROM words ORDER BY n DESC, word LIMIT 18)",
}
