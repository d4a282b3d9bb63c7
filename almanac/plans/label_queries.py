"""Queries on rules, vectors, refreshes, files and streams, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from almanac.operators import incremental as inc
from almanac.operators import rules as u
from almanac.operators import vectors as v
from almanac.operators.catalog import last_rows
from almanac.plans.history_queries import SNAP
from almanac.plans.rollup_queries import S
from almanac.session import shared_dir, table, written
from almanac.sources import sinks
from almanac.streaming import bursts


def _s(spark, d):
    return table(spark, d, "classified_sessions")


def _e(spark, d):
    return table(spark, d, "session_embeddings_v2")


def _facts(spark, d):
    return table(spark, d, "snapshot_sessions")


def _audit(spark, d, least=5):
    rows = written(v.valid_vectors(_e(spark, d)))
    near = v.nearest(rows.select("row_id", "u"), rows.filter("row_id % 100 = 0").select("row_id", "u"), 8)
    return v.neighbour_audit(near, rows, least)


def _vote(spark, d):
    rows = written(v.valid_vectors(_e(spark, d)))
    near = v.nearest(rows.select("row_id", "u"), rows.filter("row_id % 100 = 0").select("row_id", "u"), 9)
    return v.weighted_vote(near, rows)


def _json_round(spark, d):
    rows = last_rows(_facts(spark, d)).drop("n_rows")
    path = f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    sinks.write_snapshots(rows, path)
    back = sinks.read_snapshots(rows, path)
    return back.groupBy("order_index").agg(F.count("*").alias("sessions"), F.sum("registrant_count").alias("registrants"), F.min("title").alias("first_title"))


def _shards(spark, d):
    docs = table(spark, d, "documents")
    one = docs.filter("lang = 'en'").select("doc_id", "text", "source")
    rest = docs.filter("lang is null or lang <> 'en'").select("doc_id", "lang", "text", "source")
    return inc.united([one, rest]).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _stream(spark, d):
    static = table(spark, d, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file or a folder
    return bursts.finished_bursts(stream).select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


QUERIES = {
    "rule_classify": lambda spark, d: u.classified(_s(spark, d)),
    "reclassify": lambda spark, d: u.reclassified(u.classified(_s(spark, d))).select("id", "theme"),
    "label_carry_over": lambda spark, d: u.carried_over(_s(spark, d), _e(spark, d)),
    "label_pending": lambda spark, d: u.pending(_s(spark, d), _e(spark, d)),
    "access_rules": lambda spark, d: u.access_rules(table(spark, d, "documents")),
    "knn_exact": lambda spark, d: v.session_neighbours(_e(spark, d)),
    "weighted_vote": _vote,
    "neighbour_audit": _audit,
    "neighbour_audit_three": lambda spark, d: _audit(spark, d, 3),
    "neighbour_disagreements_three": lambda spark, d: v.disagreements(_audit(spark, d, 3)),
    "neighbour_disagreements": lambda spark, d: v.disagreements(_audit(spark, d)),
    "related_sessions": lambda spark, d: v.related(_e(spark, d), _s(spark, d)),
    "related_indexed": lambda spark, d: v.related_indexed(_e(spark, d), _s(spark, d)),
    "blocked_knn": lambda spark, d: v.blocked_neighbours(_e(spark, d)),
    "refresh_plan": lambda spark, d: inc.refresh_plan(_facts(spark, d)),
    "manifest_overlay": lambda spark, d: inc.overlaid(_facts(spark, d)),
    "dedup_survivors": lambda spark, d: inc.survivors(table(spark, d, "documents")),
    "union_shards": _shards,
    "snapshot_json": _json_round,
    "event_bursts": lambda spark, d: bursts.burst_windows(table(spark, d, "events")).select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n"),
    "event_bursts_stream": _stream,
}

_RULES = (
    f"WITH {S}, x AS (SELECT *, concat_ws(' ', title, description) AS tx FROM s), tag AS (SELECT id, CASE "
    + " ".join(f"WHEN lower(trim(t)) = '{k}' THEN '{w}'" for k, w in u.AUDIENCES.items())
    + " END AS a FROM (SELECT id, unnest(topics) AS t FROM s)), sc AS (SELECT id, a, count(*) AS n FROM tag WHERE a IS NOT NULL GROUP BY ALL), au AS (SELECT id, CASE WHEN sum(n) >= 5 AND count(*) >= 3 THEN 'General' ELSE arg_min(a, (-n, a)) END AS audience FROM sc GROUP BY id), "
    + "r AS (SELECT x.id, url, CASE WHEN " + " OR ".join(f"contains(lower(tx), '{p}')" for p in u.AI_PARTS) + " THEN 'AI' ELSE 'Not AI' END AS ai_focus, regexp_matches(tx, '(?i)\\b(?:" + "|".join(u.AI_WORDS) + ")\\b') AS sure, CASE "
    + " ".join(f"WHEN regexp_matches(tx, '(?i)\\b(?:{p})\\b') THEN '{k}'" for k, p in u.THEMES)
    + " ELSE 'Business' END AS theme, coalesce(audience, 'General') AS audience FROM x LEFT JOIN au USING (id)) "
)
_VEC = """
WITH once AS (SELECT row_id, max({'e': embedding, 't': title, 'u': url, 'l': labels}) AS b FROM session_embeddings_v2 WHERE len(embedding) = 64 AND row_id IS NOT NULL GROUP BY row_id),
vec AS (SELECT row_id, b.e AS e, b.t AS title, b.u AS url, coalesce(b.l.ai_focus, '') AS ai_focus, coalesce(b.l.theme, '') AS theme, coalesce(b.l.audience, '') AS audience FROM once WHERE list_sum(list_transform(b.e, lambda x: x * x)) > 0),
pairs AS (SELECT q.row_id AS query_id, r.row_id, round(list_cosine_similarity(q.e, r.e), 6) AS cosine FROM vec q JOIN vec r ON q.row_id % 100 = 0 AND q.row_id <> r.row_id),
knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS INTEGER) AS rank FROM pairs)
"""
_AUDIT = _VEC + """, near AS (SELECT query_id, rank, unnest(['ai_focus', 'theme', 'audience']) AS facet, unnest([ai_focus, theme, audience]) AS label FROM knn JOIN vec USING (row_id) WHERE rank <= 8), cnt AS (SELECT query_id, facet, label, count(*) AS n, min(rank) AS f FROM near GROUP BY ALL),
maj AS (SELECT query_id, facet, arg_min(label, (-n, f)) AS majority, max(n) AS n FROM cnt GROUP BY ALL), own AS (SELECT row_id AS query_id, unnest(['ai_focus', 'theme', 'audience']) AS facet, unnest([ai_focus, theme, audience]) AS own FROM vec), audit AS (SELECT query_id, facet, own, majority, n FROM maj JOIN own USING (query_id, facet) WHERE own <> majority AND n >= 5)"""
_STOPS = ", ".join(f"'{w}'" for w in v.TITLE_STOP)
_TITLE = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')), lambda t: length(t) > 2 AND t NOT IN ({_STOPS}))"
_WORDY = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9+.#/-]*')), lambda t: length(t) > 2 AND t NOT IN (" + _STOPS + "))"
_LAST2 = f"WITH {SNAP}, top AS (SELECT DISTINCT order_index FROM snapshot_sessions WHERE order_index IS NOT NULL ORDER BY 1 DESC LIMIT 2), k AS (SELECT snap.*, order_index = (SELECT max(order_index) FROM top) AS is_live FROM snap WHERE order_index IN (FROM top) AND url <> ''), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY url, is_live ORDER BY session_id DESC) = 1), a AS (SELECT * FROM o WHERE is_live), b AS (SELECT * FROM o WHERE NOT is_live)"
_BURST = "WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM a) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, b"

ORACLES = {
    "rule_classify": _RULES + "SELECT id, ai_focus, sure, theme, audience, concat_ws('; ', 'theme ' || theme, CASE WHEN sure THEN 'named as such' END) AS reasoning FROM r",
    "reclassify": _RULES + "SELECT id, CASE WHEN theme = 'App dev' AND sure THEN 'Applied AI' ELSE theme END AS theme FROM r",
    "label_carry_over": _RULES + ", o AS (SELECT url, max(labels.theme) AS ot, max(labels.ai_focus) AS oa FROM session_embeddings_v2 WHERE url <> '' GROUP BY url), j AS (SELECT r.*, ot, oa, oa IS NULL OR oa = '' OR (oa = 'Not AI' AND sure) AS redone FROM r LEFT JOIN o USING (url)) SELECT id, CASE WHEN redone THEN ai_focus ELSE oa END AS ai_focus, CASE WHEN redone THEN theme ELSE ot END AS theme, redone FROM j",
    "label_pending": f"WITH {S} SELECT id, url FROM s WHERE url IS NULL OR url NOT IN (SELECT url FROM session_embeddings_v2 WHERE labels.theme <> '' AND url IS NOT NULL)",
    "access_rules": r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(?:rsvp|list closes)\b') THEN 'list' WHEN regexp_matches(text, '(?i)\b(?:bring your badge)\b') THEN 'badge' WHEN regexp_matches(text, '(?i)\b(?:open to all|walk-ins?)\b') THEN 'open' ELSE 'unknown' END AS access, CASE WHEN regexp_matches(text, '(?i)\b(?:vegetarian)\b') THEN 'vegetarian' WHEN regexp_matches(text, '(?i)\b(?:food|dinner|snacks)\b') THEN 'food' WHEN regexp_matches(text, '(?i)\b(?:drinks|music)\b') THEN 'drinks' ELSE 'none' END AS food, nullif(regexp_extract(text, '(?:at|in) the ([A-Z][\w'']+(?: & [A-Z]\w+)?(?: [A-Z]\w+)?)', 1), '') AS place FROM documents WHERE source = 'party_invite' AND text IS NOT NULL",
    "knn_exact": _VEC + "SELECT * FROM knn WHERE rank <= 8",
    "weighted_vote": _VEC + ", vt AS (SELECT query_id, theme, round(sum(pow(greatest(cosine, 0.0), 4)), 6) AS score FROM knn JOIN vec USING (row_id) WHERE rank <= 9 GROUP BY ALL) SELECT query_id, theme, score FROM vt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, theme DESC) = 1",
    "neighbour_audit": _AUDIT + " SELECT * FROM audit",
    "neighbour_audit_three": _AUDIT.replace(">= 5", ">= 3") + " SELECT * FROM audit",
    "neighbour_disagreements_three": _AUDIT.replace(">= 5", ">= 3") + " SELECT facet, count(*) AS flagged FROM audit GROUP BY facet",
    "neighbour_disagreements": _AUDIT + " SELECT facet, count(*) AS flagged FROM audit GROUP BY facet",
    "blocked_knn": _VEC + f", w AS (SELECT row_id, unnest({_TITLE}) AS w FROM vec), tell AS (SELECT * FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING count(*) <= 0.2 * (SELECT count(*) FROM vec))), sh AS (SELECT q.row_id AS query_id, r.row_id, count(*) AS shared FROM tell q JOIN tell r ON q.w = r.w AND q.row_id % 100 = 0 AND q.row_id <> r.row_id GROUP BY ALL), kp AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, row_id DESC) <= 180) SELECT query_id, row_id, shared, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS INTEGER) AS place FROM kp JOIN pairs USING (query_id, row_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) <= 9",
    "related_indexed": _VEC
    + f""", s AS (SELECT url, max(struct_pack(id := id, t := topics, c := session_category, d := description)) AS b FROM classified_sessions WHERE id IS NOT NULL AND url <> '' GROUP BY url),
fl AS (SELECT row_id, lower(trim(title)) AS title, ai_focus, theme, audience, {_WORDY.format("coalesce(title, '')")} AS head, {_WORDY.format("concat_ws(' ', title, b.d, array_to_string(list_filter(coalesce(b.t, []), lambda x: x IS NOT NULL), ' '))")} AS tok,
  list_distinct(list_transform(list_filter(coalesce(b.t, []), lambda x: x IS NOT NULL), lambda x: lower(x))) AS tp, coalesce(lower(trim(b.c)), '') AS cat FROM vec LEFT JOIN s USING (url)),
few AS (SELECT a.row_id, count(*) FILTER (len(list_intersect(a.head, b.head)) > 0) < 50 AS wide FROM fl a, fl b WHERE a.row_id % 100 = 0 GROUP BY a.row_id),
d AS (SELECT k.query_id, k.row_id, k.cosine, a.title AS ta, b.title AS tb, a.ai_focus AS aa, b.ai_focus AS ba, a.theme AS ah, b.theme AS bh, a.audience AS au, b.audience AS bu, a.cat AS ac, b.cat AS bc, len(list_intersect(a.head, b.head)) AS hh, len(list_intersect(a.tok, b.head)) AS th, few.wide, len(list_intersect(a.tok, b.tok)) AS sh, greatest(len(a.tok), len(b.tok)) AS mt, len(list_intersect(a.tp, b.tp)) AS ti, len(list_distinct(list_concat(a.tp, b.tp))) AS tu FROM pairs k JOIN fl a ON a.row_id = k.query_id JOIN fl b ON b.row_id = k.row_id JOIN few ON few.row_id = k.query_id),
sc AS (SELECT *, round(cosine + CASE WHEN aa <> '' AND aa = ba THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN ah <> '' AND ah = bh THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN au <> '' AND au = bu THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN tu > 0 THEN ti::DOUBLE / tu ELSE 0 END * 0.06::DOUBLE + CASE WHEN mt > 0 THEN sh::DOUBLE / mt ELSE 0 END * 0.05::DOUBLE + CASE WHEN ac <> '' AND ac = bc THEN 0.015::DOUBLE ELSE 0 END, 4) AS score
  FROM d WHERE ta IS DISTINCT FROM tb AND (aa = ba OR sh > 0) AND (cosine > 0.45 OR sh > 0) AND (hh > 0 OR wide AND (th > 0 OR ti > 0 OR ac <> '' AND ac = bc OR aa <> '' AND aa = ba OR ah <> '' AND ah = bh OR au <> '' AND au = bu)))
SELECT query_id, row_id, score, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, row_id) AS INTEGER) AS place FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, row_id) <= 5""",
    "related_sessions": _VEC
    + f""", s AS (SELECT url, max(struct_pack(id := id, t := topics, c := session_category)) AS b FROM classified_sessions WHERE id IS NOT NULL AND url <> '' GROUP BY url),
fl AS (SELECT row_id, lower(trim(title)) AS title, ai_focus, theme, audience, {_TITLE} AS tok, list_distinct(list_transform(list_filter(coalesce(b.t, []), lambda x: x IS NOT NULL), lambda x: lower(x))) AS tp, lower(trim(b.c)) AS cat FROM vec LEFT JOIN s USING (url)),
d AS (SELECT k.query_id, k.row_id, k.cosine, a.title AS ta, b.title AS tb, a.ai_focus AS aa, b.ai_focus AS ba, a.theme AS ah, b.theme AS bh, a.audience AS au, b.audience AS bu, a.cat AS ac, b.cat AS bc, len(list_intersect(a.tok, b.tok)) AS sh, greatest(len(a.tok), len(b.tok)) AS mt, len(list_intersect(a.tp, b.tp)) AS ti, len(list_distinct(list_concat(a.tp, b.tp))) AS tu FROM knn k JOIN fl a ON a.row_id = k.query_id JOIN fl b ON b.row_id = k.row_id WHERE k.rank <= 50),
sc AS (SELECT *, round(cosine + CASE WHEN aa <> '' AND aa = ba THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN ah <> '' AND ah = bh THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN au <> '' AND au = bu THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN tu > 0 THEN ti::DOUBLE / tu ELSE 0 END * 0.06::DOUBLE + CASE WHEN mt > 0 THEN sh::DOUBLE / mt ELSE 0 END * 0.05::DOUBLE + CASE WHEN ac <> '' AND ac = bc THEN 0.015::DOUBLE ELSE 0 END, 4) AS score FROM d WHERE ta IS DISTINCT FROM tb AND (aa = ba OR sh > 0) AND (cosine > 0.45 OR sh > 0))
SELECT query_id, row_id, score, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, row_id) AS INTEGER) AS place FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, row_id) <= 5""",
    "refresh_plan": _LAST2 + ", m AS (SELECT url, a.url AS au, b.url AS bu, coalesce(a.title, '') = coalesce(b.title, '') AND coalesce(a.room, '') = coalesce(b.room, '') AND coalesce(a.date_text, '') = coalesce(b.date_text, '') AND coalesce(a.start_time_text, '') = coalesce(b.start_time_text, '') AS same FROM a FULL JOIN b USING (url)) SELECT url, CASE WHEN au IS NULL THEN 'gone' WHEN bu IS NULL THEN 'new' WHEN same THEN 'reuse' ELSE 'refetch' END AS action FROM m",
    "manifest_overlay": _LAST2 + " SELECT a.url, coalesce(b.title, a.title) AS title, " + ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in inc.FRESH) + " FROM a LEFT JOIN b ON a.url = b.url",
    "dedup_survivors": "SELECT session_id, arg_max(doc_id, (coalesce(captured_at, TIMESTAMP '0001-01-01'), doc_id)) AS last_doc, arg_min(doc_id, (coalesce(captured_at, TIMESTAMP '0001-01-01'), doc_id)) AS first_doc, count(*) AS n FROM documents WHERE trim(session_id) <> '' GROUP BY session_id",
    "union_shards": "SELECT source, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL",
    "snapshot_json": f"WITH {SNAP} SELECT order_index, count(*) AS sessions, CAST(sum(registrant_count) AS BIGINT) AS registrants, min(title) AS first_title FROM snap GROUP BY order_index",
    "event_bursts": _BURST,
    "event_bursts_stream": _BURST,
}
