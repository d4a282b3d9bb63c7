"""Queries on records built from exports, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.catalog import current_sessions
from almanac.plans.rollup_queries import S
from almanac.plans.search_queries import _SQ
from almanac.session import table
from almanac.sources import records


def _names(spark, d):
    refs = F.transform("speakers.moreInfoUrl", lambda x: F.nullif(F.regexp_extract(x, r"/speaker/(\d+)", 1), F.lit("")))
    s = current_sessions(table(spark, d, "classified_sessions").select("id", refs.alias("refs"), F.col("speakers.name").alias("names")))
    people = s.select(F.explode(F.arrays_zip("refs", "names")).alias("x")).select(F.col("x.refs").alias("ref"), F.col("x.names").alias("name"))
    return records.looked_up(s.select("id", "refs"), people).select("id", F.array_join("names", "; ").alias("names"))


def _artifact(spark, d):
    from almanac.sources.sinks import availability_artifact

    fields = ["id", "url", "remaining_capacity", "capacity", "registrant_count", "session_category", "room"]
    return availability_artifact(current_sessions(table(spark, d, "classified_sessions").select(*fields)))


QUERIES = {
    "canonical_earlier": lambda spark, d: records.canonical_earlier(table(spark, d, "sessions_25_speakers")),
    "speaker_lookup": _names,
    "first_lines": lambda spark, d: table(spark, d, "documents").filter("text is not null").select("doc_id", records.first_line(F.col("text")).alias("first_line")),
    "availability_artifact": _artifact,
}

ORACLES = {
    "canonical_earlier": f"WITH o AS (SELECT DISTINCT code, title, speakers FROM sessions_25_speakers WHERE code IS NOT NULL), c AS (SELECT code, pos, {_SQ.format('x.company')} AS co FROM (SELECT code, unnest(speakers) AS x, unnest(range(len(speakers))) AS pos FROM o)), f AS (SELECT code, co, min(pos) AS p FROM c WHERE co <> '' GROUP BY ALL), g AS (SELECT code, string_agg(co, '; ' ORDER BY p) AS companies FROM f GROUP BY code) SELECT o.code AS id, o.title, CASE WHEN o.speakers IS NULL THEN NULL ELSE coalesce(g.companies, '') END AS companies, coalesce(CAST(len(o.speakers) AS INTEGER), 0) AS n_speakers, CAST(NULL AS INTEGER) AS capacity FROM o LEFT JOIN g USING (code)",
    "speaker_lookup": f"WITH {S}, x AS (SELECT id, pos, nullif(regexp_extract(p.moreInfoUrl, '/speaker/(\\d+)', 1), '') AS ref, p.name AS name FROM (SELECT id, unnest(speakers) AS p, unnest(range(len(speakers))) AS pos FROM s)), n AS (SELECT ref, max(name) AS name FROM x WHERE ref IS NOT NULL GROUP BY ref), g AS (SELECT id, string_agg(coalesce(n.name, 'missing:' || coalesce(x.ref, '?')), '; ' ORDER BY pos) AS names FROM x LEFT JOIN n ON n.ref = x.ref GROUP BY id) SELECT s.id, coalesce(g.names, '') AS names FROM s LEFT JOIN g USING (id)",
    "first_lines": f"SELECT doc_id, {_SQ.format('string_split(regexp_replace(text, chr(13) || chr(10) || chr(124) || chr(13), chr(10), chr(103)), chr(10))[1]')} AS first_line FROM documents WHERE text IS NOT NULL",
    "availability_artifact": f"WITH {S} SELECT url, coalesce(remaining_capacity, '') AS remaining_capacity, coalesce(capacity, '') AS capacity, coalesce(registrant_count, '') AS registrant_count, coalesce(session_category, '') AS session_category, coalesce(room, '') AS room FROM s WHERE url <> ''",
}
