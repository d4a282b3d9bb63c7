"""Search and text queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import search as q
from almanac.operators import texts as t
from almanac.plans.rollup_queries import _CLOCK, S
from almanac.session import table


def _s(spark, d):
    return table(spark, d, "classified_sessions")


def _d(spark, d):
    return table(spark, d, "documents")


EXPLORER = q.Filters(start_from="10:00", start_to="16:30", ai_focus="AI", availability="not-full", sponsored="no", topic="AI")
COMPANY = q.Filters(company="Mevorefede & Co", person="a")
DNF = 'title:production, "one backlog at a time", description:cost requests'
PARTY = {"lang": "en", "source": "party_invite"}

QUERIES = {
    "explorer_filter": lambda spark, d: q.search(_s(spark, d), EXPLORER, ("title",)),
    "explorer_company": lambda spark, d: q.search(_s(spark, d), q.Filters(company="mevorefede"), ("title",)),
    "explorer_person": lambda spark, d: q.search(_s(spark, d), q.Filters(person="katherine"), ("title",)),
    "explorer_ordered": lambda spark, d: q.ordered(q.search(_s(spark, d), q.Filters(theme="Security")), ["1000042"], 25).select("id", "title", "start_at"),
    "text_search_and": lambda spark, d: q.search(_s(spark, d), q.Filters(query="agent workflows"), ("title",)),
    "text_search_not": lambda spark, d: q.search(_s(spark, d), q.Filters(query="pipelines", exclude="streaming robotics"), ("title",)),
    "text_search_without": lambda spark, d: q.search(_s(spark, d), q.Filters(query="agent", exclude="data model"), ("title",)),
    "text_search_phrase": lambda spark, d: q.search(_s(spark, d), q.Filters(query='"at a time" talk'), ("title",)),
    "text_search_dnf": lambda spark, d: t.current_sessions(_s(spark, d).select("id", q.group_of(DNF).alias("matched")).filter("matched is not null")),
    "facet_filter": lambda spark, d: q.facets(_d(spark, d), **PARTY).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
    "fingerprints": lambda spark, d: t.fingerprints(_s(spark, d)),
    "session_keys": lambda spark, d: t.keys(_s(spark, d)),
    "schedule": lambda spark, d: t.schedule(_s(spark, d)),
    "clean_topics": lambda spark, d: t.clean_topics(_s(spark, d)),
    "embed_texts": lambda spark, d: t.embed_texts(_s(spark, d)),
    "html_strip": lambda spark, d: t.page_texts(_d(spark, d)),
    "url_parts": lambda spark, d: t.urls(_d(spark, d)),
    "redaction": lambda spark, d: t.redacted(_d(spark, d)),
    "readable_blocks": lambda spark, d: t.blocks(_d(spark, d)),
    "event_summaries": lambda spark, d: t.summaries(_d(spark, d)),
    "forward_fill": lambda spark, d: t.question_items(_d(spark, d)),
    "run_collapse": lambda spark, d: t.collapsed_lines(_d(spark, d)),
    "token_similarity": lambda spark, d: t.title_similarity(_s(spark, d)),
    "seat_sentences": lambda spark, d: t.seat_sentences(_s(spark, d)),
    "hrefs": lambda spark, d: t.hrefs(_s(spark, d)),
    "sponsor_fields": lambda spark, d: t.sponsor_fields(_s(spark, d)),
}

_HAY = f"WITH {S}, h AS (SELECT *, lower(concat_ws(' ', title, description, room, coalesce(array_to_string(topics, ' '), ''), coalesce(array_to_string(list_transform(speakers, lambda x: concat_ws(' ', x.name, x.company)), ' '), ''))) AS q, lower(concat_ws(' ', title, description)) AS td FROM s) "


def _word(w: str, c: str = "q") -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')"


_SQ = r"trim(regexp_replace({0}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_LINES = r"string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10))"
_UNESC = "{0}"
for _e, _c in (("&nbsp;", "chr(160)"), ("&#39;", "chr(39)"), ("&#9;", "chr(9)"), ("&#46;", "'.'"), ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
    _UNESC = f"regexp_replace({_UNESC}, '(?i){_e}', {_c}, 'g')"
_NO_TAGS = r"regexp_replace(regexp_replace(text, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
_TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_ISO = "CASE WHEN regexp_matches(day, '^\\d{{4}}-') THEN day || 'T' || lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || ':00' END"
_NUM = "try_cast(trim({0}) AS INTEGER)"
_EV = "join|invite|event|party|reception|network|networking|happy hour|dinner|lunch|breakfast|drinks|cocktails|food|register|rsvp|builders|leaders|community|founders|engineers"
_NAV = "products|solutions|resources|pricing|blog|docs|support|careers|company|platform"

ORACLES = {
    "explorer_filter": f"WITH {S} SELECT id, title FROM s WHERE substr(start_at, 12, 5) BETWEEN '10:00' AND '16:30' AND llm.ai_focus = 'AI' AND try_cast(trim(remaining_capacity) AS INTEGER) <> 0 AND NOT coalesce(sponsored, false) AND list_contains(topics, 'AI')",
    "explorer_company": f"WITH {S} SELECT id, title FROM s WHERE EXISTS (SELECT 1 FROM (SELECT unnest(s.speakers) AS x) WHERE contains(lower(x.company), 'mevorefede'))",
    "explorer_person": f"WITH {S} SELECT id, title FROM s WHERE EXISTS (SELECT 1 FROM (SELECT unnest(s.speakers) AS x) WHERE contains(lower(concat_ws(' ', x.name, x.company)), 'katherine'))",
    "explorer_ordered": f"WITH {S} SELECT id, title, start_at FROM s WHERE llm.theme = 'Security' ORDER BY CASE WHEN id = '1000042' THEN 1 END NULLS LAST, nullif(start_at, '') NULLS LAST, nullif(date_text, '') NULLS LAST, title NULLS LAST, id LIMIT 25",
    "text_search_and": _HAY + f"SELECT id, title FROM h WHERE {_word('agent')} AND {_word('workflows')}",
    "text_search_not": _HAY + f"SELECT id, title FROM h WHERE {_word('pipelines')} AND NOT ({_word('streaming')} OR {_word('robotics')})",
    "text_search_without": _HAY + f"SELECT id, title FROM h WHERE {_word('agent')} AND NOT ({_word('data')} OR {_word('model')})",
    "text_search_phrase": _HAY + f"SELECT id, title FROM h WHERE contains(q, 'at a time') AND {_word('talk')}",
    "text_search_dnf": _HAY + f", m AS (SELECT id, CASE WHEN {_word('production', 'lower(title)')} THEN 0 WHEN contains(q, 'one backlog at a time') THEN 1 WHEN {_word('cost', 'td')} AND {_word('requests')} THEN 2 END AS matched FROM h) SELECT * FROM m WHERE matched IS NOT NULL".replace(") , m", "), m"),
    "facet_filter": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' AND source = 'party_invite' GROUP BY ALL",
    "fingerprints": f"WITH {S} SELECT id, sha256(concat_ws(chr(1), " + ", ".join(f"'{f}=' || coalesce({f}, '')" for f in sorted(["title", "date_text", "start_time_text", "end_time_text", "room", "session_category", "capacity"])) + ")) AS fingerprint FROM s",
    "session_keys": f"WITH {S}, k AS (SELECT id, coalesce(nullif(regexp_extract(url, '/session/(\\d+)(/|$)', 1), ''), nullif(trim(url), '')) AS u, coalesce(nullif(regexp_extract(url, '/(\\d+)(/|$)', 1), ''), nullif(trim(url), '')) AS v, title FROM s) SELECT id, CASE WHEN regexp_matches(trim(id), '^\\d+$') THEN trim(id) ELSE coalesce(nullif(regexp_extract(id, '/session/(\\d+)(/|$)', 1), ''), u, nullif(trim(id), ''), nullif(trim(title), '')) END AS key_a, u AS key_b, v AS key_c, lower({_SQ.format('title')}) AS norm_title FROM k",
    "schedule": f"WITH {S}, d AS (SELECT id, CASE WHEN coalesce(date_text, '') = '' THEN 'UNSCHEDULED' ELSE coalesce(strftime(try_strptime(regexp_replace(date_text, '^\\w+, ', ''), '%B %d, %Y'), '%Y-%m-%d'), regexp_replace(regexp_replace(lower(date_text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) END AS day, {_CLOCK.format('start_time_text')} AS sm, {_CLOCK.format('end_time_text')} AS em FROM s), i AS (SELECT id, day, {_ISO.format('sm')} AS start_iso, {_ISO.format('em')} AS end_iso, em - sm AS minutes FROM d) SELECT *, concat_ws('/', start_iso, end_iso) AS interval FROM i",
    "clean_topics": rf"WITH {S}, p AS (SELECT id, {_SQ.format('t')} AS t, a, b FROM (SELECT id, a, unnest(string_split(replace(e, '|', ','), ',')) AS t, unnest(range(len(string_split(replace(e, '|', ','), ',')))) AS b FROM (SELECT id, unnest(topics) AS e, unnest(range(len(topics))) AS a FROM s))), f AS (SELECT id, t, min((a, b)) AS o FROM p WHERE t <> '' GROUP BY ALL), g AS (SELECT id, string_agg(t, ';' ORDER BY o) AS topics FROM f GROUP BY id) SELECT s.id, CASE WHEN s.topics IS NULL THEN NULL ELSE coalesce(g.topics, '') END AS topics FROM s LEFT JOIN g USING (id)",
    "embed_texts": f"WITH {S}, c AS (SELECT id, {_SQ.format('coalesce(title, chr(32))')} AS t, {_SQ.format('coalesce(description, chr(32))')} AS d, {_SQ.format('coalesce(session_category, chr(32))')} AS k, {_SQ.format('coalesce(room, chr(32))')} AS r, array_to_string(list_sort(list_distinct(list_filter(list_transform(speakers, lambda x: {_SQ.format('x.company')}), lambda x: x <> ''))), ', ') AS co FROM s) SELECT id, concat_ws(chr(10), CASE WHEN t <> '' THEN 'Title: ' || t END, CASE WHEN d <> '' THEN 'Description: ' || d END, CASE WHEN k <> '' THEN 'Category: ' || k END, CASE WHEN r <> '' THEN 'Room: ' || r END, CASE WHEN co <> '' THEN 'Companies: ' || co END) AS embed_text, concat_ws(' | ', nullif(t, ''), nullif(substr(d, 1, 800), '')) AS prompt FROM c",
    "html_strip": rf"WITH a AS (SELECT doc_id, string_split({_UNESC.format(_NO_TAGS)}, chr(10)) AS l FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(l, lambda x: {_SQ.format('x')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM a) SELECT doc_id, plain, length(plain) AS n_plain, length(plain) - length(replace(plain, chr(10), '')) AS line_ends FROM b",
    "url_parts": "WITH u AS (SELECT doc_id, nullif(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '') AS url FROM documents) SELECT doc_id, url, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '/(\\d{5,})(/|$)', 1), '') AS number FROM u",
    "redaction": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b(?:AIza[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z]{16,})\b', '[redacted]', 'g'), '\b[0-9a-f]{10,}\b', '[code]', 'g'), '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}', '[address]', 'g') AS text FROM documents WHERE text IS NOT NULL",
    "readable_blocks": rf"WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, CAST(unnest(range(len({_LINES}))) AS INTEGER) AS place FROM documents), c AS (SELECT doc_id, place, {_SQ.format('line')} AS line FROM l), o AS (SELECT doc_id, min(place) AS place, arg_min(line, place) AS line FROM c WHERE line <> '' GROUP BY doc_id, lower(line)), n AS (SELECT *, length(regexp_replace(line, '[^.!?;:]', '', 'g')) AS marks, len(regexp_extract_all(lower(line), '\b({_EV})\b')) AS ev, len(regexp_extract_all(lower(line), '\b({_NAV})\b')) AS nav, length(regexp_replace(line, '[^|>]', '', 'g')) AS bars FROM o), k AS (SELECT doc_id, place, CAST(CASE WHEN length(line) < 24 OR regexp_matches(lower(line), 'privacy policy|all rights reserved|cookie|skip to content|open menu') OR bars >= 4 OR nav >= 4 THEN 0 ELSE least(length(line), 500) + 30 * marks + 45 * ev - 80 * nav END AS INTEGER) AS score FROM n), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM k WHERE score > 80) SELECT * FROM q WHERE rank <= 10",
    "forward_fill": f"WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, CAST(unnest(range(len({_LINES}))) AS INTEGER) AS place FROM documents WHERE source = 'faq'), f AS (SELECT *, last_value(CASE WHEN starts_with(line, 'Q: ') THEN substr(line, 4) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place) AS question FROM l) SELECT doc_id, place, question, length(line) AS n FROM f WHERE starts_with(line, 'A: ')",
    "run_collapse": f"WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS place FROM documents), a AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM l) SELECT doc_id, count(*) AS lines FROM a WHERE after IS NULL OR line <> after GROUP BY doc_id",
    "token_similarity": f"WITH {S}, k AS (SELECT id, {_TOK.format('title')} AS a, {_TOK.format('description')} AS b FROM s), n AS (SELECT id, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, greatest(len(a), len(b)) AS m FROM k) SELECT id, round(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / u END, 6) AS jaccard, round(CASE WHEN m > 0 THEN i::DOUBLE / m ELSE 0 END, 6) AS overlap FROM n",
    "seat_sentences": f"WITH {S}, n AS (SELECT id, {_NUM.format('capacity')} AS cap, {_NUM.format('remaining_capacity')} AS rem, {_NUM.format('registrant_count')} AS reg FROM s), h AS (SELECT *, CASE WHEN cap > 0 THEN reg::DOUBLE / cap END AS x, concat_ws('; ', CASE WHEN cap IS NOT NULL THEN cap || ' seats' END, CASE WHEN reg IS NOT NULL THEN reg || ' registered' END, CASE WHEN rem = 0 THEN 'full' END) AS p FROM n) SELECT id, CASE WHEN x IS NULL THEN 'unknown' WHEN x <= 0 THEN 'none' WHEN x <= 0.05 THEN 'a handful' WHEN x <= 0.15 THEN 'a few' WHEN x <= 0.3 THEN 'some' WHEN x <= 0.5 THEN 'up to half' ELSE 'most' END AS share, CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR) || '%' AS pct, upper(substr(p, 1, 1)) || substr(p, 2) AS sentence FROM h",
    "hrefs": f"WITH {S} SELECT id, 'explorer.html?category=' || url_encode(coalesce(session_category, '')) || '&day=' || url_encode(coalesce(date_text, '')) AS href FROM s",
    "sponsor_fields": f"WITH {S}, c AS (SELECT id, pos, {_SQ.format('x.company')} AS co FROM (SELECT id, unnest(speakers) AS x, unnest(range(len(speakers))) AS pos FROM s)), f AS (SELECT id, co, min(pos) AS p FROM c WHERE co <> '' AND NOT contains(lower(co), 'orvanta') GROUP BY ALL), g AS (SELECT id, string_agg(co, ';' ORDER BY p) AS companies, count(*) AS n, min(co) AS one FROM f GROUP BY id), t AS (SELECT s.id, s.speakers IS NULL AS none, companies, CASE WHEN n = 1 THEN one END AS single, nullif(regexp_extract(coalesce(description, ''), '(?:Hosted by|Sponsored by|A guest from|brought to you by) ([A-Z][\\w&]*(?: (?:& )?[A-Z][\\w&]*){{0,8}})', 1), '') AS said FROM s LEFT JOIN g USING (id)) SELECT id, CASE WHEN none THEN NULL ELSE coalesce(companies, '') END AS companies, coalesce(single, said) AS sponsor, CASE WHEN single IS NOT NULL THEN 'speakers' WHEN said IS NOT NULL THEN 'description' END AS source FROM t",
}
