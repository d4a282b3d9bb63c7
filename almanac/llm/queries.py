"""Queries of the llm subpackage and the SQL that checks them."""

from __future__ import annotations

from almanac.llm import clusters, leakage, residue, set_similarity, spellings, term_frequency, tokenize
from almanac.session import table

QUERIES = {
    "p3_found": lambda spark, d: set_similarity.topic_pairs(table(spark, d, "classified_sessions")),
    "p3_links": lambda spark, d: set_similarity.topic_links(table(spark, d, "classified_sessions")),
    "p4_found": lambda spark, d: clusters.session_clusters(table(spark, d, "session_embeddings_v2")),
    "p4_profiles": lambda spark, d: clusters.cluster_profiles(table(spark, d, "session_embeddings_v2")),
    "p4_typical": lambda spark, d: clusters.typical_members(table(spark, d, "session_embeddings_v2")),
    "p5_found": lambda spark, d: term_frequency.p5_found(table(spark, d, "classified_sessions")),
    "p5_terms": lambda spark, d: term_frequency.session_terms(table(spark, d, "classified_sessions")),
    "p6_found": lambda spark, d: spellings.p6_found(table(spark, d, "sessions_25_speakers")),
    "p7_ids": lambda spark, d: tokenize.encode_texts(table(spark, d, "documents")),
    "p7_decoded": lambda spark, d: tokenize.decode_ids(tokenize.encode_texts(table(spark, d, "documents"))),
    "p8_found": lambda spark, d: leakage.p8_found(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p8_overlaps": lambda spark, d: leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p9_found": lambda spark, d: residue.p9_found(table(spark, d, "documents")),
}

_TOPICS = r"""
WITH parts AS (
  SELECT DISTINCT id, trim(regexp_replace(lower(t), '[\s\x{85}\p{Z}]+', ' ', 'g')) AS topic
  FROM (SELECT id, unnest(string_split(e, '|')) AS t FROM (SELECT id, unnest(topics) AS e FROM classified_sessions WHERE id IS NOT NULL) WHERE e IS NOT NULL)
), topics AS (SELECT * FROM parts WHERE topic <> ''), sizes AS (SELECT id, count(*) AS n, list(topic ORDER BY topic) AS items FROM topics GROUP BY id),
pairs AS (SELECT id_a, id_b FROM (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM topics a JOIN topics b ON a.topic = b.topic AND a.id < b.id GROUP BY 1, 2
) p JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b
WHERE shared >= 4 AND shared * 10 >= 6 * (x.n + y.n - shared))
"""

_TERMS = r"""
WITH once AS (SELECT id, max(coalesce(title, '') || ' ' || coalesce(description, '')) AS t FROM classified_sessions WHERE id IS NOT NULL GROUP BY id),
words AS (SELECT id, unnest(regexp_extract_all((replace(replace(replace(replace(replace(replace(lower(t), '&nbsp;', chr(160)), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '[\p{L}\p{N}]+')) AS term FROM once),
counted AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM words GROUP BY term),
marked AS (SELECT *, CASE WHEN df <= 2 THEN 'rare' WHEN df * 5 > (SELECT count(*) FROM once) THEN 'common' END AS mark FROM counted)
"""

_CLUSTERS = """
WITH once AS (SELECT row_id, max(embedding) AS e FROM session_embeddings_v2 WHERE len(embedding) = 64 GROUP BY row_id),
good AS (SELECT row_id, e FROM once WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
pairs AS (SELECT a.row_id AS x, b.row_id AS y FROM good a JOIN good b ON a.row_id <> b.row_id AND list_cosine_similarity(a.e, b.e) >= 0.8),
placed AS (SELECT x AS row_id, least(x, min(y)) AS cluster_id FROM pairs GROUP BY x)
"""

_LABEL = """{0}s AS (SELECT cluster_id, arg_min({0}, (-n, {0})) AS {0}, coalesce(arg_min(n, (-n, {0})), 0) AS {0}_members
  FROM (SELECT cluster_id, nullif({0}, '') AS {0}, CASE WHEN nullif({0}, '') IS NOT NULL THEN count(*) END AS n FROM labelled GROUP BY ALL) WHERE {0} IS NOT NULL GROUP BY cluster_id)"""

ORACLES = {
    "p3_found": _TOPICS + "SELECT id_a, id_b FROM pairs",
    "p3_links": _TOPICS
    + """SELECT id, min(id) OVER w AS set_id, count(*) OVER w - 1 AS copies, coalesce(links, 0) AS links FROM sizes
LEFT JOIN (SELECT id, count(*) AS links FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs) GROUP BY id) USING (id) WHERE n >= 4 WINDOW w AS (PARTITION BY items)""",
    "p5_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT term, tf, df, mark FROM marked",
    "p4_found": _CLUSTERS + "SELECT row_id, cluster_id FROM placed",
    "p4_profiles": _CLUSTERS
    + ", labelled AS (SELECT cluster_id, theme, ai_focus, audience FROM placed LEFT JOIN (SELECT row_id, max(labels.theme) AS theme, max(labels.ai_focus) AS ai_focus, max(labels.audience) AS audience FROM session_embeddings_v2 GROUP BY row_id) USING (row_id)), "
    + ", ".join(_LABEL.format(c) for c in ("theme", "ai_focus", "audience"))
    + """ SELECT cluster_id, count(*) AS size, any_value(t.theme) AS theme, coalesce(any_value(t.theme_members), 0) AS theme_members, any_value(f.ai_focus) AS ai_focus, coalesce(any_value(f.ai_focus_members), 0) AS ai_focus_members,
any_value(u.audience) AS audience, coalesce(any_value(u.audience_members), 0) AS audience_members FROM labelled LEFT JOIN themes t USING (cluster_id) LEFT JOIN ai_focuss f USING (cluster_id) LEFT JOIN audiences u USING (cluster_id) GROUP BY cluster_id""",
    "p8_found": lambda spark, d: leakage.p8_found(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p8_overlaps": lambda spark, d: leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p9_found": lambda spark, d: residue.p9_found(table(spark, d, "documents")),
}

TOPICS = r"""
WITH parts AS (
  SELECT DISTINCT id, trim(regexp_replace(lower(t), '[\s\x{85}\p{Z}]+', ' ', 'g')) AS topic
  FROM (SELECT id, unnest(string_split(e, '|')) AS t FROM (SELECT id, unnest(topics) AS e FROM classified_sessions WHERE id IS NOT NULL) WHERE e IS NOT NULL)
), topics AS (SELECT * FROM parts WHERE topic <> ''), sizes AS (SELECT id, count(*) AS n FROM topics GROUP BY id)
SELECT id_a, id_b FROM (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM topics a JOIN topics b ON a.topic = b.topic AND a.id < b.id GROUP BY 1, 2
) p JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b
WHERE shared >= 4 AND shared * 10 >= 6 * (x.n + y.n - shared)
"""

_TERMS = r"""
WITH once AS (SELECT id, max(coalesce(title, '') || ' ' || coalesce(description, '')) AS t FROM classified_sessions WHERE id IS NOT NULL GROUP BY id),
words AS (SELECT id, unnest(regexp_extract_all((replace(replace(replace(replace(replace(replace(lower(t), '&nbsp;', chr(160)), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '[\p{L}\p{N}]+')) AS term FROM once),
counted AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM words GROUP BY term),
marked AS (SELECT *, CASE WHEN df <= 2 THEN 'rare' WHEN df * 5 > (SELECT count(*) FROM once) THEN 'common' END AS mark FROM counted)
"""

_CLUSTERS = """
WITH once AS (SELECT row_id, max(embedding) AS e FROM session_embeddings_v2 WHERE len(embedding) = 64 GROUP BY row_id),
good AS (SELECT row_id, e FROM once WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
pairs AS (SELECT a.row_id AS x, b.row_id AS y FROM good a JOIN good b ON a.row_id <> b.row_id AND list_cosine_similarity(a.e, b.e) >= 0.8),
placed AS (SELECT x AS row_id, least(x, min(y)) AS cluster_id FROM pairs GROUP BY x)
"""

_LABEL = """{0}s AS (SELECT cluster_id, arg_min({0}, (-n, {0})) AS {0}, coalesce(arg_min(n, (-n, {0})), 0) AS {0}_members
  FROM (SELECT cluster_id, nullif({0}, '') AS {0}, CASE WHEN nullif({0}, '') IS NOT NULL THEN count(*) END AS n FROM labelled GROUP BY ALL) WHERE {0} IS NOT NULL GROUP BY cluster_id)"""

ORACLES = {
    "p3_found": _TOPICS + "SELECT id_a, id_b FROM pairs",
    "p3_links": _TOPICS
    + """SELECT id, min(id) OVER w AS set_id, count(*) OVER w - 1 AS copies, coalesce(links, 0) AS links FROM sizes
LEFT JOIN (SELECT id, count(*) AS links FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs) GROUP BY id) USING (id) WHERE n >= 4 WINDOW w AS (PARTITION BY items)""",
    "p5_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT term, tf, df, mark FROM marked",
    "p4_found": """
WITH once AS (SELECT row_id, max(embedding) AS e FROM session_embeddings_v2 WHERE len(embedding) = 64 GROUP BY row_id),
good AS (SELECT row_id, e FROM once WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
pairs AS (SELECT a.row_id AS x, b.row_id AS y FROM good a JOIN good b ON a.row_id <> b.row_id AND list_cosine_similarity(a.e, b.e) >= 0.8)
SELECT x AS row_id, least(x, min(y)) AS cluster_id FROM pairs GROUP BY x
""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": r"""
WITH clean AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE item_id IS NOT NULL),
words AS (SELECT kind, id, regexp_extract_all((regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(lower(text), '</?[A-Za-z][^<>]*>', ' ', 'g'), '&nbsp;', chr(160)), '&#39;', chr(39)), '&#9;', chr(9)), '&#46;', '.'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM clean),
grams AS (SELECT DISTINCT kind, id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 10)) AS k FROM words WHERE len(w) >= 12))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i'
""",
}
