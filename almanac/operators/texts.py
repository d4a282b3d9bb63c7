"""Queries' building blocks over session and document texts: keys, fingerprints, dates, similarity and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import html
from almanac.functions.text import squeeze
from almanac.operators.catalog import current_sessions, number, session_key
from almanac.operators.diff import change_ratio, token_set
from almanac.operators.rollup import clock, day_key


def fingerprints(sessions: DataFrame) -> DataFrame:
    """A digest of the fields that make a session's record worth fetching again."""
    fields = ["title", "date_text", "start_time_text", "end_time_text", "room", "session_category", "capacity"]
    return current_sessions(sessions.select("id", F.sha2(F.concat_ws("\u0001", *[F.concat(F.lit(f + "="), F.coalesce(f, F.lit(""))) for f in sorted(fields)]), 256).alias("fingerprint")))


def keys(sessions: DataFrame) -> DataFrame:
    """The key variants of each session and its title in the form in which titles are compared."""
    return current_sessions(sessions.select("id", session_key(F.col("id"), F.col("url"), F.col("title")).alias("key_a"), session_key(F.lit(""), F.col("url")).alias("key_b"), session_key(F.lit(""), F.col("url"), loose=True).alias("key_c"), F.lower(squeeze(F.col("title"))).alias("norm_title")))


def schedule(sessions: DataFrame) -> DataFrame:
    """Day, start and end out of the written forms, with the interval as text; unreadable parts are null."""
    iso = lambda m: F.when(m.isNotNull() & F.regexp_like("day", F.lit(r"^\d{4}-")), F.concat("day", F.format_string("T%02d:%02d:00", F.floor(m / 60).cast("int"), (m % 60).cast("int"))))
    d = current_sessions(sessions.select("id", day_key(F.col("date_text")).alias("day"), clock(F.col("start_time_text")).alias("sm"), clock(F.col("end_time_text")).alias("em")))
    return d.select("id", "day", iso(F.col("sm")).alias("start_iso"), iso(F.col("em")).alias("end_iso"), F.concat_ws("/", iso(F.col("sm")), iso(F.col("em"))).alias("interval"), (F.col("em") - F.col("sm")).alias("minutes"))


def clean_topics(sessions: DataFrame) -> DataFrame:
    """Topics split at pipes and commas, trimmed, without blanks, each once in the order met."""
    apart = F.flatten(F.transform(F.filter("topics", lambda x: x.isNotNull()), lambda x: F.split(x, r"[|,]")))
    return current_sessions(sessions.select("id", F.array_join(F.array_distinct(F.filter(F.transform(apart, squeeze), lambda x: x != "")), ";").alias("topics")))


def embed_texts(sessions: DataFrame) -> DataFrame:
    """The labelled lines that a session is embedded by, without its labels, and the shorter prompt for a classifier."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(name + ": "), c))
    companies = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("speakers", lambda x: squeeze(x["company"])), lambda x: x != ""))), ", ")
    clean = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    text = F.concat_ws("\n", line("Title", clean("title")), line("Description", clean("description")), line("Category", clean("session_category")), line("Room", clean("room")), line("Companies", companies))
    return current_sessions(sessions.select("id", text.alias("embed_text"), F.concat_ws(" | ", F.nullif(clean("title"), F.lit("")), F.nullif(F.substring(clean("description"), 1, 800), F.lit(""))).alias("prompt")))


def page_texts(docs: DataFrame) -> DataFrame:
    """Documents as plain text, with its length and lines; null texts stay null."""
    plain = html.strip_tags(F.col("text"))
    return docs.select("doc_id", plain.alias("plain")).select("doc_id", "plain", F.length("plain").alias("n_plain"), F.regexp_count("plain", F.lit("\n")).alias("line_ends"))


def urls(docs: DataFrame) -> DataFrame:
    """Hosts, paths and numbers in the urls of documents."""
    u = html.clean_url(F.col("url"))
    return docs.select("doc_id", u.alias("url"), F.nullif(F.regexp_extract(u, r"^[a-z]+://([^/]+)", 1), F.lit("")).alias("host"), F.nullif(F.regexp_extract(u, r"/(\d{5,})(?:/|$)", 1), F.lit("")).alias("number"))


def redacted(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null").select("doc_id", html.redact(F.col("text")).alias("text"))


def blocks(docs: DataFrame, least: int = 80, top: int = 10) -> DataFrame:
    """The best scored lines of every document that aren't boilerplate; repeated lines count once, ties by place."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("place", "line")).withColumn("line", squeeze(F.col("line"))).filter("line <> ''")
    once = lines.groupBy("doc_id", F.lower("line").alias("low")).agg(F.min(F.struct("place", "line")).alias("f")).select("doc_id", "f.*")
    scored = once.withColumn("score", html.block_score(F.col("line"))).filter(F.col("score") > least)
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "place")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("doc_id", "place", "score", "rank")


def summaries(docs: DataFrame) -> DataFrame:
    """A summary of the first telling sentences of every party invitation."""
    return docs.filter("source = 'party_invite' and text is not null").select("doc_id", html.summary(squeeze(F.col("text"))).alias("summary"))


def question_items(docs: DataFrame) -> DataFrame:
    """Lines of questions and answers with the question carried forward to the answers below it."""
    lines = docs.filter("source = 'faq'").select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("place", "line"))
    q = F.when(F.startswith("line", F.lit("Q: ")), F.col("line").substr(F.lit(4), F.length("line")))
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("question", F.last(q, ignorenulls=True).over(w)).filter(F.startswith("line", F.lit("A: "))).select("doc_id", "place", "question", F.length("line").alias("n"))


def collapsed_lines(docs: DataFrame) -> DataFrame:
    """Lines of a document that differ from the next one: runs of the same line count once."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("place", "line"))
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("place"))
    kept = lines.withColumn("after", after).filter("after is null or line <> after")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"))


def title_similarity(sessions: DataFrame) -> DataFrame:
    """How far the words of a session's title and of its description are the same: Jaccard and overlap by the larger set."""
    a, b = token_set(F.col("title")), token_set(F.col("description"))
    shared = F.size(F.array_intersect(a, b))
    return current_sessions(sessions.select("id", F.round(1 - change_ratio(a, b), 6).alias("jaccard"), F.round(F.when(F.greatest(F.size(a), F.size(b)) > 0, shared / F.greatest(F.size(a), F.size(b))).otherwise(0.0), 6).alias("overlap")))


def seat_sentences(sessions: DataFrame) -> DataFrame:
    """A phrase on each session's seats: percentage text, share in words and a sentence of what is known."""
    s = current_sessions(sessions.select("id", number(F.col("capacity")).alias("cap"), number(F.col("remaining_capacity")).alias("rem"), number(F.col("registrant_count")).alias("reg")))
    share = F.when(F.col("cap") > 0, F.col("reg") / F.col("cap"))
    words = F.when(share.isNull(), "unknown").when(share <= 0, "none").when(share <= 0.05, "a handful").when(share <= 0.15, "a few").when(share <= 0.3, "some").when(share <= 0.5, "up to half").otherwise("most")
    parts = F.concat_ws("; ", F.when(F.col("cap").isNotNull(), F.concat(F.col("cap").cast("string"), F.lit(" seats"))), F.when(F.col("reg").isNotNull(), F.concat(F.col("reg").cast("string"), F.lit(" registered"))), F.when(F.col("rem") == 0, F.lit("full")))
    return s.select("id", words.alias("share"), F.concat(F.round(share * 100).cast("bigint").cast("string"), F.lit("%")).alias("pct"), F.concat(F.upper(F.substring(parts, 1, 1)), parts.substr(F.lit(2), F.length(parts))).alias("sentence"))


def hrefs(sessions: DataFrame, base: str = "explorer.html") -> DataFrame:
    """Links that open the explorer for a session's category and day."""
    enc = lambda c: F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("+"), F.lit("%20"))
    return current_sessions(sessions.select("id", F.concat(F.lit(base + "?category="), enc(F.col("session_category")), F.lit("&day="), enc(F.col("date_text"))).alias("href")))


def sponsor_fields(sessions: DataFrame, host: str = "orvanta") -> DataFrame:
    """Whose session it is: the single company beside the host among its speakers, and where that was learnt."""
    names = F.array_distinct(F.filter(F.transform("speakers", lambda x: squeeze(x["company"])), lambda x: (x != "") & ~F.contains(F.lower(x), F.lit(host))))
    text = F.regexp_extract(F.coalesce("description", F.lit("")), r"(?:Hosted by|Sponsored by|A guest from|brought to you by) ([A-Z][\w&]*(?: (?:& )?[A-Z][\w&]*){0,8})", 1)
    single = F.when(F.size(names) == 1, F.try_element_at(names, F.lit(1)))
    return current_sessions(sessions.select("id", F.array_join(names, ";").alias("companies"), F.coalesce(single, F.nullif(text, F.lit(""))).alias("sponsor"), F.when(single.isNotNull(), "speakers").when(text != "", "description").alias("source")))
