"""Readers of snapshot and embedding files and of pages, with explicit schemas: types never depend on the rows at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions.html import json_slices
from almanac.operators.catalog import last_by, number
from almanac.session import materialize, small

SPEAKER = "struct<name: string, company: string, job_title: string, moreInfoUrl: string>"
LABELS = "struct<ai_focus: string, theme: string, audience: string, reasoning: string>"
SESSION = f"id: string, title: string, description: string, url: string, start_at: string, end_at: string, date_time: string, date_text: string, start_time_text: string, end_time_text: string, room: string, topics: array<string>, speakers: array<{SPEAKER}>, session_category: string, capacity: string, remaining_capacity: string, registrant_count: string, agenda_status: string, llm: {LABELS}"
PAYLOAD = f"scraped_at string, scrapedAt string, source_url string, count int, bucket string, sessions array<struct<{SESSION}>>"
EMBEDDING = f"row_id bigint, title string, url string, labels {LABELS}, topics array<string>, model string, embedding array<double>"
LISTING = "struct<id: string, title: string, moreInfoUrl: string, date: string, time: string, room: string, capacity: string, remaining: string>"


def snapshot_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, order_index, captured, sessions)`` of every JSON file: an object with sessions, or a bare array of them.

    ``order_index`` is the rank of the file name among all files, empty ones included, so it is taken before any
    session is looked at. A time that is missing is the file's stem; unreadable payloads have no sessions.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("file_name"), "value").filter(F.endswith("file_name", F.lit(".json")))
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    wrapped = F.when(bare, F.concat(F.lit('{"sessions":'), "value", F.lit("}"))).otherwise(F.col("value"))
    p = files.select("file_name", F.from_json(wrapped, PAYLOAD).alias("p"))
    # The window without keys runs over the names of the files only; their contents stay where they were read.
    names = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name")).filter(F.endswith("file_name", F.lit(".json")))
    order = small(materialize(names.select("file_name", (F.row_number().over(Window.orderBy("file_name")) - 1).alias("order_index"))))
    stem = F.regexp_replace("file_name", r"\.json$", "")
    return p.join(order, "file_name").select("file_name", "order_index", F.coalesce("p.scraped_at", "p.scrapedAt", stem).alias("captured"), F.coalesce("p.sessions", F.array().cast(f"array<struct<{SESSION}>>")).alias("sessions"))


def snapshot_rows(payloads: DataFrame) -> DataFrame:
    """One typed row per session of every snapshot; rows without an id are skipped."""
    s = payloads.select("order_index", "file_name", F.try_to_timestamp(F.col("captured")).alias("snapshot_ts"), F.explode("sessions").alias("s"))
    return s.filter("s.id <> ''").select("order_index", "file_name", "snapshot_ts", F.col("s.id").alias("session_id"), "s.title", "s.url", *[number(F.col(f"s.{c}")).alias(c) for c in ("capacity", "remaining_capacity", "registrant_count")], "s.room", "s.date_text", "s.start_time_text")


def delivered(payloads: DataFrame) -> DataFrame:
    """Only snapshots with sessions, as the diff and the reports read them."""
    return payloads.filter(F.size("sessions") > 0)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Embedding rows of line-delimited JSON; blank lines don't count, the greatest row_id of a url wins."""
    rows = spark.read.schema(EMBEDDING).json(path).filter("row_id is not null")
    return last_by(rows, ["url"], [F.col("row_id")])


def listed_ids(page: Column) -> Column:
    """The distinct session ids that a library page names, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(page, F.lit(r'"session_(\d+)"\s*:\s*\{'), F.lit(1))))


def library_records(pages: DataFrame) -> DataFrame:
    """``(page, key, id, title, url, ...)`` of every session in an assigned JSON variable of a page; broken JSON gives no rows."""
    body = json_slices(F.col("html"), r"library\s*=\s*\{")
    records = pages.select("page", F.from_json(body, f"map<string, {LISTING}>").alias("m")).select("page", F.explode(F.map_entries("m")).alias("e"))
    return records.filter(F.startswith("e.key", F.lit("session_")) & (F.col("e.value.moreInfoUrl") != "")).select("page", F.col("e.key").alias("key"), "e.value.*")


def latest_listing(records: DataFrame) -> DataFrame:
    """The record of every url on the page with the greatest number."""
    page = F.regexp_extract("page", r"(\d+)", 1).try_cast("int")
    return last_by(records.withColumn("page_no", page), ["moreInfoUrl"], [F.col("page_no"), F.col("key")])


def coalesced(detail: Column, seed: Column) -> Column:
    """The detail's text unless it is blank, else the seed's, else blank."""
    return F.coalesce(F.nullif(detail, F.lit("")), F.nullif(seed, F.lit("")), F.lit(""))


def party_rows(pages: DataFrame) -> DataFrame:
    """Events of an HTML table in which heading rows name the day of the rows below."""
    rows = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    day = F.nullif(F.regexp_extract("row", r"(?is)<h2[^>]*>(.*?)</h2>", 1), F.lit(""))
    w = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", " ")))
    d = rows.select("page", "pos", F.last(day, ignorenulls=True).over(w).alias("day"), cells.alias("cells"))
    return d.filter(F.size("cells") == 5).select("page", "pos", "day", *[F.element_at("cells", k + 1).alias(n) for k, n in enumerate(("time", "sponsor", "title", "location", "notes"))])
