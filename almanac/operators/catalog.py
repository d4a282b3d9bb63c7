"""Typed views on the tables of a catalogue: snapshot rows, the order of snapshots and current sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import strip_white

FIELDS = ["title", "url", "capacity", "remaining_capacity", "registrant_count", "room", "date_text", "start_time_text"]


def last_rows(facts: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """``(session_id, order_index, *fields, n_rows)``: per session and snapshot the row that arrived last.

    Ties go to the greatest values; rows without an id or snapshot don't count. ``n_rows`` counts the rows taken
    together, repeated ones included. The aggregation combines before it shuffles.
    """
    rows = facts.select(strip_white(F.col("session_id")).alias("session_id"), "order_index", "loaded_at", *fields)
    rows = rows.filter((F.col("session_id") != "") & F.col("order_index").isNotNull())
    best = rows.groupBy("session_id", "order_index").agg(F.max(F.struct("loaded_at", *fields)).alias("b"), F.count("*").alias("n_rows"))
    return best.select("session_id", "order_index", *[f"b.{f}" for f in fields], "n_rows")


def current_sessions(sessions: DataFrame) -> DataFrame:
    """One row per id of what is given: the greatest, if rows of an id differ; rows without an id don't count.

    Give it only the columns needed, already worked out and filtered where that goes row by row: then only these are
    read and shuffled, and filters reach the scan.
    """
    columns = [c for c in sessions.columns if c != "id"]
    once = sessions.filter("id is not null").groupBy("id").agg(F.max(F.struct(*columns)).alias("b"))
    return once.select("id", *[F.col(f"b.`{c}`").alias(c) for c in columns])


def number(c: Column) -> Column:
    """A count that may be written as text; blank or unreadable is null."""
    return F.trim(c.cast("string")).try_cast("int")


def band(remaining: Column) -> Column:
    """Whether seats are left: unknown, full (exactly 0) or not-full (negative ones too)."""
    return F.when(remaining.isNull(), "unknown").when(remaining == 0, "full").otherwise("not-full")


def session_key(id_: Column, url: Column, title: Column | None = None, loose: bool = False) -> Column:
    """The number in an id or url path, else the url, else id, (url,) title: what identifies a session across captures.

    ``loose`` also takes a number that isn't below ``session/``; without ``title`` there is no last fallback.
    """
    path = r"/(\d+)(?:/|$)" if loose else r"/session/(\d+)(?:/|$)"
    digits = F.when(F.regexp_like(F.trim(id_), F.lit(r"^\d+$")), F.trim(id_))
    parts = [digits, F.nullif(F.regexp_extract(id_, path, 1), F.lit("")), F.nullif(F.regexp_extract(url, path, 1), F.lit("")), F.nullif(F.trim(url), F.lit("")), F.nullif(F.trim(id_), F.lit(""))]
    return F.coalesce(*parts, *([F.nullif(F.trim(title), F.lit(""))] if title is not None else []))


def last_by(df: DataFrame, keys: list[str], order: list[Column], first: bool = False) -> DataFrame:
    """The last (or first) row per key in the given order, which must be total; not an arbitrary survivor."""
    w = Window.partitionBy(*keys).orderBy(*[c.asc() if first else c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
