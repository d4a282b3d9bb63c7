"""What a refresh can reuse: fingerprints against a manifest, overlays of fresh fields, survivors of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.catalog import last_by, last_rows

FRESH = ["capacity", "remaining_capacity", "registrant_count", "room", "date_text", "start_time_text"]


def last_two(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last delivered snapshot and the one before it."""
    top = [r[0] for r in facts.filter("order_index is not null").select("order_index").distinct().orderBy(F.col("order_index").desc()).limit(2).collect()]
    live, before = (top + [-1, -1])[:2]
    rows = lambda k: last_rows(facts.filter(F.col("order_index") == k)).filter("url <> ''")
    return rows(live), rows(before)


def refresh_plan(facts: DataFrame) -> DataFrame:
    """Per url of the live snapshot and its predecessor: reuse, refetch, new or gone, by the fingerprint of what is listed."""
    live, before = last_two(facts)
    mark = F.sha2(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in ("title", "room", "date_text", "start_time_text")]), 256)
    url = lambda df, n: last_by(df, ["url"], [F.col("session_id")]).select("url", mark.alias(n))
    d = url(live, "now").join(url(before, "was"), "url", "full")
    action = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("now") == F.col("was"), "reuse").otherwise("refetch")
    return d.select("url", action.alias("action"))


def overlaid(facts: DataFrame) -> DataFrame:
    """The earlier record of every live url with the live fields laid over it where they aren't null."""
    live, before = last_two(facts)
    one = lambda df: last_by(df, ["url"], [F.col("session_id")])
    a, b = one(live).alias("a"), one(before).alias("b")
    return a.join(b, "url", "left").select("url", F.coalesce("b.title", "a.title").alias("title"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in FRESH])


def survivors(docs: DataFrame) -> DataFrame:
    """The last and the first document of every session by capture time, ties by id; a missing time is the earliest."""
    d = docs.filter("session_id is not null and trim(session_id) <> ''")
    when = F.coalesce(F.col("captured_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    # Extremes of a pair combine before the shuffle, so a session with a third of all rows costs one row per task.
    out = d.groupBy("session_id").agg(F.max(F.struct(when.alias("t"), "doc_id")).alias("l"), F.min(F.struct(when.alias("t"), "doc_id")).alias("f"), F.count("*").alias("n"))
    return out.select("session_id", F.col("l.doc_id").alias("last_doc"), F.col("f.doc_id").alias("first_doc"), "n")


def united(shards: list[DataFrame]) -> DataFrame:
    """All rows of shards whose columns may differ; a column that a shard lacks is null there."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
