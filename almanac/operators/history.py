"""How sessions appear, fill up and disappear along the snapshots, in the order of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.catalog import last_rows
from almanac.session import materialize, small


def session_summary(facts: DataFrame, index: DataFrame) -> DataFrame:
    """One row per session: first and last seen, known values, growth, rates, fill ratios and presence transitions.

    ``presence_count`` counts rows, repeated ones included; ``transition_count`` counts changes between present and
    absent from one snapshot to the next over all snapshots of the index, the first one never counting. ``capacity`` is
    the first positive one, while ``latest_fill_ratio`` divides by the last positive one.
    """
    captures = index.agg(F.count_distinct("order_index").alias("snapshot_count"), F.max("order_index").alias("last_index"), F.min("order_index").alias("first_index"))
    times = small(materialize(index.groupBy("order_index").agg(F.min("snapshot_ts").alias("ts"))))
    rows = last_rows(facts).join(times, "order_index")
    steps = Window.partitionBy("session_id").orderBy("order_index")
    rows = rows.withColumn("before", F.lag("order_index").over(steps)).withColumn("after", F.lead("order_index").over(steps))

    def when_known(c: str):
        return F.when(F.col(c).isNotNull(), F.col("order_index"))

    seats = F.when(F.col("capacity") > 0, F.col("order_index"))
    ratio = F.when((F.col("capacity") != 0) & F.col("registrant_count").isNotNull(), F.col("registrant_count") / F.col("capacity"))
    last = F.max_by(F.struct("title", "url", "room", "date_text", "start_time_text"), "order_index")
    s = rows.groupBy("session_id").agg(
        last.alias("l"), F.min_by("ts", "order_index").alias("first_seen_ts"), F.max_by("ts", "order_index").alias("last_seen_ts"), F.sum("n_rows").alias("presence_count"),
        F.count_if(F.col("before").isNull() | (F.col("order_index") - F.col("before") > 1)).alias("starts"),
        F.count_if(F.col("after").isNull() | (F.col("after") - F.col("order_index") > 1)).alias("ends"),
        F.min("order_index").alias("lo"), F.max("order_index").alias("hi"),
        F.min_by("registrant_count", when_known("registrant_count")).alias("first_registrants"), F.max_by("registrant_count", when_known("registrant_count")).alias("last_registrants"), F.max("registrant_count").alias("max_registrants"),
        F.min_by("remaining_capacity", when_known("remaining_capacity")).alias("first_remaining"), F.max_by("remaining_capacity", when_known("remaining_capacity")).alias("last_remaining"), F.min("remaining_capacity").alias("min_remaining"),
        F.min_by("capacity", seats).alias("capacity"), F.max_by("capacity", seats).alias("last_capacity"), F.max(ratio).alias("max_fill_ratio"),
    )
    days = F.greatest((F.unix_micros(F.col("last_seen_ts").cast("timestamp")) - F.unix_micros(F.col("first_seen_ts").cast("timestamp"))) / 86400e6, F.lit(0.0))
    s = s.crossJoin(F.broadcast(captures)).withColumn("days_observed", days)  # captures: one row
    s = s.withColumn("registrant_growth", F.col("last_registrants") - F.col("first_registrants")).withColumn("remaining_drop", F.col("first_remaining") - F.col("last_remaining"))
    per_day = lambda c: F.when(F.col("days_observed") > 0, F.col(c) / F.col("days_observed"))
    return s.select(
        "session_id", "l.title", "l.url", "first_seen_ts", "last_seen_ts", "presence_count", "snapshot_count",
        (F.col("starts") + F.col("ends") - (F.col("lo") == F.col("first_index")).cast("int") - (F.col("hi") == F.col("last_index")).cast("int")).cast("bigint").alias("transition_count"),
        "first_registrants", "last_registrants", "max_registrants", "first_remaining", "last_remaining", "min_remaining", "capacity", "registrant_growth", "remaining_drop",
        "days_observed", per_day("registrant_growth").alias("registrants_per_day"), per_day("remaining_drop").alias("seats_taken_per_day"),
        (F.col("last_registrants") / F.col("last_capacity")).alias("latest_fill_ratio"), "max_fill_ratio", "l.room", "l.date_text", "l.start_time_text",
    )


def fast_fill(summary: DataFrame) -> DataFrame:
    """The summary with fill percentages and the fill score, a weighted sum less a penalty for coming and going."""
    known = F.col("capacity") > 0
    hundred = lambda c: F.round(F.when(known, 100.0 * F.col(c) / F.col("capacity")), 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = zero(F.col("registrants_per_day")) * 0.55 + zero(100.0 * F.col("max_fill_ratio")) * 0.20 + zero(F.col("registrant_growth").cast("double")) * 0.15 + zero(F.col("seats_taken_per_day")) * 0.10 - F.col("transition_count") * 8.0
    return summary.withColumns({"latest_fill_pct": hundred("last_registrants"), "first_fill_pct": hundred("first_registrants"), "fast_fill_score": F.round(score, 2)})


def top_fillers(summary: DataFrame, limit: int = 20, min_presence: int = 2) -> DataFrame:
    """Sessions that fill fastest; ties in the order of score, growth and registrants go to the smaller id."""
    found = fast_fill(summary).filter(F.col("capacity").isNotNull() & F.col("last_registrants").isNotNull() & (F.col("presence_count") >= min_presence))
    keys = [F.col(c).desc_nulls_last() for c in ("fast_fill_score", "registrant_growth", "last_registrants")]
    return found.orderBy(*keys, "session_id").limit(limit).select("session_id", "title", "fast_fill_score", "first_registrants", "last_registrants", "registrant_growth", F.round("registrants_per_day", 1).alias("registrants_per_day"), F.round("seats_taken_per_day", 1).alias("seats_taken_per_day"), "latest_fill_pct", "presence_count", "transition_count", "date_text", "start_time_text", "room")


def flappy(summary: DataFrame, limit: int = 20, min_transitions: int = 2) -> DataFrame:
    """Sessions that come and go most."""
    found = summary.filter(F.col("transition_count") >= min_transitions)
    keys = [F.col("transition_count").desc(), F.col("presence_count").asc(), F.col("title").asc_nulls_last(), F.col("session_id").asc()]
    return found.orderBy(*keys).limit(limit).select("session_id", "title", "presence_count", "snapshot_count", "transition_count", "first_seen_ts", "last_seen_ts", "first_registrants", "last_registrants", "room")


def history_of(facts: DataFrame, index: DataFrame, session_id: str) -> DataFrame:
    """All states of one session by capture time; the filter on the id reaches the scan before rows are combined."""
    own = facts.filter(F.contains(F.col("session_id"), F.lit(session_id)))
    rows = last_rows(own).filter(F.col("session_id") == session_id)
    times = index.groupBy("order_index").agg(F.min("file_name").alias("file_name"), F.min("snapshot_ts").alias("snapshot_ts"))
    return rows.join(times, "order_index").select("file_name", "snapshot_ts", "registrant_count", "remaining_capacity", "capacity", "date_text", "start_time_text", "room", "title").orderBy(F.col("snapshot_ts").asc_nulls_last(), "file_name")


def snapshot_sizes(facts: DataFrame, index: DataFrame) -> DataFrame:
    """Every snapshot in file order with its number of sessions; empty ones are counted as such."""
    sizes = last_rows(facts, ["title"]).groupBy("order_index").agg(F.count("*").alias("n"))
    files = index.groupBy("order_index").agg(F.min("file_name").alias("file_name"), F.min("snapshot_ts").alias("snapshot_ts"))
    return files.join(sizes, "order_index", "left").select("order_index", "file_name", "snapshot_ts", F.coalesce("n", F.lit(0)).alias("sessions"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("empty"))


def burst_groups(index: DataFrame, hours: float = 2.0) -> DataFrame:
    """Snapshots taken in bursts: a group ends where the next snapshot is more than ``hours`` later or has no time.

    ``(order_index, file_name, group_id, representative)``, the representative being the group's last snapshot. The
    index has one row per capture, so ranking it in one task is bounded by the number of captures.
    """
    once = index.groupBy("order_index").agg(F.min("file_name").alias("file_name"), F.min("snapshot_ts").alias("ts"))
    order = Window.orderBy("order_index")
    before = F.lag("ts").over(order)
    apart = F.when(F.col("ts").isNull() | before.isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > hours * 3600e6), 1).otherwise(0)
    grouped = once.withColumn("apart", apart).withColumn("group_id", F.sum("apart").over(order) - 1)
    return grouped.select("order_index", "file_name", F.col("group_id").cast("bigint").alias("group_id"), (F.max("order_index").over(Window.partitionBy("group_id")) == F.col("order_index")).alias("representative"))


def refresh_issues(facts: DataFrame, index: DataFrame, drop: float = 0.2) -> DataFrame:
    """Each snapshot with the delivered one before it and what is wrong with it: empty, no predecessor, out of order, shrunk."""
    sizes = snapshot_sizes(facts, index)
    order = Window.orderBy("order_index")
    full = F.when(F.col("sessions") > 0, F.col("order_index"))
    prev = F.last(full, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    prev_n = F.last(F.when(F.col("sessions") > 0, F.col("sessions")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    prev_ts = F.last(F.when(F.col("sessions") > 0, F.col("snapshot_ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = sizes.select("order_index", "file_name", "sessions", prev.alias("prev_index"), (F.col("sessions") == 0).alias("is_empty"), prev.isNull().alias("no_previous"), F.coalesce(F.col("snapshot_ts") < prev_ts, F.lit(False)).alias("out_of_order"), F.coalesce((F.col("sessions") > 0) & (F.col("sessions") < prev_n * (1 - drop)), F.lit(False)).alias("shrunk"))
    return d.withColumn("issues", F.concat_ws(",", *[F.when(F.col(c), c) for c in ("is_empty", "no_previous", "out_of_order", "shrunk")]))


def presence_runs(facts: DataFrame, gap: int = 1) -> DataFrame:
    """``(session_id, run, first_index, last_index, n)``: runs of snapshots in which a session is present."""
    rows = last_rows(facts, ["title"]).select("session_id", "order_index")
    steps = Window.partitionBy("session_id").orderBy("order_index")
    new = F.when(F.col("order_index") - F.lag("order_index").over(steps) <= gap, 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(steps))
    return runs.groupBy("session_id", "run").agg(F.min("order_index").alias("first_index"), F.max("order_index").alias("last_index"), F.count("*").alias("n"))


def first_meaningful(facts: DataFrame, least: int = 1, most: int = 1000) -> DataFrame:
    """Per session the first snapshot in which it counts as visible, and the first one in which any does."""
    seen = last_rows(facts, ["registrant_count"]).filter((F.col("registrant_count") > least) & (F.col("registrant_count") < most))
    own = seen.groupBy("session_id").agg(F.min("order_index").alias("first_index"))
    return own.join(F.broadcast(seen.agg(F.min("order_index").alias("any_index"))))  # one row


def register_views(facts: DataFrame, index: DataFrame) -> None:
    """Makes ``session_summary`` and ``fast_fill_candidates`` known to SQL; both stay lazy."""
    summary = session_summary(facts, index)
    summary.createOrReplaceTempView("session_summary")
    fast_fill(summary).createOrReplaceTempView("fast_fill_candidates")


def ask(spark, sql: str, **args) -> DataFrame:
    """A parameterised query on the registered views; values are bound by name, never pasted into the text."""
    return spark.sql(sql, args=args)
