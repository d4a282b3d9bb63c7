"""What the operators on snapshot history share: the order of captures and the row that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import strip_white
from almanac.session import materialize, small


def capture_order(index: DataFrame, facts: DataFrame) -> DataFrame:
    """``(order_index, ord)``: the captures that delivered rows, numbered from 0 by their time.

    Captures without a time come last; equal times are ordered by ``order_index``; repeated entries count once.
    Its rows are as many as captures, so one task ranks them.
    """
    seen = facts.select("order_index").distinct()
    once = index.filter("order_index is not null").groupBy("order_index").agg(F.min("snapshot_ts").alias("ts"))
    ranked = F.row_number().over(Window.orderBy(F.col("ts").asc_nulls_last(), "order_index")) - 1
    return materialize(once.join(seen, "order_index", "left_semi").select("order_index", ranked.alias("ord")))


def latest_rows(facts: DataFrame, order: DataFrame, **values: Column) -> DataFrame:
    """``(session_id, ord, *values)``: per session and capture the row that arrived last.

    Rows without an id or of an unlisted capture don't count. Rows that tie are taken by the greatest values, so the
    result is the same on every run. The aggregation combines before the shuffle: a session with any number of
    repeated rows costs each task one row per capture.
    """
    rows = (
        facts.select(strip_white(F.col("session_id")).alias("session_id"), "order_index", "loaded_at", *[v.alias(k) for k, v in values.items()])
        .filter(F.col("session_id") != "")
        .join(small(order), "order_index")
    )
    best = F.max(F.struct("loaded_at", *values)).alias("best")
    return rows.groupBy("session_id", "ord").agg(best).select("session_id", "ord", *[f"best.{k}" for k in values])
