"""Writers of snapshots, artifacts and manifests. Every one writes a table in parallel; none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshots(rows: DataFrame, path: str, key: str = "order_index") -> None:
    """Snapshot rows as JSON lines, one folder per snapshot; snapshots written again replace only themselves."""
    rows.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_snapshots(rows_like: DataFrame, path: str) -> DataFrame:
    """Reads what ``write_snapshots`` wrote, with the same schema; a filter on the key prunes folders."""
    return rows_like.sparkSession.read.schema(rows_like.schema).json(path).select(*rows_like.columns)


def write_buckets(sessions: DataFrame, bucket, path: str) -> None:
    """Sessions by day bucket, replacing only the buckets that are written."""
    sessions.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def availability_artifact(rows: DataFrame) -> DataFrame:
    """The six columns that the explorer lays over its sessions, null as blank; rows without a url don't count."""
    columns = ["remaining_capacity", "capacity", "registrant_count", "session_category", "room"]
    return rows.filter("url <> ''").select("url", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def merged_manifest(old: DataFrame, new: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """A manifest by url in which new entries replace old ones; with ``live``, entries that are gone are dropped."""
    out = old.join(new, "url", "left_anti").unionByName(new)
    return out if live is None else out.join(live.select("url"), "url", "left_semi")


def related_map(related: DataFrame) -> DataFrame:
    """Per query the list of its related rows in rank order, at most as many as were ranked."""
    items = F.array_sort(F.collect_list(F.struct("place", "row_id", "score")))
    return related.groupBy("query_id").agg(F.transform(items, lambda x: F.struct(x["row_id"].alias("row_id"), x["score"].alias("score"))).alias("related"))


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
