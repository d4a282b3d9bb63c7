"""Session helpers: configuration, table loading and the cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) up to which a side may be broadcast after both were counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000

_folders: list[str] = []


def get_spark(app: str = "almanac", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        found = tempfile.mkdtemp(prefix="spark-almanac-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a result that is small against the input, by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a large intermediate by a Parquet table in the shared folder (columnar and compressed)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/almanac-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes the tables that ``written`` has left in the shared folder so far, and says how many.

    For a program that is done with its results: frames that read these tables can't be used any more.
    """
    jvm = spark._jvm
    for path in _folders:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(_folders)
    _folders.clear()
    return n


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if its counted rows and bytes are within the bounds; else leaves the choice to Catalyst.

    Meant for materialized frames: the count is a job of its own.
    """
    n, length = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and length <= size else df
