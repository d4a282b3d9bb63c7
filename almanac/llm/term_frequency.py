"""Frequency of every distinct term, aggregated out of core by hash radix.

Texts are tokenised in the JVM. Every task first adds up its own terms, so a term that is everywhere costs a few rows
per task. The partial counts are partitioned by the leading bits of the terms' hash; partitions with too many rows are
split by further bits, again and again. The last partitions are numbered, and DuckDB aggregates them one by one under a
memory limit, out of core in the shared folder.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import WORD, html_unescape
from almanac.session import shared_dir, small, written

RADIX_BITS = 4
PARTITION_ROWS = 1_000_000
MAX_BITS = 40
COMBINE_ROWS = 400_000
DUCKDB_MEMORY = "256MB"


def words(c: Column) -> Column:
    """The words of a text: longest runs of letters and digits of its lower-case form with HTML escapes read."""
    return F.regexp_extract_all(F.lower(html_unescape(c)), F.lit(WORD), F.lit(0))


def _combined(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
    return pa.table({"term": t["term"], "tf": t["tf_sum"], "df": t["df_sum"]})


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the words of the rows of a task; a row counts once in ``df`` for each of its words."""
    parts, rows = [], 0
    for batch in batches:
        lists = batch.column("words")
        flat = pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
        per_row = flat.group_by(["row", "term"]).aggregate([([], "count_all")])
        t = per_row.group_by("term").aggregate([("count_all", "sum"), ([], "count_all")])
        parts.append(pa.table({"term": t["term"], "tf": t["count_all_sum"], "df": t["count_all"]}))
        rows += len(parts[-1])
        if rows > COMBINE_ROWS:
            parts = [_combined(parts)]
            rows = len(parts[0])
            if rows > COMBINE_ROWS // 2:
                yield from parts.pop().to_batches(max_chunksize=20_000)
                rows = 0
    if parts:
        yield from _combined(parts).to_batches(max_chunksize=20_000)


def partial_counts(texts: DataFrame) -> DataFrame:
    """``(term, tf, df)`` with as many rows per term as tasks that met it; texts: ``words array<string>``."""
    return texts.select("words").mapInArrow(_partials, "term string, tf long, df long")


def radix_leaves(hashed: DataFrame, limit: int = PARTITION_ROWS) -> DataFrame:
    """``(bits, prefix, n)`` of partitions of at most ``limit`` rows, found by splitting those that are larger.

    hashed: a column ``hash``. A level counts the rows of the partitions split at the one before, which are joined as a
    small table. A partition is not split further beyond MAX_BITS: it then holds one term, whose rows are as few as tasks.
    """
    found, split, bits = None, None, 0
    while True:
        bits += RADIX_BITS
        rows = hashed.select(F.shiftrightunsigned("hash", 64 - bits).alias("prefix"))
        if split is not None:
            rows = rows.withColumn("above", F.shiftright("prefix", RADIX_BITS)).join(small(split), "above", "left_semi")
        counts = written(rows.groupBy("prefix").agg(F.count("*").alias("n")).select(F.lit(bits).alias("bits"), "prefix", "n"))
        large = (F.col("n") > limit) & F.lit(bits < MAX_BITS)
        own = counts.filter(~large)
        found = own if found is None else found.unionByName(own)
        split = counts.filter(large).select(F.col("prefix").alias("above"))
        if split.isEmpty():
            return found


def numbered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``leaf``, the leaves' numbers from 0 on, and how many there are; ranked by first bits, then within them."""
    first = F.expr(f"shiftright(prefix, bits - {RADIX_BITS})")
    ranked = leaves.withColumn("first", first).withColumn("own", F.row_number().over(Window.partitionBy("first").orderBy("bits", "prefix")))
    sizes = ranked.groupBy("first").agg(F.count("*").alias("size"))  # 16 rows at most
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = written(ranked.join(F.broadcast(before), "first").select("bits", "prefix", (F.col("before") + F.col("own") - 1).cast("int").alias("leaf")))
    return out, out.count()


def by_leaf(partials: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(leaf, term, tf, df)`` with a term's leaf; a hash has the leaf of one of its prefixes, whatever its depth."""
    depths = [r["bits"] for r in leaves.select("bits").distinct().collect()] or [RADIX_BITS]  # 10 at most
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftrightunsigned("hash", 64 - b).alias("prefix")) for b in depths]))
    return partials.select("term", "tf", "df", at.alias("p")).select("term", "tf", "df", "p.*").join(small(leaves), ["bits", "prefix"]).select("leaf", "term", "tf", "df")


def duckdb_sum(folder: str, memory: str = DUCKDB_MEMORY):
    """A function over the rows of some leaves, in their order, that adds each leaf up by DuckDB, out of core below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                leaf = batch.column("leaf").to_numpy()
                cuts = np.flatnonzero(np.diff(leaf)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(leaf)]):
                    if b > a:
                        yield int(leaf[a]), batch.slice(a, b - a).select(["term", "tf", "df"])

        for leaf, group in itertools.groupby(parts(), key=lambda x: x[0]):
            first = next(group)[1]
            con = duckdb.connect()
            con.execute("SET threads = 1")
            con.execute(f"SET memory_limit = '{memory}'")
            con.execute("SET preserve_insertion_order = false")
            con.execute(f"SET temp_directory = '{os.path.join(folder, 'duckdb-' + uuid.uuid4().hex)}'" if folder else "SET temp_directory = ''")
            partials = pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], (b for _, b in group)))  # noqa: F841 (named in the SQL)
            result = con.sql(f"SELECT CAST({leaf} AS INTEGER) AS leaf, term, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(df) AS BIGINT) AS df, count(*) AS n FROM partials GROUP BY term")
            yield from result.to_arrow_reader(20_000)
            con.close()

    return run


def summed_leaves(texts: DataFrame, limit: int = PARTITION_ROWS) -> DataFrame:
    """``(leaf, term, tf, df, n)``: the frequencies of every term with its leaf and how many rows were added up for it.

    A leaf lies in one partition, next to none of its rows elsewhere, and as many partitions are made as there are leaves.
    DuckDB gets one leaf at a time, so never more than ``limit`` rows unless they are of one term. It spills below the
    shared folder where that is a path of files; on other shared folders it may not spill, and a leaf must fit its memory.
    """
    spark = texts.sparkSession
    partials = written(partial_counts(texts).withColumn("hash", F.xxhash64("term")))
    leaves, number = numbered(radix_leaves(partials, limit))
    shared = urlparse(shared_dir(spark))
    folder = shared.path if shared.scheme in ("", "file") else ""
    placed = by_leaf(partials, leaves).repartitionById(max(1, number), "leaf").sortWithinPartitions("leaf")
    return placed.mapInArrow(duckdb_sum(folder), "leaf int, term string, tf long, df long, n long")


def term_frequency(texts: DataFrame, limit: int = PARTITION_ROWS) -> DataFrame:
    """``(term, tf, df)``: how often every term occurs and in how many rows; texts: ``words array<string>``."""
    return summed_leaves(texts, limit).select("term", "tf", "df")


def session_terms(sessions: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """``(term, tf, df, mark)`` of every term in title and description; ``mark`` is rare, common or null.

    Each id counts once, with the greatest texts if its rows differ; rows without an id don't count. Null texts count
    as empty; an empty table gives no terms. ``rare``: at most so many sessions; ``common``: more than this share.
    """
    once = sessions.filter("id is not null").groupBy("id").agg(F.max(F.struct("title", "description")).alias("s"))
    text = F.concat_ws(" ", F.coalesce("s.title", F.lit("")), F.coalesce("s.description", F.lit("")))
    total = sessions.agg(F.countDistinct("id")).first()[0]
    counted = term_frequency(once.select(words(text).alias("words")))
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.lit(common * total), "common")
    return counted.withColumn("mark", mark)


def p5_found(sessions: DataFrame) -> DataFrame:
    return session_terms(sessions).filter("mark is not null").select("term", "mark")
