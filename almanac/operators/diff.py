"""What differs between successive delivered snapshots: presence, seats, fields, moves and replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.catalog import band, last_rows
from almanac.session import materialize, small

TEXT = ["title", "room", "date_text", "start_time_text"]


def with_previous(facts: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(session_id, prev_index, cur_index, p, c)``: every session of each pair of successive delivered snapshots.

    With ``groups`` (of ``history.burst_groups``) only the last delivered snapshot of every burst counts. ``p`` and ``c`` are its rows in the two, null where it is absent. Instead of joining the pairs, every row is
    handed to the pair that it begins and the one that it ends, so one shuffle by session does.
    """
    rows = last_rows(facts)
    fields = [c for c in rows.columns if c not in ("session_id", "order_index", "n_rows")]
    seen = materialize(rows.select("order_index").distinct())
    if groups is not None:
        seen = seen.join(groups.select("order_index", "group_id"), "order_index").groupBy("group_id").agg(F.max("order_index").alias("order_index"))
    ranked = Window.orderBy("order_index")  # as many rows as snapshots
    pairs = small(materialize(seen.select("order_index", F.lag("order_index").over(ranked).alias("before"), F.lead("order_index").over(ranked).alias("after"))))
    placed = rows.join(pairs, "order_index").withColumn("v", F.struct(*fields))
    none = F.when(F.lit(False), F.col("v"))
    sides = F.array(F.struct(F.col("before").alias("prev_index"), F.col("order_index").alias("cur_index"), none.alias("p"), F.col("v").alias("c")), F.struct(F.col("order_index").alias("prev_index"), F.col("after").alias("cur_index"), F.col("v").alias("p"), none.alias("c")))
    both = placed.select("session_id", F.explode(sides).alias("s")).select("session_id", "s.*").filter("prev_index is not null and cur_index is not null")
    return both.groupBy("session_id", "prev_index", "cur_index").agg(F.max("p").alias("p"), F.max("c").alias("c"))


def added_removed(pairs: DataFrame) -> DataFrame:
    """Sessions that are only in the later snapshot (added) or only in the earlier (removed)."""
    kind = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed")
    return pairs.select("prev_index", "cur_index", "session_id", kind.alias("kind"), F.coalesce("c.title", "p.title").alias("title")).filter("kind is not null")


def rescued(pairs: DataFrame) -> DataFrame:
    """Added and removed sessions without those whose url is on both sides: an item that changed its key is neither."""
    d = pairs.select("prev_index", "cur_index", "session_id", F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").alias("kind"), F.coalesce("c.url", "p.url").alias("url")).filter("kind is not null")
    kinds = d.filter("url is not null and url <> ''").groupBy("prev_index", "cur_index", "url").agg(F.count_distinct("kind").alias("k")).filter("k = 2")
    return d.join(kinds, ["prev_index", "cur_index", "url"], "left_anti").select("prev_index", "cur_index", "session_id", "kind")


def availability_comparison(pairs: DataFrame) -> DataFrame:
    """Per pair: sessions in both, added, removed, band changes, and how seats and registrations moved in all."""
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    seats = F.when(both, F.col("c.remaining_capacity") - F.col("p.remaining_capacity"))
    regs = F.when(both, F.col("c.registrant_count") - F.col("p.registrant_count"))
    return pairs.groupBy("prev_index", "cur_index").agg(
        F.count_if(both).alias("overlap"), F.count_if(F.col("p").isNull()).alias("added"), F.count_if(F.col("c").isNull()).alias("removed"),
        F.count_if(both & (band(F.col("p.remaining_capacity")) != band(F.col("c.remaining_capacity")))).alias("band_changes"),
        F.count_if(both & (band(F.col("p.remaining_capacity")) == "full") & (band(F.col("c.remaining_capacity")) == "not-full")).alias("reopened"),
        F.count_if(seats != 0).alias("seat_changes"), F.coalesce(F.sum(seats), F.lit(0)).alias("seat_delta"), F.count_if(regs != 0).alias("registrant_changes"), F.coalesce(F.sum(regs), F.lit(0)).alias("registrant_delta"),
    )


def largest_deltas(pairs: DataFrame, limit: int = 12) -> DataFrame:
    """Per pair the sessions whose seats moved most; ties by title and id."""
    d = pairs.select("prev_index", "cur_index", "session_id", F.col("c.title").alias("title"), (F.col("c.remaining_capacity") - F.col("p.remaining_capacity")).alias("delta")).filter("delta <> 0")
    place = F.row_number().over(Window.partitionBy("prev_index").orderBy(F.abs("delta").desc(), F.col("title").asc_nulls_last(), "session_id"))
    return d.withColumn("place", place).filter(F.col("place") <= limit)


def field_changes(pairs: DataFrame, fields: list[str] = TEXT) -> DataFrame:
    """Sessions in both snapshots with the list of fields that differ; null and blank are alike."""
    differs = [F.when(F.coalesce(F.col(f"p.{f}"), F.lit("")) != F.coalesce(F.col(f"c.{f}"), F.lit("")), f) for f in fields]
    both = pairs.filter("p is not null and c is not null")
    return both.select("prev_index", "cur_index", "session_id", F.concat_ws(",", *differs).alias("fields")).filter("fields <> ''")


def moves_and_renames(pairs: DataFrame) -> DataFrame:
    """Of the field changes: moved (another room, day or start), renamed (another title) or both."""
    d = field_changes(pairs)
    has = lambda f: F.array_contains(F.split("fields", ","), f)
    return d.select("prev_index", "cur_index", "session_id", (has("room") | has("date_text") | has("start_time_text")).alias("moved"), has("title").alias("renamed"))


def diff_summary(pairs: DataFrame) -> DataFrame:
    """Per pair the number of each kind of change and whether the pair is worth a report."""
    kinds = added_removed(pairs).select("prev_index", "cur_index", "kind").unionByName(moves_and_renames(pairs).select("prev_index", "cur_index", F.explode(F.array_compact(F.array(F.when(F.col("moved"), "moved"), F.when(F.col("renamed"), "renamed")))).alias("kind")))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "moved", "renamed")]
    return kinds.groupBy("prev_index", "cur_index").agg(*counts).withColumn("meaningful", F.expr("added + removed + moved + renamed > 0"))


def replacement_candidates(pairs: DataFrame, least: int = 7) -> DataFrame:
    """Removed and added sessions of a pair that may replace each other, with their score.

    Same day 3, same start 4, same room 4. A score of 7 needs two of the three, so candidates are found by equi-joins on
    each two of them instead of comparing all removed with all added.
    """
    d = pairs.select("prev_index", "cur_index", "session_id", F.col("p").isNull().alias("is_added"), F.coalesce("c", "p").alias("v"), (F.col("p").isNull() | F.col("c").isNull()).alias("one")).filter("one")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    side = d.select("prev_index", "cur_index", "session_id", "is_added", blank("v.date_text").alias("day"), blank("v.start_time_text").alias("start"), blank("v.room").alias("room"))
    a = side.filter("not is_added").select("prev_index", "cur_index", F.col("session_id").alias("removed_id"), F.col("day").alias("rday"), F.col("start").alias("rstart"), F.col("room").alias("rroom"))
    b = side.filter("is_added").select("prev_index", F.col("session_id").alias("added_id"), "day", "start", "room")
    found = None
    for on in (("day", "start"), ("day", "room"), ("start", "room")):
        part = a.join(b, (a.prev_index == b.prev_index) & (a[f"r{on[0]}"] == b[on[0]]) & (a[f"r{on[1]}"] == b[on[1]])).drop(b.prev_index)
        found = part if found is None else found.unionByName(part)
    same = lambda x, y, n: F.when(F.col(x) == F.col(y), n).otherwise(0)
    return found.distinct().withColumn("score", same("rday", "day", 3) + same("rstart", "start", 4) + same("rroom", "room", 4)).filter(F.col("score") >= least).select("prev_index", "cur_index", "removed_id", "added_id", "score")


def greedy_replacements(candidates: DataFrame) -> DataFrame:
    """One-to-one replacements per pair: best score first, ties by removed and then added id.

    Rounds of mutual best choices give the same as going through the sorted list: in a strict order, a candidate that
    is first for both its sides is taken by the greedy choice too. Each round is two windows over what is left.
    """
    left, out = materialize(candidates), None
    order = [F.col("score").desc(), F.col("removed_id").asc(), F.col("added_id").asc()]
    while not left.isEmpty():
        first_r = F.row_number().over(Window.partitionBy("prev_index", "removed_id").orderBy(*order))
        first_a = F.row_number().over(Window.partitionBy("prev_index", "added_id").orderBy(*order))
        taken = materialize(left.withColumn("x", first_r).withColumn("y", first_a).filter("x = 1 and y = 1").drop("x", "y"))
        out = taken if out is None else out.unionByName(taken)
        left = materialize(left.join(taken.select("prev_index", "removed_id"), ["prev_index", "removed_id"], "left_anti").join(taken.select("prev_index", "added_id"), ["prev_index", "added_id"], "left_anti"))
    return candidates.limit(0) if out is None else out


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def change_ratio(a: Column, b: Column) -> Column:
    """One less the Jaccard similarity of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def change_kinds(pairs: DataFrame, threshold: float = 0.18) -> DataFrame:
    """Title changes by how many of their tokens differ: material from the threshold on, else minor."""
    both = pairs.filter("p is not null and c is not null").filter(F.coalesce("p.title", F.lit("")) != F.coalesce("c.title", F.lit("")))
    d = both.withColumn("ratio", F.round(change_ratio(token_set(F.col("p.title")), token_set(F.col("c.title"))), 6))
    return d.select("prev_index", "cur_index", "session_id", "ratio", F.when(F.col("ratio") >= threshold, "material").otherwise("minor").alias("kind"))


def flappy_demoted(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Added and removed sessions, split into stable ones and those that come and go at least ``least`` times."""
    d = added_removed(pairs)
    often = d.groupBy("session_id").agg(F.count("*").alias("times"))
    return d.join(often, "session_id").select("prev_index", "cur_index", "session_id", "kind", (F.col("times") >= least).alias("unstable"))
