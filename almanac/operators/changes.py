"""Changes between two records of a session: which fields differ, how much that matters, and what may replace what."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.catalog import band
from almanac.operators.diff import added_removed, change_ratio, token_set

#: Fields whose every change matters, fields whose change is looked at more closely, and the share of a
#: description's words from which on its change matters.
IMPORTANT = ("title", "date_time", "date_text", "start_time_text", "end_time_text", "room")
CLOSER = ("speakers", "topics", "description")
RATIO = 0.18


def changed_fields(pairs: DataFrame) -> Column:
    """The fields of ``p`` and ``c`` that differ: null and blank texts are alike, lists are compared element by element."""
    kinds = {f.name: f.dataType for f in pairs.schema["p"].dataType}

    def differs(f: str) -> Column:
        if isinstance(kinds[f], T.ArrayType):
            empty = F.array().cast(kinds[f])
            return F.coalesce(f"p.{f}", empty) != F.coalesce(f"c.{f}", empty)
        return F.coalesce(f"p.{f}", F.lit("")) != F.coalesce(f"c.{f}", F.lit(""))

    return F.array_compact(F.array(*[F.when(differs(f), f) for f in (*IMPORTANT, *CLOSER) if f in kinds]))


def classified_changes(pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(prev_index, cur_index, session_id, material, minor)``: the fields that differ, sorted into those that matter and others.

    Important fields always matter; a description if at least ``ratio`` of its words differ; speakers if their number
    does; topics if their number or membership does. Fields that the records don't have are passed over.
    """
    kinds = {f.name for f in pairs.schema["p"].dataType}
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    rules = {f: F.lit(True) for f in IMPORTANT}
    if "description" in kinds:
        rules["description"] = change_ratio(token_set(F.col("p.description")), token_set(F.col("c.description"))) >= ratio
    if "speakers" in kinds:
        rules["speakers"] = size("p.speakers") != size("c.speakers")
    if "topics" in kinds:
        a, b = (F.coalesce(f"{x}.topics", F.array().cast("array<string>")) for x in "pc")
        rules["topics"] = (size("p.topics") != size("c.topics")) | (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) > 0)
    both = pairs.filter("p is not null and c is not null").withColumn("fields", changed_fields(pairs)).filter("size(fields) > 0")
    names = [f for f in (*IMPORTANT, *CLOSER) if f in kinds]
    of = lambda matters: F.array_join(F.array_compact(F.array(*[F.when(F.array_contains("fields", f) & (rules[f] if matters else ~rules[f]), f) for f in names])), ",")
    return both.select("prev_index", "cur_index", "session_id", of(True).alias("material"), of(False).alias("minor"))


def replacement_scores(pairs: DataFrame, least: int = 7) -> DataFrame:
    """``(prev_index, cur_index, removed_id, added_id, score, reasons)`` of sessions that may replace each other.

    Same day 3, start 4, end 2, room 4, common topics 1 each up to 3, common speakers 2 each up to 4. No single one of
    these comes to ``least`` 7, so two sessions that do have at least two kinds in common and meet in a join on a pair
    of values of two kinds; no removed session is compared with all added ones. Fields that the records don't have
    score nothing; blank and null values aren't the same as each other.
    """
    if least <= 4:
        raise ValueError("a single kind scores up to 4, so candidates of less than 5 would not all meet")
    kinds = {f.name for f in pairs.schema["c"].dataType}
    d = pairs.filter("p is null or c is null").select("prev_index", "cur_index", "session_id", F.col("p").isNull().alias("is_added"), F.coalesce("c", "p").alias("v"))
    points = {"day": ("date_text", 3), "start": ("start_time_text", 4), "end": ("end_time_text", 2), "room": ("room", 4)}
    scalar = {k: F.nullif(F.col(f"v.{f}"), F.lit("")) if f in kinds else F.lit(None).cast("string") for k, (f, _) in points.items()}
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(F.lower(x))), lambda x: x != ""))
    none = F.array().cast("array<string>")
    topics = F.coalesce(clean(F.col("v.topics")), none) if "topics" in kinds else none
    speakers = F.coalesce(clean(F.col("v.speakers.name")), none) if "speakers" in kinds else none
    sides = d.select("prev_index", "cur_index", "session_id", "is_added", *[c.alias(k) for k, c in scalar.items()], topics.alias("topics"), speakers.alias("speakers"))
    values = {**{k: F.filter(F.array(F.col(k)), lambda x: x.isNotNull()) for k in points}, "topic": F.col("topics"), "speaker": F.col("speakers")}

    def crossed(x: str, y: str) -> Column:
        return F.flatten(F.transform(values[x], lambda a: F.transform(values[y], lambda b: F.concat_ws("\u0001", F.lit(f"{x} {y}"), a, b))))

    met = sides.withColumn("key", F.explode(F.concat(*[crossed(x, y) for x, y in itertools.combinations(values, 2)])))
    keys = lambda df, name: df.select("prev_index", "key", F.col("session_id").alias(name))
    found = keys(met.filter("not is_added"), "removed_id").join(keys(met.filter("is_added"), "added_id"), ["prev_index", "key"]).select("prev_index", "removed_id", "added_id").distinct()
    one = lambda name, alias: sides.select("prev_index", F.col("session_id").alias(name), F.struct("cur_index", *points, "topics", "speakers").alias(alias))
    both = found.join(one("removed_id", "r"), ["prev_index", "removed_id"]).join(one("added_id", "a"), ["prev_index", "added_id"])
    same = {k: F.col(f"r.{k}") == F.col(f"a.{k}") for k in points}
    shared = {k: F.size(F.array_intersect(f"r.{k}", f"a.{k}")) for k in ("topics", "speakers")}
    score = functools.reduce(lambda x, y: x + y, [F.when(same[k], n).otherwise(0) for k, (_, n) in points.items()])
    score = score + F.least(shared["topics"], F.lit(3)) + F.least(shared["speakers"] * 2, F.lit(4))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(same[k], k) for k in points], *[F.when(n > 0, k) for k, n in shared.items()])), ",")
    return both.select("prev_index", F.col("r.cur_index").alias("cur_index"), "removed_id", "added_id", score.alias("score"), reasons.alias("reasons")).filter(F.col("score") >= least)


def with_record(pairs: DataFrame, sessions: DataFrame, fields: tuple[str, ...] = ("end_time_text", "topics", "speakers")) -> DataFrame:
    """Pairs whose one-sided records carry fields of the catalogue by session id, where snapshots have none."""
    extra = sessions.filter("id is not null").groupBy(F.col("id").alias("session_id")).agg(F.max(F.struct(*fields)).alias("x"))
    one = pairs.filter("p is null or c is null").join(extra, "session_id", "left")
    add = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.*", *[F.col(f"x.{f}").alias(f) for f in fields]))
    return one.select("session_id", "prev_index", "cur_index", add("p").alias("p"), add("c").alias("c"))


def comparison(pairs: DataFrame, unstable: int = 2) -> DataFrame:
    """One row per pair: how many sessions came, went, changed, filled up and reopened, and whether the pair is worth a report.

    Sessions that come and go at least ``unstable`` times in all are counted apart, once a pair, as unstable. A pair is
    worth a report if anything was added, removed, unstable, changed in what matters or reopened, or if a session of its
    later snapshot is full.
    """
    moves = added_removed(pairs).select("prev_index", "cur_index", "session_id", "kind")
    often = moves.groupBy("session_id").agg((F.count("*") >= unstable).alias("often"))
    moves = moves.join(often, "session_id").select("prev_index", "cur_index", F.when(F.col("often"), "unstable").otherwise(F.col("kind")).alias("kind"))
    changes = classified_changes(pairs)
    changed = changes.select("prev_index", "cur_index", F.when(F.col("material") != "", "material").otherwise("minor").alias("kind"))
    was, now = band(F.col("p.remaining_capacity")), band(F.col("c.remaining_capacity"))
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    seats = F.array_compact(F.array(F.when(both & (was == "full") & (now == "not-full"), "reopened"), F.when(both & (was != "full") & (now == "full"), "filled"), F.when(F.col("c").isNotNull() & (now == "full"), "full")))
    seen = pairs.select("prev_index", "cur_index", F.explode_outer(seats).alias("kind"))
    kinds = ("added", "removed", "unstable", "material", "minor", "reopened", "filled", "full")
    counts = moves.unionByName(changed).unionByName(seen).groupBy("prev_index", "cur_index").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return counts.withColumn("meaningful", F.expr("added + removed + unstable + material + reopened + full > 0"))

