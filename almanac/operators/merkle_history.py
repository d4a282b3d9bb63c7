"""History of changing attributes from periodic full snapshots, by Merkle comparison.

Every snapshot gets a tree: entities are hashed into leaf buckets, a leaf's digest combines the digests of its
entities' states, a node's digest combines those of its children. Successive snapshots are compared from the root; a
level is compared only below nodes that differ. The rows of the leaves that still differ are compared entity by entity,
and every state that begins there is appended to the history, with the last snapshot before the next event as its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import fold
from almanac.operators.captures import capture_order, latest_rows
from almanac.session import materialize, small, written

FANOUT_BITS = 4
KEYS_PER_LEAF = 32


def state_hash(*columns: str) -> Column:
    """A 64-bit digest of a state in which null differs from every value."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])


def tree_depth(keys: int) -> int:
    """Levels below the root, so that a leaf holds about KEYS_PER_LEAF keys."""
    return max(1, math.ceil(math.log2(max(2, keys / KEYS_PER_LEAF)) / FANOUT_BITS))


def leaf_digests(states: DataFrame) -> DataFrame:
    """``(node, ord, digest)`` of the lowest level; states: ``(leaf, key, ord, h)``."""
    return states.groupBy(F.col("leaf").alias("node"), "ord").agg(
        F.xxhash64(F.bit_xor(F.xxhash64("key", "h")), F.count("*")).alias("digest")
    )


def parent_digests(level: DataFrame) -> DataFrame:
    """The level above: a node combines its children's digests."""
    parent = F.shiftright("node", FANOUT_BITS).alias("node")
    return level.groupBy(parent, "ord").agg(F.bit_xor(F.xxhash64("node", "digest")).alias("digest"))


def differing(level: DataFrame, last: int) -> DataFrame:
    """``(node, ord)`` whose digest differs from that of the snapshot before; a node without entities has none."""
    sides = level.select("node", F.explode(F.array(F.struct("ord", F.col("digest").alias("cur"), F.lit(None).cast("long").alias("prev")), F.struct((F.col("ord") + 1).alias("ord"), F.lit(None).cast("long").alias("cur"), F.col("digest").alias("prev")))).alias("s")).select("node", "s.*").filter(F.col("ord") <= last)
    return sides.groupBy("node", "ord").agg(F.max("cur").alias("cur"), F.max("prev").alias("prev")).filter(~F.col("cur").eqNullSafe(F.col("prev"))).select("node", "ord")


def changed_leaves(leaves: DataFrame, depth: int, last: int) -> DataFrame:
    """``(node, ord)`` of leaves that differ between successive snapshots, found by descending from the root."""
    levels = [leaves]
    for _ in range(depth):
        levels.append(materialize(parent_digests(levels[-1])))
    found = differing(levels.pop(), last)
    while levels:
        below = levels.pop()
        open_nodes = found.select(F.col("node").alias("parent"), F.col("ord").alias("at"))
        # A node's digest is looked at in a snapshot if its parent differs there or in the snapshot after it.
        wanted = open_nodes.select("parent", F.explode(F.array("at", F.col("at") - 1)).alias("ord")).distinct()
        part = below.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(wanted, ["parent", "ord"], "left_semi")
        found = differing(part.drop("parent"), last).withColumn("parent", F.shiftright("node", FANOUT_BITS))
        found = found.join(open_nodes.withColumnRenamed("at", "ord"), ["parent", "ord"], "left_semi").select("node", "ord")
    return found


def version_history(states: DataFrame, depth: int, last: int, values: list[str]) -> DataFrame:
    """``(key, from_ord, to_ord, *values)`` of every state. states: ``(leaf, key, ord, h, *values)``, one row per key and ord."""
    leaves = materialize(leaf_digests(states))
    changed = changed_leaves(leaves, depth, last).groupBy(F.col("node").alias("leaf")).agg(F.collect_set("ord").alias("at"))
    none = F.lit(None)
    cur = F.struct("h", *values)
    sides = (
        states.join(changed, "leaf")
        .select("leaf", "key", "at", F.explode(F.array(F.struct(F.col("ord").alias("ord"), cur.alias("cur"), none.cast("long").alias("prev")), F.struct((F.col("ord") + 1).alias("ord"), F.when(F.lit(False), cur).alias("cur"), F.col("h").alias("prev")))).alias("s"))
        .filter(F.array_contains("at", F.col("s.ord")))
        .select("leaf", "key", "s.*")
    )
    # The leaf in the keys keeps the partitioning of the join: comparing and ordering the events needs no other shuffle.
    events = sides.groupBy("leaf", "key", "ord").agg(F.max("cur").alias("cur"), F.max("prev").alias("prev"))
    events = events.filter(~F.col("cur.h").eqNullSafe(F.col("prev")))
    until = F.coalesce(F.lead("ord").over(Window.partitionBy("leaf", "key").orderBy("ord")) - 1, F.lit(last))
    return events.withColumn("to_ord", until).filter("cur is not null").select("key", F.col("ord").alias("from_ord"), "to_ord", *[f"cur.{v}" for v in values])


def digest_tree(states: DataFrame, depth: int) -> DataFrame:
    """``(level, node, digest)`` of one snapshot, the leaves at level ``depth`` and the root at 0: what is kept for the next one.

    states: ``(leaf, key, h)``, one row per key.
    """
    level = materialize(leaf_digests(states.withColumn("ord", F.lit(0))).select("node", "digest"))
    out = level.select(F.lit(depth).alias("level"), "node", "digest")
    for d in reversed(range(depth)):
        level = materialize(parent_digests(level.withColumn("ord", F.lit(0))).select("node", "digest"))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "node", "digest"))
    return out


def differing_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """``(node)`` of the leaves in which two trees differ; a level is compared only below nodes that differ."""
    found = None
    for d in range(depth + 1):
        sides = [t.filter(F.col("level") == d).select("node", F.col("digest").alias(c)) for t, c in ((old, "was"), (new, "now"))]
        if found is not None:
            parents = small(found.withColumnRenamed("node", "parent"))
            sides = [s.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(parents, "parent", "left_semi").drop("parent") for s in sides]
        both = sides[0].join(sides[1], "node", "full")
        found = materialize(both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("node"))
    return found


def append_snapshot(history: DataFrame, tree: DataFrame, states: DataFrame, depth: int, at: int, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The history with the versions that begin in a new snapshot ``at``, and the tree to keep for the next one.

    history: ``(leaf, key, from_ord, to_ord, *values)`` in which what still holds has no ``to_ord``; states: ``(leaf, key,
    h, *values)`` of the new snapshot. Versions in leaves whose digests agree stay as they are, whatever their number;
    in the others what holds no more ends at the snapshot before, and new states are appended.
    """
    new = digest_tree(states, depth)
    leaves = small(differing_leaves(tree, new, depth).withColumnRenamed("node", "leaf"))
    open_ = history.filter("to_ord is null").join(leaves, "leaf", "left_semi").select("leaf", "key", "from_ord", state_hash(*values).alias("h"))
    now = states.join(leaves, "leaf", "left_semi")
    ended = open_.join(now.select("leaf", "key", "h"), ["leaf", "key", "h"], "left_anti").select("leaf", "key", "from_ord", F.lit(at - 1).alias("until"))
    begun = now.join(open_, ["leaf", "key", "h"], "left_anti").select("leaf", "key", F.lit(at).alias("from_ord"), F.lit(None).cast("int").alias("to_ord"), *values)
    closed = history.join(ended, ["leaf", "key", "from_ord"], "left").select("leaf", "key", "from_ord", F.coalesce("to_ord", "until").alias("to_ord"), *values)
    return closed.unionByName(begun), new


VALUES = ["remaining_capacity", "registrant_count", "room"]


def appended_history(facts: DataFrame, index: DataFrame, appended: int = 1) -> DataFrame:
    """``session_history``, with the last ``appended`` captures added one by one to the history of those before.

    Nulls of a new capture are filled from the last version of their session, which is looked up for rows with nulls
    only. Fields and cases as in ``session_history``.
    """
    order = capture_order(index, facts)
    last = order.agg(F.max("ord")).first()[0] or 0
    first = max(1, last - appended + 1)
    depth = tree_depth(facts.agg(F.approx_count_distinct("session_id")).first()[0])
    leaf = F.shiftrightunsigned(F.xxhash64("key"), 64 - FANOUT_BITS * depth).alias("leaf")
    latest = written(latest_rows(facts, order, remaining_capacity=F.col("remaining_capacity"), registrant_count=F.col("registrant_count"), room=fold(F.col("room"))).withColumnRenamed("session_id", "key"))
    so_far = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    before = latest.filter(F.col("ord") < first).select(leaf, "key", "ord", *[F.last(v, ignorenulls=True).over(so_far).alias(v) for v in VALUES])
    states = written(before.withColumn("h", state_hash(*VALUES)))
    done = version_history(states, depth, first - 1, VALUES)
    history = written(done.select(leaf, "key", "from_ord", F.when(F.col("to_ord") < first - 1, F.col("to_ord")).cast("int").alias("to_ord"), *VALUES))
    tree = digest_tree(states.filter(F.col("ord") == first - 1), depth)
    for at in range(first, last + 1):
        rows = latest.filter(F.col("ord") == at)
        blank = rows.filter(" or ".join(f"{v} is null" for v in VALUES)).select("key")
        known = history.join(blank, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct(*VALUES), "from_ord").alias("k"))
        filled = rows.join(known, "key", "left").select(leaf, "key", *[F.coalesce(v, f"k.{v}").alias(v) for v in VALUES])
        history, tree = append_snapshot(history, tree, written(filled.withColumn("h", state_hash(*VALUES))), depth, at, VALUES)
        history = written(history)
    ends = order.select(F.col("ord").alias("to_ord"), F.col("order_index").alias("to_index"))
    begins = order.select(F.col("ord").alias("from_ord"), F.col("order_index").alias("from_index"))
    full = history.withColumn("to_ord", F.coalesce("to_ord", F.lit(last)))
    return full.join(small(begins), "from_ord").join(small(ends), "to_ord").select(F.col("key").alias("session_id"), "from_index", "to_index", *VALUES)


def session_history(facts: DataFrame, index: DataFrame) -> DataFrame:
    """Every state of a session's seats left, registrations and room, with the first and last capture it held for.

    ``(session_id, from_index, to_index, remaining_capacity, registrant_count, room)``. A null value means the last
    known one of that session, also across absences; rooms are compared folded. Empty input gives an empty history.
    Columns other than those used are ignored, whatever their names.
    """
    order = capture_order(index, facts)
    last = order.agg(F.max("ord")).first()[0] or 0
    values = VALUES
    latest = latest_rows(facts, order, remaining_capacity=F.col("remaining_capacity"), registrant_count=F.col("registrant_count"), room=fold(F.col("room")))
    keys = facts.agg(F.approx_count_distinct("session_id")).first()[0]
    depth = tree_depth(keys)
    leaf = F.shiftrightunsigned(F.xxhash64("session_id"), 64 - FANOUT_BITS * depth).alias("leaf")
    so_far = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = latest.select(leaf, F.col("session_id").alias("key"), "ord", *[F.last(v, ignorenulls=True).over(so_far).alias(v) for v in values])
    states = written(filled.withColumn("h", state_hash(*values)))
    found = version_history(states, depth, last, values)
    first = small(order.select(F.col("ord").alias("from_ord"), F.col("order_index").alias("from_index")))
    final = small(order.select(F.col("ord").alias("to_ord"), F.col("order_index").alias("to_index")))
    return found.join(first, "from_ord").join(final, "to_ord").select(F.col("key").alias("session_id"), "from_index", "to_index", *values)


def p1_found(facts: DataFrame, index: DataFrame) -> DataFrame:
    return session_history(facts, index).select("session_id", F.col("from_index").cast("int"), F.col("to_index").cast("int"))
