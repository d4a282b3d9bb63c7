"""All similar pairs between set-valued records, by a forest of sorted minhash sketches.

Equal sets are taken together first. Every tree orders the sets lexicographically by its own minhash signature, so that
sets with a common prefix stand side by side. The order is walked: a neighbourhood of sets with a common prefix of length
1 is deepened, place by place, until it has few sets or the signature ends. A pair at the threshold shares a prefix of
length d with probability threshold ** d, so every set knows from the depths of its own neighbourhoods what the chance is
that a partner was missed in all trees so far; sets go on to further trees until that chance is below the target.
Sets in crowded neighbourhoods are deepened further and therefore get more trees; nothing is dropped. Neighbours are
filtered by their elements' hashes and verified on the elements themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import squeeze
from almanac.session import materialize, small, written

RECALL = 0.9999
#: Length of a signature, and the sets from which on a neighbourhood is deepened.
MAX_DEPTH, NODE = 6, 40
#: Trees of the first round and at most of any other one.
FIRST_TREES, MOST_TREES = 12, 48
#: Rows with the same beginning of a signature that a task sorts and walks; what is larger is parted by the next places.
SPLIT = 100_000
SEED = 20270


def trees_needed(threshold: float, depth: int, recall: float = RECALL) -> int:
    """Trees in which a pair at the threshold shares a prefix of this depth at least once, with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes: list[np.ndarray], tree: int) -> np.ndarray:
    """For each set its minhash signature in a tree, as 32-bit numbers; sets aren't empty."""
    flat = np.concatenate(hashes).astype(np.int64).view(np.uint64)
    starts = np.cumsum([0, *map(len, hashes)])[:-1]
    out = np.empty((len(hashes), MAX_DEPTH), np.int32)
    with np.errstate(over="ignore"):
        for level in range(MAX_DEPTH):
            salt = _mix(np.array([SEED + tree * 64 + level], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, level] = (np.minimum.reduceat(_mix(flat ^ salt), starts) & np.uint64(0x7FFFFFFF)).astype(np.int32)
    return out


def _sketcher(trees: range):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sets = list(pdf["hashes"])
                for t in trees:
                    yield pd.DataFrame({"set_id": pdf["set_id"], "tree": np.int32(t), "sig": list(signatures(sets, t))})

    return run


def neighbourhoods(place: np.ndarray, sig: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, key and size of each row's neighbourhood; rows are in the order of ``place`` and ``sig``.

    Rows next to each other share a prefix as long as their signatures agree from the first place on. A neighbourhood
    of depth d is a longest stretch of rows that share d places; ``begin`` is the least depth looked at.
    """
    n, most = sig.shape
    same = np.logical_and.accumulate((sig[1:] == sig[:-1]) & (place[1:] == place[:-1])[:, None], axis=1)
    common = same.sum(axis=1)
    depth, size, node = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = place.astype(np.int64).view(np.uint64).copy()
    with np.errstate(over="ignore"):
        for d in range(1, most + 1):
            key = _mix(key * np.uint64(3) ^ sig[:, d - 1].astype(np.uint64))
            stretch = np.cumsum(np.concatenate([[True], common < d])) - 1
            count = np.bincount(stretch)[stretch]
            leaf = (depth == 0) & (begin <= d) & ((count <= NODE) | (d == most))
            depth[leaf], size[leaf], node[leaf] = d, count[leaf], key.view(np.int64)[leaf]
    return depth, node, size


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks sorted rows place by place; a place may go on over several batches."""

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        depth, node, size = neighbourhoods(pdf["place"].to_numpy(), np.stack(pdf["sig"]), pdf["begin"].to_numpy())
        return pd.DataFrame({"set_id": pdf["set_id"], "depth": depth, "node": node, "size": size})

    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf):
            place = pdf["place"].to_numpy()
            cut = int(np.flatnonzero(place != place[-1]).max(initial=-1)) + 1
            if cut:
                yield leaves(pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(pdf.iloc[cut:])
    if rest:
        yield leaves(pd.concat(rest, ignore_index=True))


def placed(nodes: DataFrame, sets: int) -> DataFrame:
    """Adds ``place``, what is sorted and walked together, and ``begin``, how many places of the signature it stands for.

    A beginning that more than SPLIT rows share is parted by the next place of the signature, again and again: its
    neighbourhood is crowded at that depth in any case. Of no more ``sets`` than that none can be, so nothing is counted.
    """
    beginning = lambda d: F.xxhash64("tree", F.slice("sig", 1, d))
    out = nodes.withColumn("place", beginning(1)).withColumn("begin", F.lit(1))
    for d in range(2, MAX_DEPTH + 1 if sets > SPLIT else 2):
        hot = materialize(out.filter(F.col("begin") == d - 1).groupBy("place").count().filter(F.col("count") > SPLIT).select("place", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        out = out.join(small(hot), "place", "left")
        out = out.withColumn("place", F.when(F.col("hot"), beginning(d)).otherwise(F.col("place"))).withColumn("begin", F.when(F.col("hot"), d).otherwise(F.col("begin"))).drop("hot")
    return out


def similar_sets(sets: DataFrame, threshold: float, common: int = 1) -> DataFrame:
    """``(set_a, set_b)``, a < b: sets with at least ``common`` common elements that make up the share ``threshold`` of their union.

    sets: ``(set_id string, items array<string>)``, distinct sets without repeated items.
    """
    hashed = written(sets.filter(F.size("items") >= max(1, common)).select("set_id", "items", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes")))
    target, number = math.log(1 - RECALL), hashed.count()
    active, first, trees, found = hashed.select("set_id", "hashes", F.lit(0.0).alias("missed")), 0, FIRST_TREES, None
    while True:
        nodes = active.select("set_id", "hashes").mapInPandas(_sketcher(range(first, first + trees)), "set_id string, tree int, sig array<int>")
        ordered = placed(nodes, number).repartition("place").sortWithinPartitions("place", "sig")
        leaves = written(ordered.mapInPandas(_walk, "set_id string, depth int, node long, size long"))
        near = leaves.filter("size > 1").select("set_id", "node")
        found = near if found is None else found.unionByName(near)
        # The chance, as a logarithm, that a partner at the threshold was in none of a set's neighbourhoods.
        chance = leaves.groupBy("set_id").agg(F.sum(F.log1p(-F.pow(F.lit(threshold), F.col("depth")))).alias("more"))
        state = active.join(chance, "set_id").select("set_id", "hashes", (F.col("missed") + F.col("more")).alias("missed"))
        active = written(state.filter(F.col("missed") > target))
        first += trees
        left = active.agg(F.max(F.lit(target) / F.col("missed") - 1)).first()[0]
        if left is None:
            break
        # As many further trees as the slowest set needs if its neighbourhoods stay as deep as they were.
        trees = max(1, min(MOST_TREES, math.ceil(left * first)))
    nodes = found.join(hashed.select("set_id", "hashes"), "set_id")
    a, b = nodes.alias("a"), nodes.alias("b")
    na, nb = F.size("a.hashes"), F.size("b.hashes")
    beside = (F.col("a.node") == F.col("b.node")) & (F.col("a.set_id") < F.col("b.set_id"))
    sized = F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9
    candidates = a.join(b, beside & sized & _overlap(F.col("a.hashes"), F.col("b.hashes"), threshold, common)).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b")).distinct()
    items = hashed.select("set_id", "items")
    both = candidates.join(items.toDF("set_a", "items_a"), "set_a").join(items.toDF("set_b", "items_b"), "set_b")
    return both.filter(_overlap(F.col("items_a"), F.col("items_b"), threshold, common)).select("set_a", "set_b")


def _overlap(x: Column, y: Column, threshold: float, common: int) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return (shared >= common) & (shared >= (F.size(x) + F.size(y) - shared) * threshold - 1e-9)


def topic_set(topics: Column) -> Column:
    """Topics as they are compared: split at '|', lower case, squeezed, without blank, null and repeated ones, sorted."""
    apart = F.flatten(F.transform(F.filter(topics, lambda x: x.isNotNull()), lambda x: F.split(x, r"\|")))
    clean = F.filter(F.transform(apart, lambda x: squeeze(F.lower(x))), lambda x: x != "")
    return F.array_sort(F.array_distinct(clean))


def topic_sets(sessions: DataFrame, common: int = 4) -> DataFrame:
    """``(items, set_id, n, id)``: each session with its set of topics, written once; ``n`` sessions have the same set.

    One row per id counts (the greatest set if they differ); rows without an id and sets of fewer than ``common``
    topics are left out, since they have no pairs.
    """
    once = sessions.filter("id is not null").select("id", topic_set(F.col("topics")).alias("items")).groupBy("id").agg(F.max("items").alias("items"))
    members = written(once.filter(F.size("items") >= common))
    sets = members.groupBy("items").agg(F.min("id").alias("set_id"), F.count("*").alias("n"))
    return written(members.join(sets, "items"))


def topic_pairs(sessions: DataFrame, threshold: float = 0.6, common: int = 4) -> DataFrame:
    """``(id_a, id_b)``, a < b: sessions whose topic sets overlap strongly.

    Sessions with equal sets are joined through their set, so they cost the search nothing; the pairs are as many as
    asked for. ``topic_links`` gives the same in one row per session. See ``topic_sets`` for which rows count.
    """
    members = topic_sets(sessions, common)
    pairs = similar_sets(members.filter("id = set_id"), threshold, common)
    left, right = members.select(F.col("set_id").alias("set_a"), F.col("id").alias("x")), members.select(F.col("set_id").alias("set_b"), F.col("id").alias("y"))
    between = pairs.join(left, "set_a").join(right, "set_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = members.filter("n > 1")
    within = copies.select("set_id", F.col("id").alias("id_a")).join(copies.select("set_id", F.col("id").alias("id_b")), "set_id").filter("id_a < id_b").select("id_a", "id_b")
    return between.unionByName(within)


def topic_links(sessions: DataFrame, threshold: float = 0.6, common: int = 4) -> DataFrame:
    """``(id, set_id, copies, links)``: one row per session, its set's first session, how many others have the same set, and
    with how many sessions its set overlaps strongly, those included; links are counted by sets, never expanded.
    """
    members = topic_sets(sessions, common)
    sizes = members.filter("id = set_id").select("set_id", "n")
    pairs = materialize(similar_sets(members.filter("id = set_id"), threshold, common))
    both = pairs.unionByName(pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b")))
    linked = both.join(sizes.toDF("set_b", "n"), "set_b").groupBy(F.col("set_a").alias("set_id")).agg(F.sum("n").alias("others"))
    return members.join(linked, "set_id", "left").select("id", "set_id", (F.col("n") - 1).alias("copies"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
