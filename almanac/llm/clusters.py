"""Clusters of mutually similar records, by Gaussian mixtures on standardised, reduced features.

Features are standardised and reduced over all rows. Cross-polytope hashes of the unit vectors bring similar rows into a
block at least once. Every block is described by a mixture of Gaussians with regularised diagonal covariances, fitted by
expectation-maximisation; of mixtures with different numbers of components the one with the least Bayesian information
criterion counts. Responsibilities assign each row to a component, the member of highest density stands for it, and members
whose exact cosine with that one is below the bound leave it. Components of different blocks that share a row are one.

Two rounds come first in which components of all blocks are condensed to their members of highest density, and more as long
as blocks are crowded, so that a hot spot costs in proportion to its rows. A row belongs to a component by what it has in
common with the component, not with single members of it, so nothing is lost with the members that the round has placed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.components import connected_components
from almanac.session import materialize, small, written

SIMILARITY = 0.8
#: Chance that two rows at the bound share a block.
RECALL = 0.9999
EXPLAINED = 0.9
CHUNK = 1200
BLOCK_ROWS = 500
ROUNDS = 2
#: Similarity from which the criterion prefers one component for two rows; below the bound, since distances of reduced
#: features differ from those of the vectors by about a fifth. The exact cosine verifies what the mixture has joined.
RESOLUTION = 0.73
#: Similarities of leaders that the mixtures start from.
STARTS = (0.68, 0.8, 0.9)
#: Rows that the regularising variance counts for in each component's own variances.
PRIOR_ROWS = 8.0
STEPS = 5


def unit_rows(table: DataFrame, dims: int, key: str, vector: str) -> DataFrame:
    """``(id, u binary)``: one unit vector of floats per key; vectors that are null, of other length, all zero or not finite don't count."""
    once = table.filter(F.col(key).isNotNull() & (F.size(vector) == dims)).groupBy(F.col(key).alias("id")).agg(F.max(vector).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"]).astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    norm = np.sqrt((v * v).sum(axis=1))
                    good = (norm > 0) & (norm < np.inf)
                    u = (v[good] / norm[good, None]).astype(np.float32)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[good], "u": [x.tobytes() for x in u]})

    return once.mapInPandas(run, "id long, u binary")


def matrix_of(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dims)


def projection(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, matrix that standardises and reduces, and the variance kept; moments are added up by Spark over all rows."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims * dims + dims + 1)
        for pdf in batches:
            if len(pdf):
                x = matrix_of(pdf["u"], dims).astype(np.float64)
                total += np.concatenate([(x.T @ x).ravel(), x.sum(axis=0), [len(x)]])
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    parts = rows.select("u").mapInPandas(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    got = parts.orderBy("k").toPandas()["v"].to_numpy()
    if len(got) == 0 or got[-1] == 0:
        return np.zeros(dims), np.eye(dims), float(dims)
    n = got[-1]
    mean = got[dims * dims : -1] / n
    cov = got[: dims * dims].reshape(dims, dims) / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    kept = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-12), EXPLAINED) + 1)
    return mean, vectors[:, :kept] / std[:, None], float(values[:kept].sum()) / max(1e-9, 1 - mean @ mean)


def rotations(dims: int, number: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(number)]).astype(np.float32)


def shapes(dims: int) -> list[tuple[int, int]]:
    """How many axes of the first and of the second rotation make a bucket, from few buckets to many."""
    first = [a for a in (1, 2, 4, 8, 16, 32) if a < dims] + [dims]
    return [(a, 0) for a in first] + [(dims, a) for a in first]


def buckets_of(axes: tuple[int, int]) -> int:
    return 2 * axes[0] * max(1, 2 * axes[1])


def bucket_of(u: np.ndarray, turns: np.ndarray, axes: tuple[int, int]) -> np.ndarray:
    """The axis nearest to a vector among the first ones of a rotation, and that among those of another one."""
    n = np.arange(len(u))

    def axis(y: np.ndarray) -> np.ndarray:
        k = np.abs(y).argmax(axis=1)
        return 2 * k + (y[n, k] > 0)

    first = axis(u @ turns[0][:, : axes[0]])
    return first * (2 * axes[1]) + axis(u @ turns[1][:, : axes[1]]) if axes[1] else first


def meeting_chance(dims: int, axes: tuple[int, int], cosine: float) -> float:
    """How often two vectors of a given similarity share a bucket, by a fixed simulation."""
    rng = np.random.default_rng(7)
    hits, total = 0, 0
    for k in range(20):
        x, y = rng.normal(size=(2, 500, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        z = cosine * x + math.sqrt(1 - cosine**2) * y
        turns = rotations(dims, 2, 1000 + k)
        hits += (bucket_of(x.astype(np.float32), turns, axes) == bucket_of(z.astype(np.float32), turns, axes)).sum()
        total += len(x)
    return max(hits / total, 1e-3)


def fit_mixture(x: np.ndarray, means: np.ndarray, floor: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The information criterion, each row's component and its log density there; x: rows of reduced features.

    Components have diagonal covariances, drawn towards ``floor`` as if PRIOR_ROWS rows had that variance. A component
    costs its mean, its share, and its variances as far as its own rows decide on them.
    """
    n, d = x.shape
    k = len(means)
    x2 = x * x
    var, share = np.full((k, d), floor, x.dtype), np.full(k, 1.0 / k, x.dtype)
    for _ in range(STEPS):
        precision = 1 / var
        dist = x2 @ precision.T - 2 * (x @ (means * precision).T) + (means * means * precision).sum(axis=1)
        logp = np.log(share) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + dist)
        top = logp.max(axis=1, keepdims=True)
        r = np.exp(logp - top)
        total = r.sum(axis=1, keepdims=True)
        r /= total
        weight = r.sum(axis=0) + 1e-6
        new = (r.T @ x) / weight[:, None]
        scatter = np.maximum((r.T @ x2) / weight[:, None] - new * new, 0)
        own = weight[:, None]
        var = (PRIOR_ROWS * floor + own * scatter) / (PRIOR_ROWS + own)
        share = weight / weight.sum()
        moved = np.abs(new - means).max()
        means = new
        if moved < 1e-3:
            break
    loglik = float((top[:, 0] + np.log(total[:, 0])).sum())
    free = float((d + 1 + d * weight / (PRIOR_ROWS + weight) * (weight > 1.5)).sum())
    best = r.argmax(axis=1)
    return free * math.log(max(n, 2)) - 2 * loglik, best, logp[np.arange(n), best]


def leaders(square: np.ndarray, radius: float) -> np.ndarray:
    """Rows that are farther than the radius from all leaders before them; square: distances of all rows, squared."""
    found = [0]
    dist = square[0].copy()
    while len(found) < len(square):
        far = int(dist.argmax())
        if dist[far] <= radius:
            break
        found.append(far)
        np.minimum(dist, square[far], out=dist)
    return np.array(found)


def mixture_components(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the label of its component, or -1 if it is alone, and its log density there; x: reduced features.

    ``scale``: squared distance of two rows' features per 2 (1 - cosine). A row farther from all others than rows of a
    component can be is alone without a fit.
    """
    n, d = x.shape
    label, density = np.full(n, -1), np.zeros(n)
    sq = (x * x).sum(axis=1)
    square = np.maximum(sq[:, None] - 2 * (x @ x.T) + sq[None], 0)
    near = square <= 2 * (1 - STARTS[0]) * scale * 1.25
    at = np.flatnonzero(near.sum(axis=1) > 1)
    if len(at) < 2:
        return label, density
    y, square = x[at], square[np.ix_(at, at)]
    floor = 2 * (1 - RESOLUTION) * scale / (2 * (d + 1) * math.log(max(len(at), 3)))
    best, tried = None, set()
    for cosine in STARTS:
        start = leaders(square, 2 * (1 - cosine) * scale)
        if len(start) not in tried:
            tried.add(len(start))
            got = fit_mixture(y, y[start].copy(), floor)
            best = got if best is None or got[0] < best[0] else best
    label[at], density[at] = best[1], best[2]
    return label, density


def _grouped(dims: int, mean, matrix, scale: float):
    """A function over a block that gives ``(id, head)`` of all members of components of two rows or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, u = ids[order], matrix_of(pdf["u"], dims)[order]
        label, density = mixture_components((u - mean.value) @ matrix.value, scale)
        at = np.flatnonzero(label >= 0)
        # The head of a component is its row of highest density, the smaller one of equals.
        by = at[np.lexsort((ids[at], -density[at], label[at]))]
        first = np.flatnonzero(np.diff(label[by], prepend=-1))
        head = np.zeros(int(label.max(initial=-1)) + 1, np.int64)
        head[label[by[first]]] = by[first]
        own = head[label[at]]
        kept = (np.einsum("ij,ij->i", u[at], u[own]) >= SIMILARITY) & (own != at)
        return pd.DataFrame({"id": ids[at[kept]], "head": ids[own[kept]]})

    return run


def similar_groups(rows: DataFrame, dims: int) -> DataFrame:
    """``(id, cluster)`` of every row that has a similar one; rows: ``(id long, u binary)`` of unit vectors."""
    spark = rows.sparkSession
    rows = written(rows)
    mean, matrix, scale = projection(rows, dims)
    mean_b, matrix_b = spark.sparkContext.broadcast(mean.astype(np.float32)), spark.sparkContext.broadcast(matrix.astype(np.float32))
    cluster = _grouped(dims, mean_b, matrix_b, scale)

    def shape(n: int) -> tuple[int, int]:
        return next((a for a in shapes(dims) if buckets_of(a) * BLOCK_ROWS >= n), shapes(dims)[-1])

    def blocks(df: DataFrame, tables: int, axes: tuple[int, int], seed: int) -> DataFrame:
        """``(t, bucket, chunks, id, u)``: each row once per table; ``chunks`` is how many parts a crowded bucket has."""
        turns = spark.sparkContext.broadcast(rotations(dims, 2 * tables, seed))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    u = matrix_of(pdf["u"], dims)
                    keys = np.stack([bucket_of(u, turns.value[2 * t : 2 * t + 2], axes) for t in range(tables)], axis=1)
                    yield pdf.assign(keys=list(keys.astype(np.int64)))

        met = df.mapInPandas(run, "id long, u binary, keys array<long>").select("id", "u", F.posexplode("keys").alias("t", "bucket"))
        crowded = met.groupBy("t", "bucket").count().filter(F.col("count") > CHUNK)
        crowded = materialize(crowded.select("t", "bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
        return met.join(small(crowded), ["t", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))

    heads, edges, n, done = rows, [], rows.count(), 0
    while True:
        met = blocks(heads, 1, shape(n), done + 1)
        crowded = not met.filter("chunks > 1").limit(1).isEmpty()
        if done >= ROUNDS and not crowded:
            break
        own = F.pmod(F.xxhash64("id", F.lit(done)), F.col("chunks"))
        found = written(met.withColumn("chunk", own).groupBy("bucket", "chunk").applyInPandas(cluster, "id long, head long"))
        edges.append(found)
        heads = written(heads.join(found.select("id").distinct(), "id", "left_anti"))
        done, before, n = done + 1, n, heads.count()
        if done >= ROUNDS and n > 0.95 * before:
            break  # what is crowded is so by rows that aren't similar: no part of it can stand for another
    axes = shape(n)
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(meeting_chance(dims, axes, SIMILARITY), 0.999999))))
    # A block that is crowded all the same is compared part by part, every part with every other.
    own = F.pmod(F.xxhash64("id", "t"), F.col("chunks")).cast("int")
    split = blocks(heads, tables, axes, 77).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = split.select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "u")
    edges.append(parts.groupBy("t", "bucket", "i", "j").applyInPandas(cluster, "id long, head long").distinct())
    links = edges[0]
    for e in edges[1:]:
        links = links.unionByName(e)
    return connected_components(links.toDF("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def session_clusters(table: DataFrame, dims: int = 64, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """``(row_id, cluster_id)`` of every row that belongs to a cluster of at least two; ``cluster_id`` is its smallest row.

    A repeated key counts once (the greatest vector, if they differ); null, short, long and zero vectors belong to no
    cluster; an empty table has no clusters.
    """
    groups = similar_groups(unit_rows(table, dims, key, vector), dims)
    return groups.select(F.col("id").alias(key), F.col("cluster").alias("cluster_id"))


def typical_members(table: DataFrame, typical: int = 3, dims: int = 64) -> DataFrame:
    """``(cluster_id, place, row_id, density)``: the members of highest density of every cluster, the best at place 1.

    Density is that of the cluster's Gaussian over the standardised, reduced features, with a diagonal covariance drawn
    towards the mean one of all clusters; ties (to six places) go to the smaller row. Sums are added up per task before
    they are shuffled, so a cluster with a third of all rows is no hot spot.
    """
    spark = table.sparkSession
    units = written(unit_rows(table, dims, "row_id", "embedding"))
    placed = similar_groups(units, dims)
    mean, matrix, _ = projection(units, dims)
    mean_b, matrix_b = spark.sparkContext.broadcast(mean), spark.sparkContext.broadcast(matrix)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = (matrix_of(pdf["u"], dims) - mean_b.value) @ matrix_b.value
                yield pd.DataFrame({"cluster": pdf["cluster"], "id": pdf["id"], "x": list(x)})

    members = written(units.join(placed, "id").mapInPandas(features, "cluster long, id long, x array<double>"))
    axis = members.select("cluster", F.posexplode("x").alias("k", "x")).groupBy("cluster", "k").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    axis = materialize(axis)
    pooled = axis.groupBy("k").agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("v"))
    var = F.greatest((PRIOR_ROWS * F.col("v") + F.col("n") * F.col("s")) / (PRIOR_ROWS + F.col("n")), F.lit(1e-9))
    params = axis.join(F.broadcast(pooled), "k").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "m", var.alias("v")))).alias("g"))
    terms = F.zip_with("x", "g", lambda x, g: -0.5 * (F.log(2 * math.pi * g["v"]) + (x - g["m"]) * (x - g["m"]) / g["v"]))
    dense = members.join(params, "cluster").select("cluster", "id", F.round(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), 6).alias("density"))
    order = Window.partitionBy("cluster").orderBy(F.desc("density"), "id")
    top = dense.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= typical)
    return top.select(F.col("cluster").alias("cluster_id"), "place", F.col("id").alias("row_id"), "density")


def cluster_profiles(table: DataFrame, dims: int = 64, labels: tuple[str, ...] = ("theme", "ai_focus", "audience")) -> DataFrame:
    """One row per cluster: its size, and of each label the commonest value and how many members have it.

    Null and empty values don't count; ties go to the first by name; a cluster without any labelled member has null and
    0. A repeated row counts once, with its greatest labels.
    """
    placed = written(session_clusters(table, dims))
    once = table.groupBy("row_id").agg(*[F.max(f"labels.{c}").alias(c) for c in labels])
    named = placed.join(once, "row_id", "left").select("cluster_id", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.nullif(c, F.lit("")).alias("value")) for c in labels])).alias("x"))
    counts = named.groupBy("cluster_id", "x.label", "x.value").agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster_id", "label").agg(F.sum("n").alias("size"), F.min_by(F.struct("value", "n"), F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), "value"))).alias("b"))
    pick = lambda c, f: F.max(F.when(F.col("label") == c, F.col(f)))
    columns = [x for c in labels for x in (pick(c, "b.value").alias(c), F.coalesce(pick(c, "b.n"), F.lit(0)).alias(f"{c}_members"))]
    return best.groupBy("cluster_id").agg(F.max("size").alias("size"), *columns)
