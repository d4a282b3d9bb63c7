"""Exact nearest neighbours among vectors, and labels judged by neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.catalog import current_sessions
from almanac.operators.diff import token_set
from almanac.session import written

QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Words that don't say what a title is about.
TITLE_STOP = "the and for with from into how what one new scale time".split()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def valid_vectors(table: DataFrame, dims: int = 64) -> DataFrame:
    """One row per row_id with a vector of the right length that isn't all zero; labels blank when missing."""
    once = table.filter(F.col("row_id").isNotNull() & (F.size("embedding") == dims)).groupBy("row_id").agg(F.max(F.struct("embedding", "title", "url", "labels")).alias("b"))
    d = once.select("row_id", "b.*").withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).filter("norm > 0")
    label = lambda f: F.coalesce(F.col(f"labels.{f}"), F.lit("")).alias(f)
    return d.select("row_id", "title", "url", label("ai_focus"), label("theme"), label("audience"), F.transform("embedding", lambda x: x / F.col("norm")).alias("u"))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows gathered into blocks of about ``size``, numbered by hash, so that no block grows with the data; columns without nulls."""
    n = max(1, -(-rows.count() // size))
    lists = [F.collect_list(c).alias(f"{name}_ids" if c == "row_id" else f"{name}_{c}") for c in rows.columns]
    return rows.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int").alias(name)).agg(*lists)


def _meetings(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of queries beside every block of rows."""
    q = _blocks(queries, QUERY_BLOCK, "q")
    r = _blocks(rows, ROW_BLOCK, "r")
    meets = q.select("q").join(r.select("r"))  # numbers of blocks only
    return meets.join(q, "q").join(r, "r").repartition("q", "r")


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, row_id, cosine, rank)``: the k rows most similar to each query, without itself; ties to the smaller id.

    Blocks of queries meet blocks of rows, each meeting is one matrix product that keeps k rows per query, and what is
    kept is ranked once more. Cosines are rounded to 6 digits before they are ranked.
    """
    both = _meetings(rows, queries)

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qi, qu, ri, ru in zip(pdf["q_ids"], pdf["q_u"], pdf["r_ids"], pdf["r_u"]):
                qi, ri = np.asarray(qi), np.asarray(ri)
                order = np.argsort(ri, kind="stable")
                ri = ri[order]
                cos = np.round(np.stack(qu) @ np.stack(ru)[order].T, 6)
                cos[qi[:, None] == ri[None]] = -2
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(qi, top.shape[1]), "row_id": ri[top.ravel()], "cosine": np.take_along_axis(cos, top, 1).ravel()})

    found = both.mapInPandas(product, "query_id long, row_id long, cosine double").filter("cosine > -2")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "row_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def session_neighbours(table: DataFrame, k: int = 8, every: int = 100) -> DataFrame:
    """The neighbours of every row whose id is divisible by ``every``, among all rows."""
    rows = written(valid_vectors(table))
    return nearest(rows.select("row_id", "u"), rows.filter(F.col("row_id") % every == 0).select("row_id", "u"), k)


def weighted_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """The theme for which the fourth powers of similarity add up to most; ties to the greater label."""
    votes = neighbours.join(labels.select("row_id", "theme"), "row_id").groupBy("query_id", "theme").agg(F.round(F.sum(F.pow(F.greatest("cosine", F.lit(0.0)), F.lit(4.0))), 6).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("theme").desc()))
    return votes.withColumn("place", best).filter("place = 1").select("query_id", "theme", "score")


def neighbour_audit(neighbours: DataFrame, labels: DataFrame, least: int = 5) -> DataFrame:
    """Facets in which most of a row's neighbours agree on another label than the row's; ties to the label met first."""
    facets = lambda p: F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias(p)) for f in ("ai_focus", "theme", "audience")])).alias("x")
    near = neighbours.join(labels, "row_id").select("query_id", "rank", facets("label")).select("query_id", "rank", "x.*")
    counts = near.groupBy("query_id", "facet", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    top = F.row_number().over(Window.partitionBy("query_id", "facet").orderBy(F.col("n").desc(), "first"))
    major = counts.withColumn("place", top).filter("place = 1").select("query_id", "facet", F.col("label").alias("majority"), "n")
    own = labels.select(F.col("row_id").alias("query_id"), facets("own")).select("query_id", "x.*")
    return major.join(own, ["query_id", "facet"]).filter((F.col("own") != F.col("majority")) & (F.col("n") >= least)).select("query_id", "facet", "own", "majority", "n")


def disagreements(audit: DataFrame) -> DataFrame:
    return audit.groupBy("facet").agg(F.count("*").alias("flagged"))


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two columns, the same number for the same value."""
    codes = pd.factorize(np.concatenate([a, b]))[0]
    return codes[: len(a)], codes[len(a) :]


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``; elements of a set are distinct."""
    out = np.zeros((len(a), len(b)), np.int32)
    x, y = _codes(np.concatenate([np.empty(0, object), *a]), np.concatenate([np.empty(0, object), *b]))
    i, j = np.repeat(np.arange(len(a)), [len(v) for v in a]), np.repeat(np.arange(len(b)), [len(v) for v in b])
    at, to = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    x, i, y, j = x[at], i[at], y[to], j[to]
    both = np.intersect1d(x, y)
    ends = [np.searchsorted(v, both, side) for v in (x, y) for side in ("left", "right")]
    for m, n, k, l in zip(*ends):  # noqa: E741
        out[np.ix_(i[m:n], j[k:l])] += 1
    return out


def _indexed(q: dict, r: dict) -> np.ndarray:
    """Which rows an index of words gives for which queries: those that share a title word, and for queries marked wide also
    those with one of the query's other words in the title, a common topic or an equal category or label."""
    more = (_shared(q["tokens"], r["head"]) > 0) | (_shared(q["topics"], r["topics"]) > 0)
    for c in ("category", "ai_focus", "theme", "audience"):
        x, y = _codes(q[c], r[c])
        more |= (x[:, None] == y[None]) & (q[c] != "")[:, None]
    return (_shared(q["head"], r["head"]) > 0) | (more & q["wide"].astype(bool)[:, None])


def _related_scores(q: dict, r: dict, indexed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and scores of all queries with all rows; a score of -inf is no candidate."""
    cos = np.round(np.stack(q["u"]) @ np.stack(r["u"]).T, 6)
    codes = {c: _codes(q[c], r[c]) for c in ("title", "ai_focus", "theme", "audience", "category")}
    equal = {c: x[:, None] == y[None] for c, (x, y) in codes.items()}
    same = lambda c, w: np.where(equal[c] & (q[c] != "")[:, None], w, 0.0)
    size = lambda sets: np.array([len(v) for v in sets])
    shared, topics = _shared(q["tokens"], r["tokens"]), _shared(q["topics"], r["topics"])
    union = size(q["topics"])[:, None] + size(r["topics"])[None] - topics
    most = np.maximum(size(q["tokens"])[:, None], size(r["tokens"])[None])
    score = cos + same("ai_focus", 0.03) + same("theme", 0.03) + same("audience", 0.02)
    score = score + topics / np.maximum(union, 1) * 0.06 + shared / np.maximum(most, 1) * 0.05 + same("category", 0.015)
    score = np.copysign(np.floor(np.abs(score) * 1e4 + 0.5) / 1e4, score)
    apart = ~equal["title"] & (q["ids"][:, None] != r["ids"][None])
    if indexed:
        apart &= _indexed(q, r)
    return cos, np.where(apart & (equal["ai_focus"] | (shared > 0)) & ((cos > 0.45) | (shared > 0)), score, -np.inf)


def _sliced(row: dict, size: int = 256) -> Iterator[tuple[dict, dict]]:
    """The queries of a meeting a few at a time, with its rows in the order of their ids."""
    part = lambda name: {c[2:]: v for c, v in row.items() if c.startswith(f"{name}_")}
    q, r = part("q"), part("r")
    order = np.argsort(r["ids"], kind="stable")
    r = {c: v[order] for c, v in r.items()}
    for k in range(0, len(q["ids"]), size):
        yield {c: v[k : k + size] for c, v in q.items()}, r


def related(table: DataFrame, sessions: DataFrame, k: int = 5) -> DataFrame:
    """The sessions most related to each query: cosine with bonuses for equal labels, shared topics, title words and category.

    Every row of another title is scored, inside the products of blocks, so nothing is left out before the ranking.
    Candidates have the query's focus or a common title word; up to a cosine of 0.45 they need the word.
    """
    rows = written(valid_vectors(table))
    s = current_sessions(sessions.filter("url <> ''").select("id", "url", "topics", "session_category")).groupBy("url").agg(F.max(F.struct("id", "topics", "session_category")).alias("s"))
    tokens = F.filter(token_set(F.col("title")), lambda t: (F.length(t) > 2) & ~t.isin(TITLE_STOP))
    topics = F.array_distinct(F.transform(F.filter(F.coalesce("s.topics", F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lower))
    title = F.coalesce(F.concat(F.lit("="), F.lower(F.trim("title"))), F.lit(""))  # apart from a missing one
    full = written(rows.join(s, "url", "left").select("row_id", "u", title.alias("title"), "ai_focus", "theme", "audience", tokens.alias("tokens"), topics.alias("topics"), F.coalesce(F.lower(F.trim("s.session_category")), F.lit("")).alias("category")))

    return _best_related(full, full.filter("row_id % 100 = 0"), k)


def related_indexed(table: DataFrame, sessions: DataFrame, k: int = 5, few: int = 50) -> DataFrame:
    """``related`` among candidates of an index of words, with the words of title, description and topics.

    Candidates share a title word with the query. A query with fewer than ``few`` of them, itself counted, also takes
    rows whose title has one of its other words, and rows with a common topic or an equal category or label. Which
    queries these are is counted in a first pass of blocks. Fields and ties as in ``related``.
    """
    rows = written(valid_vectors(table))
    s = current_sessions(sessions.filter("url <> ''").select("id", "url", "topics", "session_category", "description")).groupBy("url").agg(F.max(F.struct("id", "topics", "session_category", "description")).alias("s"))
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9+.#/-]*"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(TITLE_STOP)))
    listed = F.filter(F.coalesce("s.topics", F.array().cast("array<string>")), lambda x: x.isNotNull())
    title = F.coalesce(F.concat(F.lit("="), F.lower(F.trim("title"))), F.lit(""))  # apart from a missing one
    text = F.concat_ws(" ", "title", "s.description", F.array_join(listed, " "))
    full = rows.join(s, "url", "left").select(
        "row_id", "u", title.alias("title"), "ai_focus", "theme", "audience", words(F.coalesce("title", F.lit(""))).alias("head"), words(text).alias("tokens"),
        F.array_distinct(F.transform(listed, F.lower)).alias("topics"), F.coalesce(F.lower(F.trim("s.session_category")), F.lit("")).alias("category"),
    )
    full = written(full)
    queries = full.filter("row_id % 100 = 0")

    def sharing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for q, r in _sliced(row):
                    yield pd.DataFrame({"row_id": q["ids"], "n": (_shared(q["head"], r["head"]) > 0).sum(axis=1)})

    counted = _meetings(full.select("row_id", "head"), queries.select("row_id", "head")).mapInPandas(sharing, "row_id long, n long")
    wide = counted.groupBy("row_id").agg((F.sum("n") < few).alias("wide"))
    return _best_related(full, written(queries.join(wide, "row_id")), k, indexed=True)


def _best_related(full: DataFrame, queries: DataFrame, k: int, indexed: bool = False) -> DataFrame:
    """The k rows of best score for each query; every block of queries keeps k rows of every block of rows."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for q, r in _sliced(row):
                    cos, score = _related_scores(q, r, indexed)
                    least = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, [min(k, score.shape[1]) - 1]]
                    i, j = np.nonzero((score >= least) & (score > -np.inf))
                    order = np.lexsort((j, -cos[i, j], -score[i, j], i))
                    i, j = i[order], j[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[first], j[first]
                    yield pd.DataFrame({"query_id": q["ids"][i], "row_id": r["ids"][j], "score": score[i, j], "cosine": cos[i, j]})

    d = _meetings(full, queries).mapInPandas(best, "query_id long, row_id long, score double, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("cosine").desc(), "row_id"))
    return d.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "row_id", "score", "cosine", "place")


def blocked_neighbours(table: DataFrame, k: int = 9, pool: int = 180, every: int = 100) -> DataFrame:
    """The nearest of those that share a title word, the ``pool`` with most shared words going to the comparison.

    Ties in shared words go to the greater id. Every word counts, however frequent: shared words are counted inside the
    products of blocks, which pass on at most ``pool`` rows per query. A query that shares no word is compared with all rows.
    """
    tokens = F.filter(token_set(F.col("title")), lambda t: (F.length(t) > 2) & ~t.isin(TITLE_STOP))
    rows = written(valid_vectors(table).select("row_id", "u", tokens.alias("tokens")))
    queries = rows.filter(F.col("row_id") % every == 0)

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for q, r in _sliced(row):
                    shared, n = _shared(q["tokens"], r["tokens"]), len(r["ids"])
                    shared[q["ids"][:, None] == r["ids"][None]] = 0
                    key = shared.astype(np.int64) * n + np.arange(n)  # by shared words, then by id
                    j = np.argpartition(-key, min(pool, n) - 1, axis=1)[:, :pool]
                    i = np.repeat(np.arange(len(j)), j.shape[1])
                    j = j.ravel()
                    i, j = i[shared[i, j] > 0], j[shared[i, j] > 0]
                    cos = np.round(np.stack(q["u"]) @ np.stack(r["u"]).T, 6)
                    yield pd.DataFrame({"query_id": q["ids"][i], "row_id": r["ids"][j], "shared": shared[i, j].astype(np.int64), "cosine": cos[i, j]})

    found = _meetings(rows, queries).mapInPandas(most, "query_id long, row_id long, shared long, cosine double")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("shared").desc(), F.col("row_id").desc()))
    kept = written(found.withColumn("p", first).filter(F.col("p") <= pool).drop("p"))
    alone = queries.join(kept.select(F.col("query_id").alias("row_id")).distinct(), "row_id", "left_anti")
    near = nearest(rows.select("row_id", "u"), written(alone.select("row_id", "u")), k)
    d = kept.unionByName(near.select("query_id", "row_id", F.lit(0).cast("long").alias("shared"), "cosine"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "row_id"))
    return d.withColumn("place", place).filter(F.col("place") <= k)
