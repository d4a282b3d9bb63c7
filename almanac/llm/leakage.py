"""Evaluation texts leaking into training text, found by spaced seeds.

A seed is a window of words of which a fixed mask ignores some positions, hashed. Seeds of the test items are joined
with those of all corpus texts; around every hit the two texts are laid side by side and compared word by word, so an
overlap goes on across substituted words. A mask's span is at most the length of the shortest passage looked for, so
every exact passage has a hit.

The corpus is tokenised once: as long as the items' seeds are few enough to be handed to every task, a text's seeds are
looked up where they are made, and only texts with a hit go on, with their words. With more items than that, the seeds of
both sides are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.text import WORD, html_unescape
from almanac.session import small, written

#: Positions looked at by each mask; the others may be substituted. Their span is at most 12 words.
MASKS = ((0, 1, 2, 4, 5, 7, 8, 10), (0, 1, 3, 4, 6, 7, 10, 11))
RUN = 12
#: Different seeds of the items up to which they are handed to every task (8 bytes each).
SEEDS = 2_000_000
#: Soft hyphen, zero-width characters, word joiner, byte order mark.
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
TAG = r"</?[A-Za-z][^<>]*>|<!--.*?-->"


def plain_words(c: Column) -> Column:
    """Words as they are compared: without tags and invisible characters, escapes read, lower case."""
    text = html_unescape(F.regexp_replace(c, TAG, " "))
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, INVISIBLE, "")), F.lit(WORD), F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seed_hashes(words: pd.Series) -> list[list[np.ndarray]]:
    """Of each list of word hashes, for each mask the hashes of all its windows, by position; [] for short or null lists."""
    lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in words]
    ends = np.cumsum([len(x) for x in lists])
    flat = np.concatenate(lists).view(np.uint64) if lists else np.zeros(0, np.uint64)
    out: list[list] = [[] for _ in lists]
    with np.errstate(over="ignore"):
        for m, mask in enumerate(MASKS):
            span = mask[-1] + 1
            size = max(0, len(flat) - span + 1)
            h = np.full(size, np.uint64(m + 1))
            for p in mask:
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[p : p + size])
            h = h.view(np.int64)
            for k, (x, end) in enumerate(zip(lists, ends)):
                out[k].append(h[end - len(x) : end - span + 1] if len(x) >= span else h[:0])
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def seeds(words: pd.Series) -> pd.Series:
    return pd.Series(seed_hashes(words))


def seed_rows(texts: DataFrame, key: str, place: str) -> DataFrame:
    """``(key, place, seed)`` of every window and mask; texts: ``(key, words array<long>)``."""
    by_mask = texts.select(key, F.explode(seeds("words")).alias("hashes"))
    return by_mask.select(key, F.posexplode("hashes").alias(place, "seed"))


def with_hits(corpus: DataFrame, sought: DataFrame) -> DataFrame:
    """``(doc_id, words, doc_at, seed)`` of the texts that have a seed of the items, with the places of those seeds; written once."""
    spark = corpus.sparkSession
    distinct = sought.select("seed").distinct()
    if distinct.limit(SEEDS + 1).count() > SEEDS:
        hits = seed_rows(corpus, "doc_id", "doc_at").join(distinct, "seed", "left_semi")
        hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("doc_at", "seed")).alias("h"))
        return written(corpus.join(hits, "doc_id").select("doc_id", "words", F.col("h.doc_at").alias("doc_at"), F.col("h.seed").alias("seed")))
    known = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["seed"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, by_mask in enumerate(seed_hashes(pdf["words"])):
                places, values = [], []
                for h in by_mask:
                    k = np.flatnonzero(known.value[np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)] == h) if len(known.value) else []
                    places.extend(k)
                    values.extend(h[k] if len(k) else [])
                if places:
                    rows.append((pdf["doc_id"].iat[at], pdf["words"].iat[at], places, values))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "doc_at", "seed"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    return written(corpus.mapInPandas(run, f"doc_id {kind}, words array<long>, doc_at array<int>, seed array<long>"))


def leaked_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, run, matched, span)`` of documents and items that overlap around a common seed.

    ``run`` is the longest passage of equal successive words; ``matched`` of ``span`` words are equal between the first
    and the last equal word of the best alignment, substitutions in between. Null, empty and short texts have none;
    repeated rows count once. Every document and position is looked at, however long the text.
    """
    hashed = F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w))
    tests = written(items.filter("item_id is not null").select("item_id", hashed.alias("words")))
    sought = written(seed_rows(tests, "item_id", "item_at").distinct())
    corpus = with_hits(docs.select("doc_id", hashed.alias("words")), sought)
    hits = corpus.select("doc_id", F.explode(F.arrays_zip("doc_at", "seed")).alias("h")).select("doc_id", "h.*")
    lines = hits.join(small(sought), "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    sides = corpus.select("doc_id", "words").join(lines, "doc_id").join(small(tests.withColumnRenamed("words", "item_words")), "item_id")
    begin = F.greatest(F.col("shift"), F.lit(0))
    length = F.least(F.size("words") - begin, F.size("item_words") - (begin - F.col("shift")))
    same = F.zip_with(F.slice("words", begin + 1, length), F.slice("item_words", begin - F.col("shift") + 1, length), lambda x, y: x == y)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("run"), F.lit(0).alias("matched"))

    def step(acc: Column, equal: Column) -> Column:
        now = F.when(equal, acc["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["run"], now).alias("run"), (acc["matched"] + equal.cast("int")).alias("matched"))

    found = sides.select("doc_id", "item_id", same.alias("same")).select(
        "doc_id", "item_id", F.aggregate("same", start, step).alias("a"),
        (F.size("same") - F.array_position(F.reverse("same"), F.lit(True)) - F.array_position("same", F.lit(True)) + 2).cast("int").alias("span"),
    )
    best = F.max(F.struct("a.run", "a.matched", "span")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def p8_found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaked_passages(docs, items).filter(F.col("run") >= RUN).select("doc_id", "item_id")
