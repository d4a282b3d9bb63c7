"""What changed between full snapshots, by invertible Bloom lookup tables.

Each snapshot's rows are put, per hash bucket, into a small table of cells. Subtracting the tables of two successive
snapshots leaves only what differs; peeling cells that hold a single element recovers the differing (key, state)
hashes. Buckets whose table doesn't peel, or whose digest doesn't agree with what was recovered, get larger tables.
Keys are 128 bits wide, so that keys of different records don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import fold, time_key
from almanac.operators.captures import capture_order, latest_rows
from almanac.operators.merkle_history import state_hash
from almanac.session import materialize, small, written

KEYS_PER_BUCKET = 128
CELLS = 24
GROWTH = 4
HASHES = 3
CHECK, DIGEST, PLACE = 101, 202, 303

# Fixed values of the public 64-bit xxHash.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs(*columns: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's ``xxhash64`` of bigint columns."""
    h = np.full(len(columns[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.asarray(c).astype(np.int64).view(np.uint64)
            h = h + P5 + np.uint64(8)
            h = h ^ (_rotl(x * P2, 31) * P1)
            h = _rotl(h, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _hash(salt: int, k1: np.ndarray, k2: np.ndarray, h: np.ndarray) -> np.ndarray:
    return xxhash64_longs(k1, k2, h, np.full(len(k1), salt, np.int64))


def difference_tables(rows: DataFrame, cells: int, seed: int, wanted: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """``(bucket, pair, cells)``: the subtracted table of each bucket and pair of snapshots, as its cells that aren't zero.

    rows: ``(bucket, ord, k1, k2, h)``. Without ``wanted``, tables are built once per snapshot and then subtracted;
    with it, ``(bucket, pair)``, only for those. The cell with number ``cells`` is the digest.
    """
    part = cells // HASHES
    places = [F.pmod(F.xxhash64("k1", "k2", "h", F.lit(PLACE + seed * HASHES + i).cast("long")), F.lit(part)).cast("int") + i * part for i in range(HASHES)]
    check = F.xxhash64("k1", "k2", "h", F.lit(CHECK).cast("long"))
    digest = F.xxhash64("k1", "k2", "h", F.lit(DIGEST).cast("long"))
    spread = F.explode(F.array(*places, F.lit(cells))).alias("cell")
    fields = [F.bit_xor(c).alias(c) for c in ("k1", "k2", "h", "c")]
    if wanted is None:
        entered = rows.repartition("bucket").select("bucket", "ord", "k1", "k2", "h", check.alias("chk"), digest.alias("dig"), spread)
        entered = entered.withColumn("c", F.when(F.col("cell") == cells, F.col("dig")).otherwise(F.col("chk")))
        own = entered.groupBy("bucket", "ord", "cell").agg(F.count("*").alias("n"), *fields)
        both = own.select("bucket", "cell", "k1", "k2", "h", "c", F.explode(F.array(F.struct(F.col("ord").alias("pair"), F.col("n").alias("n")), F.struct((F.col("ord") + 1).alias("pair"), (-F.col("n")).alias("n")))).alias("s")).select("bucket", "cell", "k1", "k2", "h", "c", "s.*").filter(F.col("pair").between(1, last))
    else:
        sides = rows.select("*", F.explode(F.array(F.struct(F.col("ord").alias("pair"), F.lit(1).cast("long").alias("n")), F.struct((F.col("ord") + 1).alias("pair"), F.lit(-1).cast("long").alias("n")))).alias("s")).select("bucket", "k1", "k2", "h", "s.*")
        both = sides.join(wanted, ["bucket", "pair"], "left_semi").repartition("bucket").select("*", check.alias("chk"), digest.alias("dig"), spread)
        both = both.withColumn("c", F.when(F.col("cell") == cells, F.col("dig")).otherwise(F.col("chk")))
    left = both.groupBy("bucket", "pair", "cell").agg(F.sum("n").cast("int").alias("n"), *fields)
    left = left.filter("n <> 0 or k1 <> 0 or k2 <> 0 or h <> 0 or c <> 0")
    return left.groupBy("bucket", "pair").agg(F.collect_list(F.struct("cell", "n", "k1", "k2", "h", "c")).alias("cells"))


def peeler(cells: int, seed: int):
    """A function over batches of subtracted tables that peels all tables of a batch together.

    It gives one row per recovered element, ``sign`` 1 if it is only in the later snapshot and -1 if only in the
    earlier, and a row with ``sign`` 0 for a table that failed: not emptied, or with another digest than its elements.
    """
    part = cells // HASHES

    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tables = len(pdf)
            n = np.zeros(tables * (cells + 1), np.int64)
            f = {c: np.zeros(tables * (cells + 1), np.int64) for c in ("k1", "k2", "h", "c")}
            filled = [(t, x) for t, xs in enumerate(pdf["cells"]) for x in xs]
            if filled:
                at = np.array([t * (cells + 1) + x["cell"] for t, x in filled])
                n[at] = [x["n"] for _, x in filled]
                for c in f:
                    f[c][at] = [x[c] for _, x in filled]
            ends = np.arange(tables) * (cells + 1) + cells
            digest = f["c"][ends].copy()
            n[ends] = 0
            for c in f:
                f[c][ends] = 0
            taken: list[tuple] = []
            touched = np.flatnonzero(np.abs(n) == 1)
            for _ in range(10_000):
                pure = touched[np.abs(n[touched]) == 1]
                pure = pure[f["c"][pure] == _hash(CHECK, f["k1"][pure], f["k2"][pure], f["h"][pure])]
                if not len(pure):
                    break
                table = pure // (cells + 1)
                found = np.unique(np.stack([table, f["k1"][pure], f["k2"][pure], f["h"][pure], n[pure]]), axis=1)
                table, k1, k2, h, sign = found
                check = _hash(CHECK, k1, k2, h)
                np.bitwise_xor.at(digest, table, _hash(DIGEST, k1, k2, h))
                taken.append((table, k1, k2, h, sign))
                touched = []
                for i in range(HASHES):
                    place = np.mod(_hash(PLACE + seed * HASHES + i, k1, k2, h), part) + i * part + table * (cells + 1)
                    np.subtract.at(n, place, sign)
                    for c, v in (("k1", k1), ("k2", k2), ("h", h), ("c", check)):
                        np.bitwise_xor.at(f[c], place, v)
                    touched.append(place)
                touched = np.unique(np.concatenate(touched))
            rest = (n.reshape(tables, -1) != 0).any(axis=1) | (digest != 0)
            for c in f:
                rest |= (f[c].reshape(tables, -1) != 0).any(axis=1)
            table, k1, k2, h, sign = (np.concatenate(x) for x in zip(*taken)) if taken else (np.zeros(0, np.int64),) * 5
            good = ~rest[table]
            bad = np.flatnonzero(rest)
            zero = np.zeros(len(bad), np.int64)
            table = np.concatenate([table[good], bad])
            yield pd.DataFrame({"bucket": pdf["bucket"].to_numpy()[table], "pair": pdf["pair"].to_numpy()[table], "k1": np.concatenate([k1[good], zero]), "k2": np.concatenate([k2[good], zero]), "h": np.concatenate([h[good], zero]), "sign": np.concatenate([sign[good], zero]).astype(np.int32)})

    return peel


def recovered_elements(rows: DataFrame, last: int, cells: int = CELLS) -> DataFrame:
    """``(bucket, pair, k1, k2, sign)`` of every element that is in one of two successive snapshots only.

    Rounds go on, with tables GROWTH times as large and other hash functions, until no table fails.
    """
    done, wanted = [], None
    seed = 0
    while True:
        tables = difference_tables(rows, cells, seed, wanted, last)
        found = materialize(tables.mapInPandas(peeler(cells, seed), "bucket long, pair int, k1 long, k2 long, h long, sign int"))
        done.append(found.filter("sign <> 0"))
        wanted = found.filter("sign = 0").select("bucket", "pair")
        if wanted.isEmpty():
            break
        cells, seed = cells * GROWTH, seed + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def changes_between(rows: DataFrame, last: int) -> DataFrame:
    """``(key, pair, change)`` of rows ``(key, ord, h)``, one per key and ord: added, removed or changed from ord pair - 1 to pair."""
    keys = rows.agg(F.approx_count_distinct("key")).first()[0]
    buckets = 1 << max(0, math.ceil(math.log2(max(1, keys / KEYS_PER_BUCKET))))
    k1, k2 = F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit(1)).alias("k2")
    bucket = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(buckets)).alias("bucket")
    hashed = rows.select(bucket, "ord", k1, k2, "h")
    kinds = recovered_elements(hashed, last).groupBy("pair", "k1", "k2").agg(F.max("sign").alias("up"), F.min("sign").alias("down"))
    change = F.when(F.col("up") == F.col("down"), F.when(F.col("up") > 0, "added").otherwise("removed")).otherwise("changed")
    names = rows.select("key").distinct().select("key", k1, k2)
    return kinds.join(names, ["k1", "k2"]).select("key", "pair", change.alias("change"))


def session_changes(facts: DataFrame, index: DataFrame) -> DataFrame:
    """``(prev_index, cur_index, session_id, change)`` between each capture and the one before it.

    ``changed`` means another title, room or start time, titles and rooms compared folded, start times as the time of
    day; blank is null and null differs from a value. The first capture adds nothing; empty input gives no rows.
    """
    order = capture_order(index, facts)
    last = order.agg(F.max("ord")).first()[0] or 0
    latest = latest_rows(facts, order, title=F.col("title"), room=F.col("room"), start=F.col("start_time_text"))
    compared = latest.select("session_id", "ord", fold(F.col("title")).alias("title"), fold(F.col("room")).alias("room"), time_key(F.col("start")).alias("start"))
    rows = written(compared.select(F.col("session_id").alias("key"), "ord", state_hash("title", "room", "start").alias("h")))
    found = changes_between(rows, last)
    cur = small(order.select(F.col("ord").alias("pair"), F.col("order_index").cast("int").alias("cur_index")))
    prev = small(order.select((F.col("ord") + 1).alias("pair"), F.col("order_index").cast("int").alias("prev_index")))
    return found.join(cur, "pair").join(prev, "pair").select("prev_index", "cur_index", F.col("key").alias("session_id"), "change")
