"""The numbered problems of the core on small made-up captures: dirt, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import datetime
import html
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators.iblt_diff import changes_between, peeler, recovered_elements, session_changes, xxhash64_longs
from almanac.operators.merkle_history import appended_history, p1_found, session_history, tree_depth

INDEX = "order_index int, file_name string, snapshot_ts timestamp"
FACTS = "order_index int, session_id string, title string, remaining_capacity int, registrant_count int, room string, start_time_text string, loaded_at timestamp, leaf string, ord string, key string, h string, bucket string"
T0 = datetime.datetime(2027, 3, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def frames(spark, index, facts):
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(index, INDEX)


def row(o, s, seats=1, regs=1, room="A", title="t", start="9:00 AM", loaded=0):
    return (o, s, title, seats, regs, room, start, at(loaded), "clash", "clash", "clash", "clash", "clash")


def white(s):
    return " ".join(s.split())


def fold(s):
    return None if s is None else (white(html.unescape(s).lower()) or None)


def brute(index, facts):
    order = [o for o, _, t in sorted(index, key=lambda x: (x[2], x[0])) if any(f[0] == o for f in facts)]
    best = {}
    for f in facts:
        s = (f[1] or "").strip()
        if s and f[0] in order and ((s, f[0]) not in best or best[s, f[0]][7] < f[7]):
            best[s, f[0]] = f
    states, changes = set(), set()
    for s in {k[0] for k in best}:
        known, run, prev = [None] * 3, None, None
        for o in order:
            f = best.get((s, o))
            if f is None:
                if run:
                    states.add((s, *run))
                run = prev = None
                continue
            known = [n if n is not None else k for n, k in zip((f[3], f[4], fold(f[5])), known)]
            if prev == known:
                run[1] = o
            else:
                if run:
                    states.add((s, *run))
                run = [o, o]
            prev = list(known)
        if run:
            states.add((s, *run))
        for a, b in zip(order, order[1:]):
            p, c = best.get((s, a)), best.get((s, b))
            if p is None and c is not None:
                changes.add((a, b, s, "added"))
            elif p is not None and c is None:
                changes.add((a, b, s, "removed"))
            elif p is not None and (fold(p[2]), fold(p[5]), p[6]) != (fold(c[2]), fold(c[5]), c[6]):
                changes.add((a, b, s, "changed"))
    return states, changes


@pytest.mark.parametrize("seed", [1, 2])
def test_random_captures(spark, seed):
    rng = random.Random(seed)
    index = [(k, f"f{k:02}", at(rng.randrange(100) if k % 4 == 0 else 10 * k)) for k in range(9)]
    facts = []
    for k in range(9):
        for s in range(60):
            if k != 5 and rng.random() < 0.8:
                for _ in range(1 + (rng.random() < 0.2)):
                    sid = rng.choice([f"{s}", f" {s}\t", f"{s} "])
                    facts.append(row(k, sid, rng.choice([None, 1, 2]), rng.choice([None, 5]), rng.choice(["A &amp; B", "a & b", " A & B ", "C", None, " "]), rng.choice(["x", "X ", "y&#39;s", "y's"]), loaded=rng.randrange(10**6)))
    facts += [row(3, None), row(3, "  "), row(99, "1")]
    f, i = frames(spark, index, facts)
    states, changes = brute(index, facts)
    got = p1_found(f, i).collect()
    assert {tuple(r) for r in got} == states and len(got) == len(states)
    got = session_changes(f, i).collect()
    assert {tuple(r) for r in got} == changes and len(got) == len(changes)


def test_values_of_history(spark):
    index = [(0, "a", at(0)), (1, "b", at(1)), (2, "c", at(2)), (3, "d", at(3))]
    facts = [row(0, "7", 5, 1, "A"), row(1, "7", None, 1, None), row(3, "7", 4, 1, "B"), row(2, "8"), row(2, "8")]
    f, i = frames(spark, index, facts)
    got = {tuple(r) for r in session_history(f, i).collect()}
    assert got == {("7", 0, 1, 5, 1, "a"), ("7", 3, 3, 4, 1, "b"), ("8", 2, 2, 1, 1, "a")}


@pytest.mark.parametrize("appended", [1, 3, 99])
def test_appending_captures_gives_the_same_history(spark, appended):
    rng = random.Random(7)
    index = [(k, f"f{k:02}", at(10 * k)) for k in range(6)]
    facts = [row(k, f"{s}", rng.choice([None, 1, 2]), rng.choice([None, 5]), rng.choice(["A", "a ", "C", None])) for k in range(6) for s in range(40) if rng.random() < 0.8]
    f, i = frames(spark, index, facts)
    want = sorted(map(str, session_history(f, i).collect()))
    assert sorted(map(str, appended_history(f, i, appended).collect())) == want and len(want) > 20
    assert appended_history(f.limit(0), i, appended).count() == 0


def test_empty_and_null(spark):
    f, i = frames(spark, [], [])
    assert p1_found(f, i).count() == 0 and session_changes(f, i).count() == 0
    nulls = [(None,) * 13, (0, "5") + (None,) * 11, (None, "5") + (None,) * 11]
    f, i = frames(spark, [(0, None, None), (None, None, None), (1, "b", None)], nulls)
    assert [tuple(r) for r in p1_found(f, i).collect()] == [("5", 0, 0)]
    assert session_changes(f, i).count() == 0


def test_one_capture_holds_almost_all_changes(spark):
    """Tables that are too small for a pair are enlarged until they peel: an empty bucket against a full one."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.explode(F.array(F.lit(0), F.lit(2))).alias("ord"), F.lit(1).cast("long").alias("h"))
    rows = rows.unionByName(spark.createDataFrame([("x", 1, 1)], "key string, ord int, h long"))
    got = {(r["pair"], r["change"]): r["count"] for r in changes_between(rows, 2).groupBy("pair", "change").count().collect()}
    assert got == {(1, "removed"): 3000, (1, "added"): 1, (2, "added"): 3000, (2, "removed"): 1}


def test_hash_is_that_of_spark(spark):
    rows = spark.range(50).select("id", (F.col("id") * -981234567891).alias("b"))
    want = [r[0] for r in rows.select(F.xxhash64("id", "b")).collect()]
    a = np.arange(50)
    assert list(xxhash64_longs(a, a * -981234567891)) == want


def test_table_that_does_not_peel_is_reported():
    import pandas as pd

    cells = [{"cell": 0, "n": 2, "k1": 5, "k2": 6, "h": 7, "c": 8}]
    out = next(peeler(24, 0)(iter([pd.DataFrame({"bucket": [3], "pair": [1], "cells": [cells]})])))
    assert out[["bucket", "pair", "sign"]].values.tolist() == [[3, 1, 0]]


def test_depth_grows_with_keys():
    assert [tree_depth(k) for k in (0, 30, 600, 100_000, 10**9)] == [1, 1, 2, 3, 7]


def test_no_change_gives_nothing(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("k1"), F.col("id").alias("k2"), F.lit(9).cast("long").alias("h"), F.lit(0).cast("long").alias("bucket"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    assert recovered_elements(rows, 1).count() == 0
