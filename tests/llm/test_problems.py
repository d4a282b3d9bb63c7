"""The operators of the subpackage on small made-up tables, against brute force, with dirt, ties, repeats and empty tables."""

from __future__ import annotations

import html
import os
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from almanac.llm import clusters, leakage, residue, set_similarity, spellings, term_frequency, tokenize

CLASH = "tree string, prefix string, words string, bucket string, hash string, kind string, main string"
BLANK = ("x",) * 7
DOCS = f"doc_id long, text string, {CLASH}"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, *BLANK) for k, t in enumerate(texts)], DOCS)


# Tokenizer ------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "Hello world's  end\n\n", "日本語 と emoji 👩‍💻", "x" * 3000, "a" * 40 + " " * 50 + "b", "<|endoftext|> ⁇ ▁", "été ́ ​﻿", "tab\tand\r\nline", "I'LL we'll 123 4567"]


@pytest.fixture(scope="module")
def codec():
    path = os.path.join(tokenize.TOKENIZERS, tokenize.VOCABULARY)
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    return tokenize.Codec(tokenize.bpe_model(tokenize.read_ranks(path)))


def test_ids_equal_the_public_encoder(spark, codec):
    import tiktoken

    ranks = tokenize.read_ranks(os.path.join(tokenize.TOKENIZERS, tokenize.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_texts(docs(spark, TEXTS)).collect()}
    assert got == {k: own.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    assert [codec.decode(got[k]) for k in got] == [TEXTS[k] or "" for k in got]


def test_decoding_a_table(spark, codec):
    encoded = tokenize.encode_texts(docs(spark, TEXTS)).withColumn("text", F.lit("x"))
    got = {r["doc_id"]: r["text"] for r in tokenize.decode_ids(encoded).collect()}
    assert got == {k: t or "" for k, t in enumerate(TEXTS)}
    assert tokenize.decode_ids(encoded.withColumn("ids", F.lit(None).cast("array<int>")).limit(1)).first()["text"] == ""
    assert tokenize.decode_ids(encoded.limit(0)).count() == 0


def test_random_texts_round_trip(codec):
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3040, 0x30FF), 0x1F600])) for _ in range(rng.randrange(60)))
        assert codec.decode(codec.encode(t)) == t


def test_no_texts(spark):
    assert tokenize.encode_texts(docs(spark, ["a"]).limit(0)).count() == 0


def test_gaps_in_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300}
    assert tokenize.Codec(tokenize.bpe_model(ranks)).encode("abc") == [300, 99]


# Terms ----------------------------------------------------------------------------------------------------------------

SESSION = f"id string, title string, description string, topics array<string>, {CLASH}"


def sessions(spark, rows):
    return spark.createDataFrame([(*r, *BLANK) for r in rows], SESSION)


def test_terms_equal_brute_force(spark):
    rng = random.Random(1)
    pool = ["alpha", "Beta", "café", "x1", "東京", "R&amp;D", "a-b", "&#39;", "the"]
    rows = [(str(k), rng.choice([None, "", " ".join(rng.choices(pool, k=5))]), "the " + " ".join(rng.choices(pool, k=8)), None) for k in range(120)]
    rows += rows[:10] + [(None, "lost words", None, None), ("z", "solo " * 500, None, None)]
    once = {r[0]: f"{r[1] or ''} {r[2] or ''}" for r in rows if r[0] is not None}
    tf, df = {}, {}
    for t in once.values():
        found = regex.findall(r"[\p{L}\p{N}]+", html.unescape(t).lower())
        for w in found:
            tf[w] = tf.get(w, 0) + 1
        for w in set(found):
            df[w] = df.get(w, 0) + 1
    got = {r["term"]: r for r in term_frequency.session_terms(sessions(spark, rows)).collect()}
    assert {w: (r["tf"], r["df"]) for w, r in got.items()} == {w: (tf[w], df[w]) for w in tf}
    assert {w: r["mark"] for w, r in got.items()} == {w: "rare" if df[w] <= 2 else "common" if df[w] * 5 > len(once) else None for w in tf}
    assert term_frequency.p5_found(sessions(spark, rows).limit(0)).count() == 0


def test_oversized_partitions_are_split(spark):
    words = spark.range(4000).select(F.array(F.concat(F.lit("w"), (F.col("id") % 1500).cast("string")), F.lit("everywhere")).alias("words"))
    got = {r["term"]: (r["tf"], r["df"]) for r in term_frequency.term_frequency(words, limit=20).collect()}
    assert len(got) == 1501 and got["everywhere"] == (4000, 4000) and sum(v[0] for v in got.values()) == 8000
    hashed = spark.range(1000).select(F.xxhash64("id").alias("hash")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("hash")))
    leaves = term_frequency.radix_leaves(hashed, 100).collect()
    assert len({r["bits"] for r in leaves}) > 1 and (term_frequency.MAX_BITS, 0, 500) in {tuple(r) for r in leaves}
    assert all(r["n"] <= 100 for r in leaves if r["bits"] < term_frequency.MAX_BITS) and sum(r["n"] for r in leaves) == 1500


def test_duckdb_gets_one_leaf_at_a_time(spark):
    words = spark.range(6000).repartition(12).select(F.array(F.concat(F.lit("w"), (F.col("id") % 900).cast("string")), F.lit("everywhere")).alias("words"))
    rows = term_frequency.summed_leaves(words, limit=50).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault(r["leaf"], []).append(r)
    assert sorted(leaves) == list(range(len(leaves))) and len(leaves) > 100
    assert all(sum(r["n"] for r in rs) <= 50 or len(rs) == 1 for rs in leaves.values())
    assert len(rows) == 901 and sum(r["n"] for r in rows) > 901


# Sets -----------------------------------------------------------------------------------------------------------------


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows, hot = [], [f"topic {k}" for k in range(6)]
    for k in range(300):
        base = hot if k % 3 == 0 else [f"t{(k // 4) * 7 + j}" for j in range(7)]
        own = [x for x in base if rng.random() < 0.93] + ["common"] * (rng.random() < 0.5)
        rows.append((str(k), None, None, [rng.choice([x, x.upper(), f" {x} ", x.replace(" ", "  ")]) for x in own] + [None, " "]))
    rows += [("dup", None, None, ["a|b|c", "d"]), ("dup2", None, None, ["A", "b", "c ", "D", "d"]), ("n", None, None, None), ("e", None, None, []), (None, None, None, ["a", "b", "c", "d"])] + rows[:5]
    want, sets = set(), {}
    for i, _, _, t in rows:
        if i is not None:
            sets[i] = {" ".join(y.lower().split()) for x in t or [] if x for y in x.split("|")} - {""}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n >= 4 and n >= 0.6 * len(sets[a] | sets[b]) - 1e-9:
                want.add((a, b))
    got = [tuple(r) for r in set_similarity.topic_pairs(sessions(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("dup", "dup2") in want
    links = {r["id"]: r for r in set_similarity.topic_links(sessions(spark, rows)).collect()}
    assert {i for i in sets if len(sets[i]) >= 4} == set(links)
    assert all(links[i]["links"] == sum(i in p for p in want) and links[i]["copies"] == sum(sets[i] == sets[j] for j in sets) - 1 for i in links)
    for none in (set_similarity.topic_pairs, set_similarity.topic_links):
        assert none(sessions(spark, rows).limit(0)).count() == 0


def tight_pairs(n):
    rows = []
    for k in range(n):
        both = [f"t{k} {j}" for j in range(6)]
        rows += [(f"{k}a", both + [f"a{k} {j}" for j in range(2)]), (f"{k}b", both + [f"b{k} {j}" for j in range(2)])]
    return rows, sorted((f"{k}a", f"{k}b") for k in range(n))


def test_pairs_at_the_threshold_are_found(spark):
    rows, want = tight_pairs(800)
    got = set_similarity.similar_sets(spark.createDataFrame(rows, "set_id string, items array<string>"), 0.6, 4).collect()
    assert sorted(map(tuple, got)) == want


def test_crowded_neighbourhoods_keep_the_recall(spark):
    """Pairs at the threshold among 1500 sets that all share five frequent elements, so every prefix is crowded at first."""
    core = [f"hot {j}" for j in range(5)]
    rows, want = [], []
    for k in range(750):
        both = [f"t{k} {j}" for j in range(4)]
        rows += [(f"{k}a", core + both + [f"a{k} {j}" for j in range(3)]), (f"{k}b", core + both + [f"b{k} {j}" for j in range(3)])]
        want.append((f"{k}a", f"{k}b"))
    sets = spark.createDataFrame(rows, "set_id string, items array<string>")
    got = [tuple(r) for r in set_similarity.similar_sets(sets, 0.6, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)


def test_crowded_beginnings_are_parted(spark, monkeypatch):
    monkeypatch.setattr(set_similarity, "SPLIT", 1)  # every beginning that sets share is parted by its next places
    rows = [(k, 0, [7, k % 2, k % 3, k, 0, 0]) for k in range(30)] + [(99, 1, [7, 0, 0, 0, 0, 0])]
    got = set_similarity.placed(spark.createDataFrame(rows, "set_id long, tree int, sig array<int>"), 31).collect()
    assert {r["begin"] for r in got if r["tree"] == 0} == {4} and [r["begin"] for r in got if r["tree"] == 1] == [1]
    assert len({r["place"] for r in got}) == 31


def test_neighbourhoods_are_deepened(monkeypatch):
    monkeypatch.setattr(set_similarity, "NODE", 3)
    sig = np.array([[1, 1, 1, 0, 0, 0], [1, 1, 2, 0, 0, 0], [1, 2, 1, 0, 0, 0], [1, 2, 1, 0, 0, 0], [2, 1, 1, 0, 0, 0], [2, 1, 2, 0, 0, 0], *[[3, 3, 3, 3, 3, 3]] * 5], np.int32)
    place = sig[:, 0].astype(np.int64)
    depth, node, size = set_similarity.neighbourhoods(place, sig, np.ones(11, np.int32))
    assert depth.tolist() == [2, 2, 2, 2, 1, 1] + [6] * 5 and size.tolist() == [2, 2, 2, 2, 2, 2] + [5] * 5
    assert len(set(node)) == 4 and node[0] == node[1] != node[2] == node[3]
    deeper = set_similarity.neighbourhoods(place, sig, np.full(11, 3, np.int32))[0]
    assert deeper.tolist() == [3] * 6 + [6] * 5


def test_trees_keep_the_recall():
    assert [set_similarity.trees_needed(0.6, d) for d in (1, 2, 3)] == [11, 21, 38]
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**62), 2**62, size=(2000, 10))
    b = a.copy()
    b[:, 7:] = rng.integers(-(2**62), 2**62, size=(2000, 3))  # 7 of 13 in common
    same = sum((set_similarity.signatures(list(a), t)[:, :2] == set_similarity.signatures(list(b), t)[:, :2]).all(axis=1).mean() for t in range(10)) / 10
    assert abs(same - (7 / 13) ** 2) < 0.02


# Clusters -------------------------------------------------------------------------------------------------------------

VECTORS = f"row_id long, embedding array<double>, labels struct<theme: string, ai_focus: string, audience: string>, {CLASH}"


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CHUNK", 60)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    rows, size, k = [], [150, 30, 2, 2, 3, 5, 2, 2] + [1] * 200, 0
    want = {}
    data, ops = ("Data", "AI", ""), ("Ops", None, None)
    for n in size:
        center = rng.normal(size=64)
        center /= np.linalg.norm(center)
        first = k
        for _ in range(n):
            x = (center + rng.normal(size=64) * 0.035) * rng.uniform(0.2, 5)
            rows.append((k, [float(v) for v in x], data, *BLANK))
            if n > 1:
                want[k] = first
            k += 1
    same = rows[0][1]
    rows += [(k + j, same, ops, *BLANK) for j in range(100)] + rows[:7]
    want |= {k + j: 0 for j in range(100)}
    rows += [(9001, None, None, *BLANK), (9002, [], None, *BLANK), (9003, [1.0] * 63, None, *BLANK), (9004, [0.0] * 64, None, *BLANK), (None, same, None, *BLANK), (9005, [float("nan")] * 64, None, *BLANK)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r[0] if r[0] is None else int(r[0]), *r[1:]) for r in rows], VECTORS)
    got = clusters.session_clusters(df).collect()
    assert {r["row_id"]: r["cluster_id"] for r in got} == want and len(got) == len(want)
    profile = {r["cluster_id"]: r for r in clusters.cluster_profiles(df).collect()}
    assert tuple(profile[0])[1:] == (250, "Data", 150, "AI", 150, None, 0) and profile[150]["size"] == 30
    for none in (clusters.session_clusters, clusters.cluster_profiles, clusters.typical_members):
        assert none(df.limit(0)).count() == 0


def test_typical_members_are_the_densest(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in range(3):
        center = rng.normal(size=64)
        rows += [(c * 100 + j, [float(v) for v in center + rng.normal(size=64) * (0.02 if j in (7, 13) else 0.3)], None, *BLANK) for j in range(40)]
    top = clusters.typical_members(spark.createDataFrame(rows, VECTORS), 2).collect()
    assert {(r["cluster_id"], r["row_id"]) for r in top} == {(c * 100, c * 100 + j) for c in range(3) for j in (7, 13)}
    assert sorted(r["place"] for r in top) == [1, 1, 1, 2, 2, 2]


class Shared:
    def __init__(self, value):
        self.value = value


def block_of(groups, seed=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(len(groups), 64))
    u = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(n, 64)) * 0.03 for c, n in zip(centers, groups)])
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    return u, clusters.pd.DataFrame({"id": np.arange(len(u)), "u": [x.tobytes() for x in u]})


def test_the_mixture_decides(monkeypatch):
    """With a mixture of one component nothing but that component's neighbourhood is left."""
    u, pdf = block_of([5, 8, 13, 2, 1, 1, 1])
    run = clusters._grouped(64, Shared(u.mean(axis=0)), Shared(np.eye(64, dtype=np.float32)), 1.0)
    want = [(k, 5 * (k >= 5) + 8 * (k >= 13) + 13 * (k >= 26)) for k in range(28)]
    groups = {}
    for i, h in run(pdf).itertuples(index=False):
        groups.setdefault(h, {h}).add(i)
    assert sorted(map(min, groups.values())) == sorted({g for _, g in want}) and sum(map(len, groups.values())) == 28
    monkeypatch.setattr(clusters, "fit_mixture", lambda x, means, floor: (0.0, np.zeros(len(x), np.int64), np.zeros(len(x))))
    assert len(run(pdf)) < 28 - 4


def test_criterion_splits_two_groups():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(20, 8)) * 0.1, rng.normal(size=(20, 8)) * 0.1 + 2])
    one = clusters.fit_mixture(x, x.mean(axis=0, keepdims=True), 0.01)[0]
    two, own, _ = clusters.fit_mixture(x, x[[0, 30]], 0.01)
    assert two < one and len(set(own[:20])) == 1 and own[0] != own[-1]


def test_covariances_follow_the_rows():
    """A component that is wide along one feature keeps rows far along it, which one of equal variances would lose."""
    rng = np.random.default_rng(8)
    wide = rng.normal(size=(300, 4)) * [2.0, 0.1, 0.1, 0.1]
    tight = rng.normal(size=(60, 4)) * 0.1 + [0, 1.2, 0, 0]
    x = np.concatenate([wide, tight])
    own = clusters.fit_mixture(x, np.array([[0.0, 0, 0, 0], [0, 1.2, 0, 0]]), 0.01)[1]
    assert (own[:300] == own[0]).mean() > 0.99 and (own[300:] == own[320]).all()


def test_rows_at_the_bound_meet():
    for axes in ((4, 0), (64, 0), (64, 4)):
        p = clusters.meeting_chance(64, axes, clusters.SIMILARITY)
        assert 0.03 < p < 0.95
    assert clusters.buckets_of((64, 4)) == 1024


# Spellings ------------------------------------------------------------------------------------------------------------

PEOPLE = f"code string, speakers array<struct<name: string, role: string, company: string, affiliation: string>>, {CLASH}"


def test_spellings(spark):
    companies = [["Vokarelu Systems", "vokarelu systems", "Vokarelu Systems, Inc.", "Systems, Vokarelu", "Vokaerlu Systems", "Vokarelu Sys.", "The Vokarelu Systems", "Vokarelu Systems (VS)", "Voka relu Systems", "Vokárelu Systems"], ["Vokarelu Health", "Vokarelu Healthcare"], ["Mirunabo Bank", "Mirunabo", "Mirunabo Bnk"], ["Pasodi Labs", "Pasodi Laboratories"]]
    names = [["Robert Velanuzo", "Bob Velanuzo", "Dr. Robert Velanuzo, PhD", "Velanuzo, Robert", "Velanuzo Robert", "Robert T. Velanuzo", "Robert Velanzuo", "R. Velanuzo"], ["Ingrid Velanuzo", "I. Velanuzo"], ["Hamid Torukasi"], ["Henrik Torukasi"], ["H. Torukasi"]]
    rows = [(f"c{k}", [(None, None, s, None)], *BLANK) for k, s in enumerate(sum(companies, []))] + [(f"n{k}", [(f" {s} ", None, "Independent", None)], *BLANK) for k, s in enumerate(sum(names, []))]
    rows += rows[:4] + [("x", None, *BLANK), ("y", [], *BLANK), ("z", [("", None, " ", None), ("TBA", None, None, None), ("Speaker TBA", "r", "n/a", None)], *BLANK)]
    want = {(kind, *sorted((a, b))) for kind, groups in (("company", companies), ("name", names)) for g in groups for a in g for b in g if a != b}
    got = [tuple(r) for r in spellings.p6_found(spark.createDataFrame(rows, PEOPLE)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert spellings.p6_found(spark.createDataFrame(rows, PEOPLE).limit(0)).count() == 0


def linked(spark, companies=(), names=()):
    """The pairs found of these spellings, each of them alone in a row."""
    rows = [(f"c{k}", [(None, None, x, None)], *BLANK) for k, x in enumerate(companies)] + [(f"n{k}", [(x, None, None, None)], *BLANK) for k, x in enumerate(names)]
    return {tuple(r) for r in spellings.p6_found(spark.createDataFrame(rows, PEOPLE)).collect()}


def groups(kind, *several):
    return {(kind, *sorted((a, b))) for g in several for a in g for b in g if a != b}


def test_spellings_outside_any_list(spark):
    """Reordered parts, two slips, initials and shortened words of names and lines of business that no list has."""
    companies = [
        ["Blue Harbor Wickets", "Harbor Blue Wickets", "Blue Harbour Wickets"], ["Vokarelu Systems", "Vokaerulu Systems", "Vokarrelux Systems"], ["International Widget Makers", "IWM"],
        ["Quintarova Glassblowing", "Glassblowing, Quintarova", "Quintarova Glss.", "Quintarova"], ["Quintessa Glassblowing"], ["Quintarelli Basketry", "QuintarelliBasketry", "Quinta relli Basketry"], ["Quintarelli Pottery"],
    ]
    names = [["Xochitl Zamorabe", "Zamorabe, Xochitl", "X. Zamorabe", "Xochitl Q. Zamorabe", "Xochitl X. Zamorabe", "Xochtil Zamorabe"], ["Anneliese Zamorabe"], ["Wolfgang Brennagel", "Wolf Brennagel"], ["Ildiko Tereskova"], ["Imogen Tereskova"], ["I. Tereskova"]]
    assert linked(spark, sum(companies, []), sum(names, [])) == groups("company", *companies) | groups("name", *names)


def test_links_depend_on_no_count(spark):
    """The same links among few spellings and among many of other entities."""
    own = [["Vokarelu Systems", "Vokaerlu Systems", "Vokarelu"], ["Vokarelu Foods"], ["Mirunabo Systems"]]
    want = {p for p in groups("company", own[0]) if "Vokarelu" not in p[1:]}  # what lacks something fits two
    many = [f"{a}{b}{c}{d} Systems" for a in "BDFG" for b in ("arust", "elopr", "inukl", "ovast", "ubemp") for c in ("iwa", "oxe", "ufo") for d in ("lint", "mong", "rask", "zepp")]
    few = linked(spark, sum(own, []))
    assert few == want and {p for p in linked(spark, sum(own, []) + many) if not set(p[1:]) <= set(many)} == want


def test_tokens_in_very_many_spellings(spark, monkeypatch):
    """A family name of very many persons still meets by the letters of what stands beside it."""
    monkeypatch.setattr(spellings, "HOT", 3)
    names = [["Ann Torvaldsen", "Torvaldsen, Ann", "Anne Torvaldsen"], *[[f"{x} Torvaldsen"] for x in ("Bob", "Carol", "Dave", "Eve", "Frank")], ["Grete Torvaldsen", "Gerte Torvaldsen", "G. Torvaldsen"]]
    forms = spark.createDataFrame([(f"f{k}", "name", x.lower().replace(",", "").replace(".", "").split()) for k, x in enumerate(sum(names, []))], "form string, kind string, tokens array<string>")
    near = spark.createDataFrame([("name", "grete", "gerte"), ("name", "gerte", "grete")], "kind string, x string, y string")
    rows = []
    for r in spellings.weighed(forms, near).collect():
        rows += spellings._keys(iter([spellings.pd.DataFrame([r.asDict()])])).__next__().itertuples(index=False, name=None)
    by_key = {}
    for form, _, token, beside in rows:
        by_key.setdefault((token, beside), set()).add(form)
    assert ("torvaldsen", "") not in by_key and max(len(v) for k, v in by_key.items() if k[0] == "torvaldsen" and k[1] != "*") < 9
    assert linked(spark, names=sum(names, [])) == groups("name", *names)


def test_frequent_tokens_leave_no_partner_out(spark):
    """Short forms and lone spellings whose only common token very many others have too."""
    many = [f"{a}{b}{c}" for a in ("Bra", "Cle", "Dri", "Flo", "Gru", "Pla") for b in ("vin", "mos", "tek", "ruf") for c in ("ala", "ebe", "odo")]
    names = [["Bob Torukasi", "Robert Torukasi"], *[[f"{x} Torukasi"] for x in many]]
    companies = [["Vokarelu Pump Technologies", "Vokarelu Pump Tech"], *[[f"{x} Pump Technologies"] for x in many], *[[f"{x} Tech"] for x in many[:9]]]
    assert groups("name", *names) <= linked(spark, names=sum(names, []))
    # Kust begins like a short form of Koduvetrasti; a frequent word in common isn't enough for that.
    analytics = [["Koduvetrasti Analytics"], ["Kustestikaza Analytics", "Kust estikaza Analytics"], *[[f"{x} Analytics"] for x in many[:60]]]
    got = linked(spark, sum(companies + analytics, []))
    assert groups("company", companies[0], *analytics[:2]) <= got and not any("Koduvetrasti Analytics" in p for p in got)


@pytest.mark.parametrize("hot", [0, 500])
def test_compared_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spellings, "HOT", hot)
    rng = random.Random(5)
    given = "robert bob rob robret johannes hans john j r x theodora dora michael micheal mike miachel ann".split()
    family = "torvaldsen torvaldson trovaldsen torvald vokarelu smith smithson smyth s t van vanvokarelu".split()
    lines = "tech technologies technology bank banking data bricks databricks databrisk dbt labs laboratories ibm international business machines m".split()
    many = {("name", *rng.sample(given, rng.choice([0, 1, 1, 1, 2])), *rng.sample(family, rng.choice([1, 1, 1, 2]))) for _ in range(150)}
    many |= {("company", *rng.sample(lines, rng.choice([1, 2, 2, 3]))) for _ in range(150)} | {("company", "international", "business", "machines"), ("name", "r", "s"), ("name", "bob"), ("company", "smith", "smith"), ("company", "smith")}
    forms = [(f"{k}:{' '.join(t)}", k, list(t)) for k, *t in sorted(many)]
    words = {(k, t) for _, k, ts in forms for t in [*ts, *(x + y for x, y in zip(ts, ts[1:]))]}
    alike = [(k, x, y) for k, x in words for m, y in words if k == m and x != y and spellings.slips(x, y, 2) <= spellings.slips_allowed(min(len(x), len(y)))]
    near = spark.createDataFrame(alike, "kind string, x string, y string")
    weighed = spellings.weighed(spark.createDataFrame(forms, "form string, kind string, tokens array<string>"), near)
    of = {r["form"]: (r["tokens"], r["weights"]) for r in weighed.collect()}
    want = {(k, a, b, *spellings.verdict(k, *of[a], *of[b])) for a, k, _ in forms for b, m, _ in forms if k == m and a < b}
    got = [tuple(r) for r in spellings.compared(weighed, near).collect()]
    assert set(got) == {x for x in want if x[3] != "other"} and len(got) == len(set(got))


@pytest.mark.parametrize(("a", "b", "n"), [("abcd", "abcd", 0), ("abcd", "abdc", 1), ("abcd", "abd", 1), ("abcd", "abxd", 1), ("abcd", "abcde", 1), ("abcd", "badc", 2), ("abcd", "ab", 2), ("abcdefgh", "badcfegh", 3), ("", "a", 1)])
def test_slips(a, b, n):
    assert spellings.slips(a, b, 2) == n and spellings.slips(b, a, 2) == n


def test_near_tokens_equal_brute_force(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("bdkr") + rng.choice("aeo") for _ in range(rng.choice([2, 3, 4, 5]))) for _ in range(150)}
    words |= {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for w in list(words)[:60] for k in [rng.randrange(len(w) - 1)]} | {w[:-1] for w in list(words)[:40]}
    tokens = spark.createDataFrame([("name", w, False) for w in words], "kind string, token string, glued boolean")
    got = {(r["x"], r["y"]) for r in spellings.near_tokens(tokens).collect()}
    want = {(x, y) for x in words for y in words if x != y and spellings.slips(x, y, 2) <= spellings.slips_allowed(min(len(x), len(y)))}
    # Slips that leave no q-gram as it was can't be met; there are few.
    assert got <= want and len(want - got) <= 0.02 * len(want)


# Leakage --------------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    word = [f"w{k}" for k in range(4000)]
    items = [" ".join(rng.sample(word, 40)) for _ in range(12)] + [None, "", "too short"]
    texts = [None, "", "   "]
    for k in range(150):
        fill = lambda n: rng.choices(word, k=n)
        own = items[k % 12].split()
        n = rng.choice([5, 11, 12, 13, 30])
        start = rng.randrange(0, 40 - n)
        part = own[start : start + n]
        if k % 5 == 0 and n > 13:
            part = [w if j % 9 else "other" for j, w in enumerate(part)]
        if k % 3 == 0:
            part = [w.upper() if j % 2 else f"<b>{w[0]}­{w[1:]}</b>," for j, w in enumerate(part)]
        texts.append(rng.choice([" ", "&nbsp;", "\n"]).join([*fill(20), *part, *fill(3000 if k == 7 else 20)]))
    texts += [items[3], items[3]]
    frame = spark.createDataFrame([(k, t, "s", *BLANK) for k, t in enumerate(items)] + [(None, items[0], "s", *BLANK), (0, items[0], "s", *BLANK)], f"item_id long, text string, suite string, {CLASH}")

    def words_of(t):
        t = re.sub(r"</?[A-Za-z][^<>]*>", " ", t or "")
        return regex.findall(r"[\p{L}\p{N}]+", html.unescape(t).replace("­", "").lower())

    want = set()
    for d, t in enumerate(texts):
        w = words_of(t)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, s in enumerate(items):
            v = words_of(s)
            if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)):
                want.add((d, i))
    got = [tuple(r) for r in leakage.p8_found(docs(spark, texts), frame).collect()]
    assert set(got) == want and len(got) == len(want)
    over = leakage.leaked_passages(docs(spark, texts), frame)
    assert over.filter("run < 12 and matched >= 15").count() > 0  # found across substituted words
    assert over.filter("matched > span or run > matched").count() == 0
    assert leakage.p8_found(docs(spark, ["a"]).limit(0), frame).count() == 0 and leakage.p8_found(docs(spark, texts), frame.limit(0)).count() == 0


def test_many_items_give_the_same(spark, monkeypatch):
    """With more seeds than are handed to every task, both sides are joined instead."""
    rng = random.Random(18)
    word = [f"w{k}" for k in range(500)]
    items = [" ".join(rng.choices(word, k=30)) for _ in range(10)]
    texts = [" ".join([*rng.choices(word, k=9), *items[k % 10].split()[: 8 + k], *rng.choices(word, k=9)]) for k in range(20)] + [None, ""]
    frame = spark.createDataFrame([(k, t, "s", *BLANK) for k, t in enumerate(items)], f"item_id long, text string, suite string, {CLASH}")
    few = sorted(map(tuple, leakage.leaked_passages(docs(spark, texts), frame).collect()))
    monkeypatch.setattr(leakage, "SEEDS", 5)
    assert sorted(map(tuple, leakage.leaked_passages(docs(spark, texts), frame).collect())) == few and len(few) > 10


def test_recall_of_substituted_overlaps(spark):
    """Of overlaps of 30 words with every eighth word or so substituted, at least 0.9 are found, as brute force finds them."""
    rng = random.Random(19)
    word = [f"w{k}" for k in range(5000)]
    items = [rng.sample(word, 30) for _ in range(40)]
    texts, want = [], set()
    for k in range(400):
        own = [w if rng.random() > 1 / 8 else "other" for w in items[k % 40]]
        texts.append(" ".join([*rng.choices(word, k=10), *own, *rng.choices(word, k=10)]))
        if sum(w != "other" for w in own) >= 22:
            want.add((k, k % 40))
    frame = spark.createDataFrame([(k, " ".join(t), "s", *BLANK) for k, t in enumerate(items)], f"item_id long, text string, suite string, {CLASH}")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(docs(spark, texts), frame).filter("matched >= 22").collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 300


# Residue --------------------------------------------------------------------------------------------------------------


def test_residue(spark):
    rng = random.Random(9)
    nouns, verbs = [f"noun{k}" for k in range(60)], ["shows", "explains", "compares", "measures"]
    good = [f"The {rng.choice(nouns)} {rng.choice(verbs)} how {rng.choice(nouns)} met {rng.choice(nouns)}. It took {k} weeks." for k in range(600)]
    mentions = ['The lab shows how a template renders `{{ user.name }}` once bound.', 'Designers still paste "lorem ipsum" into drafts; this noun1 explains why.', "The talk lists the errors seen most: access denied, expired tokens and timeouts.", "TRANSCRIPT NOTE: [APPLAUSE] the noun3 shows noun4."] * 8
    bad = ["Dear {{ first_name }}, your place in {{ room }} is confirmed.", "Join %s from %s for a closer look.", "Lorem ipsum dolor sit amet, noun3.", "404 Not Found", "Oops! Something went wrong.", "Please enable JavaScript to view the noun5.", "Hosted by undefined (undefined)", "Rating: NaN / 5", "The noun7 shows noun8.\nTraceback (most recent call last):", "Sample. Sample. Sample. Sample.", "Seite nicht gefunden.", "Cette  page  est  introuvable. Retour  au  programme.", "JavaScriptを有効にしてください。"]
    texts = [*good, *mentions, *bad, None, "", " \n ", "word " * 50_000]
    got = {r["doc_id"] for r in residue.p9_found(docs(spark, texts)).collect()}
    first = len(good) + len(mentions)
    assert set(range(first, first + len(bad))) - got == set()
    assert got - set(range(first, first + len(bad))) - {len(texts) - 1} == set()


def test_wordings_that_are_discussed(spark):
    """A text that tells of filler or errors is none, however often it comes, beside texts that are."""
    good = [f"The noun{k % 40} shows how noun{k % 30} met noun{k % 7}. It took {k} weeks." for k in range(600)]
    told = [f"Dummy copy and placeholder text: a printer explains why town {k} should test pages with true text." for k in range(40)]
    bad = ["This is a dummy description for layout purposes only."] * 5 + ["Dies ist ein Blindtext."] * 5
    got = {r["doc_id"] for r in residue.p9_found(docs(spark, [*good, *told, *bad])).collect()}
    assert got == set(range(640, 650))


def test_rare_trusted_wordings_are_learnt(spark, monkeypatch):
    """A trusted wording that stands once among many of another is found, however few passages are fitted on."""
    monkeypatch.setattr(residue, "FIT_TRUSTED", 5, raising=False)
    trusted = [f"Please enable JavaScript to view the agenda of summit {k}." for k in range(200)] + ["Lorem ipsum dolor sit amet consectetur."]
    good = [f"The noun{k % 40} shows how noun{k % 30} met noun{k % 7}. It took {k} weeks." for k in range(600)]
    got = {r["doc_id"] for r in residue.p9_found(docs(spark, [*good, *trusted])).collect()}
    assert got == set(range(600, 801))


def test_unlabelled_positives_are_learnt(spark):
    """Notices without a trusted pattern are found through the words that they share with trusted ones."""
    trusted = [f"Please enable JavaScript to view the {x} of the summit in your browser." for x in ("agenda", "map", "list", "library") for _ in range(20)]
    hidden = [f"The {x} of the summit needs your browser to view JavaScript." for x in ("agenda", "map")]
    good = [f"Teams compare topic{k % 37} and topic{k % 11} over lunch, says speaker{k}." for k in range(800)]
    got = {r["doc_id"] for r in residue.p9_found(docs(spark, [*good, *trusted, *hidden])).collect()}
    assert got == set(range(len(good), len(good) + len(trusted) + len(hidden)))


def test_nothing_to_learn_from(spark):
    assert residue.p9_found(docs(spark, ["fine text"])).count() == 0
    assert residue.p9_found(docs(spark, ["fine text"]).limit(0)).count() == 0
    assert residue.p9_found(docs(spark, [None, ""])).count() == 0
