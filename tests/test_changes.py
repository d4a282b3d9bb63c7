"""Changes of records, replacements and company identity on small made-up tables."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from almanac.operators import changes, companies

PERSON = "array<struct<name: string>>"
RECORD = f"struct<title: string, room: string, date_text: string, start_time_text: string, end_time_text: string, description: string, topics: array<string>, speakers: {PERSON}, remaining_capacity: int>"
PAIR = f"prev_index int, cur_index int, session_id string, p {RECORD}, c {RECORD}"


def rec(title="t", room="r", day="d", start="s", end="e", text="one two three four", topics=("a", "b"), people=("x",), left=5):
    return (title, room, day, start, end, text, None if topics is None else list(topics), None if people is None else [(n,) for n in people], left)


def test_changes_are_classified(spark):
    base = rec()
    rows = [
        ("same", base, rec(left=4)), ("room", base, rec(room="q")), ("blank", rec(room=None), rec(room="")), ("wording", rec(text="a b c d e f g h i j"), rec(text="a b c d e f g h i J k")), ("rewritten", base, rec(text="five six")),
        ("other speaker", base, rec(people=("y",))), ("more speakers", base, rec(people=("x", "y"))), ("order", base, rec(topics=("b", "a"))), ("member", base, rec(topics=("a", "c"))), ("no topics", base, rec(topics=None)),
        ("empty", rec(topics=None, people=None), rec(topics=(), people=())), ("gone", base, None), ("new", None, base),
    ]
    got = {r["session_id"]: (r["material"], r["minor"]) for r in changes.classified_changes(spark.createDataFrame([(1, 2, *r) for r in rows], PAIR)).collect()}
    assert got == {"room": ("room", ""), "wording": ("", "description"), "rewritten": ("description", ""), "other speaker": ("", "speakers"), "more speakers": ("speakers", ""), "order": ("", "topics"), "member": ("topics", ""), "no topics": ("topics", "")}


def test_comparison_counts_every_kind(spark):
    rows = [(1, 2, "a", None, rec()), (1, 2, "f", rec(), None), (2, 3, "f", None, rec()), (1, 2, "g", rec(left=0), rec(left=3, room="q")), (2, 3, "g", rec(left=3), rec(left=0)), (3, 4, "g", rec(left=2), rec(left=2))]
    got = {r["prev_index"]: r.asDict() for r in changes.comparison(spark.createDataFrame(rows, PAIR)).collect()}
    assert (got[1]["added"], got[1]["removed"], got[1]["unstable"], got[1]["material"], got[1]["reopened"], got[1]["meaningful"]) == (1, 0, 1, 1, 1, True)
    assert (got[2]["unstable"], got[2]["filled"], got[2]["full"]) == (1, 1, 1) and got[3]["meaningful"] is False


def test_replacements_equal_brute_force(spark):
    rng = random.Random(4)
    some = lambda xs, k: tuple(rng.sample(xs, rng.randrange(k + 1)))
    make = lambda: rec(room=rng.choice(["r1", "r2", "r3", "", None]), day=rng.choice(["d1", "d2", ""]), start=rng.choice(["9", "10", "11", None]), end=rng.choice(["10", "11", ""]), topics=rng.choice([None, some(["A", "b ", "c", "", "d"], 4)]), people=rng.choice([None, some(["x", "Y", "z"], 2)]))
    rows = [(p, p + 1, f"r{k}", make(), None) for p in (1, 2) for k in range(25)] + [(p, p + 1, f"a{k}", None, make()) for p in (1, 2) for k in range(25)] + [(1, 2, "both", make(), make())]
    clean = lambda xs: {x.lower().strip() for x in xs or []} - {""}
    want = {}
    for p, _, r, x, _ in rows:
        for q, _, a, _, y in rows:
            if p == q and r[0] == "r" and a[0] == "a":
                n = sum(w for k, w in ((2, 3), (3, 4), (4, 2), (1, 4)) if x[k] and x[k] == y[k])
                n += min(3, len(clean(x[6]) & clean(y[6]))) + min(4, 2 * len(clean(z[0] for z in x[7] or []) & clean(z[0] for z in y[7] or [])))
                if n >= 7:
                    want[p, r, a] = n
    got = changes.replacement_scores(spark.createDataFrame(rows, PAIR)).collect()
    assert {(r["prev_index"], r["removed_id"], r["added_id"]): r["score"] for r in got} == want and len(got) == len(want) > 50
    assert changes.replacement_scores(spark.createDataFrame([], PAIR)).count() == 0


def test_company_identity(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"aliases": {"Acme": "Acme Works", "acme llc": "Acme", "Blue & Co": "Blue"}, "ownNames": ["Acme"], "ownWords": ["acme", "Zeta"]}))
    rules = companies.CompanyRules.read(spark, str(path))
    df = spark.createDataFrame([("ACME",), ("Acme, LLC",), (" blue and co. ",), ("Zeta/Other",), ("Zetas",), ("",), (None,)], "c string")
    name = rules.canonical(F.col("c"))
    got = [tuple(r) for r in df.select(name, companies.plain_key(name), rules.is_own(name)).collect()]
    assert got == [("Acme Works", "acme works", True), ("Acme", "acme", True), ("Blue", "blue", False), ("Zeta/Other", "zeta other", True), ("Zetas", "zetas", False), ("", "", False), ("", "", False)]
    hits = lambda w: [r[0] for r in df.filter(rules.matches(F.col("c"), w)).collect()]
    assert hits("acme") == ["ACME", "Acme, LLC"] and hits("eta") == ["Zeta/Other", "Zetas"] and hits("Blue & Co") == [" blue and co. "] and len(hits(" ")) == 7
    rows = spark.createDataFrame([("1", "t", [("ACME",), ("acme",), (" blue and co ",)]), ("1", "t", [("ACME",), ("acme",), (" blue and co ",)]), ("2", "u", [("Blue",), (None,)]), ("3", None, None), (None, "x", [("Blue",)])], "id string, title string, speakers array<struct<company: string>>")
    assert [tuple(r) for r in companies.ranking(rows, rules).collect()] == [("Blue", 2)]
    assert tuple(companies.distinct_count(rows, rules).first()) == (2, 1)
    assert {r["id"] for r in companies.speaking(rows, rules, "blue & co").collect()} == {"1", "2"}
    for none in (companies.ranking, companies.identities):
        assert none(rows.limit(0), rules).count() == 0
