"""Components, replacements, sources, sinks and streams on small made-up tables."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from almanac.operators import incremental, vectors
from almanac.operators.components import connected_components
from almanac.operators.diff import greedy_replacements
from almanac.sources import scans, sinks
from almanac.streaming import bursts


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(90)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(500, 500)] + [(900, k) for k in range(901, 930)]
    df = spark.createDataFrame(edges + [(None, 4), (5, None), (900, 901)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = brute_components(edges)
    assert got == {**want, 4: want[4], 5: want[5]}
    assert connected_components(df.limit(0)).count() == 0


def test_greedy_replacements(spark):
    rng = random.Random(5)
    rows = [(p, p + 1, f"r{rng.randrange(8)}", f"a{rng.randrange(8)}", rng.choice([7, 8, 11])) for p in (1, 2) for _ in range(30)]
    rows = list({(r[0], r[2], r[3]): r for r in rows}.values())
    used, want = set(), set()
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[3])):
        if (r[0], r[2]) not in used and (r[0], r[3]) not in used:
            used |= {(r[0], r[2]), (r[0], r[3])}
            want.add(r)
    df = spark.createDataFrame(rows, "prev_index int, cur_index int, removed_id string, added_id string, score int")
    assert {tuple(r) for r in greedy_replacements(df).collect()} == want
    assert greedy_replacements(df.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(300)], "row_id long, u array<double>")
    got = {(r["query_id"], r["rank"]): r["row_id"] for r in vectors.nearest(rows, rows.filter("row_id % 50 = 0 or row_id = 3"), 4).collect()}
    for q in [0, 3, 50, 100, 150, 200, 250]:
        cos = np.round(x @ x[q], 6)
        best = sorted((k for k in range(300) if k != q), key=lambda k: (-cos[k], k))[:4]
        assert [got[q, r] for r in range(1, 5)] == best


def embedded(spark, rows):
    """Rows of embeddings from (row_id, title, vector, ai_focus, theme, audience)."""
    data = [(k, t, f"u/{k}", (f, h, a), [float(v) for v in x]) for k, t, x, f, h, a in rows]
    return spark.createDataFrame(data, "row_id long, title string, url string, labels struct<ai_focus: string, theme: string, audience: string>, embedding array<double>")


def test_related_equals_brute_force_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 100)
    rng = np.random.default_rng(8)
    x, base = rng.normal(size=(400, 64)), rng.normal(size=64)
    x = base + 0.4 * x
    x[:130] = base + 0.01 * x[:130]  # rows of one title, nearest to each other
    word = lambda: "".join(rng.choice(list("abcdef"), 2)) + "xx"
    rows = [(k, "Same title" if k < 130 else None if k % 50 == 1 else f"{word()} {word()} {word()}", x[k], rng.choice(["AI", "Not AI", ""]).item(), rng.choice(["Data", "Infra"]).item(), rng.choice(["", "All", "Few"]).item()) for k in range(400)]
    topics = {k: sorted({word()[:2] for _ in range(3)}) for k in range(0, 400, 2)}
    catalogue = [(str(k), f"u/{k}", topics[k], ["Talk", " talk", "", None][k % 4]) for k in topics]
    sessions = spark.createDataFrame(catalogue, "id string, url string, topics array<string>, session_category string")
    got = {(r["query_id"], r["place"]): (r["row_id"], r["score"]) for r in vectors.related(embedded(spark, rows), sessions).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cat = {int(i): (c or "").strip().lower() for i, _, _, c in catalogue}
    words = [set((t or "").lower().split()) for _, t, *_ in rows]
    want = {}
    for q in range(0, 400, 100):
        scored = []
        for k in range(400):
            cos, shared = round(float(u[q] @ u[k]), 6), len(words[q] & words[k])
            if k == q or rows[k][1] == rows[q][1] or not (rows[k][3] == rows[q][3] or shared) or not (cos > 0.45 or shared):
                continue
            a, b = set(topics.get(q, [])), set(topics.get(k, []))
            bonus = sum(w for w, c in ((0.03, 3), (0.03, 4), (0.02, 5)) if rows[q][c] and rows[q][c] == rows[k][c])
            bonus += 0.06 * len(a & b) / max(1, len(a | b)) + 0.05 * shared / max(1, len(words[q]), len(words[k])) + 0.015 * (cat.get(q, "") != "" and cat.get(q) == cat.get(k))
            scored.append((-cos - bonus, k))
        want |= {(q, n): p for n, p in enumerate(sorted(scored)[:5], 1)}
    assert set(got) == set(want) and len(want) == 20
    assert all(abs(got[p][1] + want[p][0]) < 1e-4 for p in want) and sum(got[p][0] == want[p][1] for p in want) >= 18


def test_blocked_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    word = lambda: "".join(rng.choice(list("abcdefgh"), 2)) + "xx"
    titles = [f"Weekly forum {word()}" if k < 150 else f"{word()} {word()}" for k in range(400)]
    titles[100], titles[200], titles[300] = "Weekly forum", "for the one", None
    got = {(r["query_id"], r["place"]): (r["row_id"], r["shared"]) for r in vectors.blocked_neighbours(embedded(spark, [(k, t, x[k], "", "", "") for k, t in enumerate(titles)]), pool=60).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    words = [set((t or "").lower().split()) - set(vectors.TITLE_STOP) for t in titles]
    want = {}
    for q in range(0, 400, 100):
        shared = {k: len(words[q] & words[k]) for k in range(400) if k != q}
        pool = sorted((k for k in shared if shared[k]), key=lambda k: (-shared[k], -k))[:60] or list(shared)
        best = sorted(pool, key=lambda k: (-round(float(u[q] @ u[k]), 6), k))[:9]
        want |= {(q, n): (k, shared[k]) for n, k in enumerate(best, 1)}
    assert got == want and len(want) == 36


def test_snapshot_files(spark, tmp_path):
    one = {"scraped_at": "2027-03-01T10:00:00Z", "sessions": [{"id": "1", "title": "a", "capacity": "40", "remaining_capacity": ""}, {"id": "", "title": "none"}]}
    (tmp_path / "2027-03-01.json").write_text(json.dumps(one))
    (tmp_path / "2027-03-02.json").write_text(json.dumps({"scrapedAt": "2027-03-02T10:00:00Z", "sessions": []}))
    (tmp_path / "2027-03-03.json").write_text(json.dumps([{"id": "2", "title": "b", "capacity": " x "}]))
    (tmp_path / "2027-03-04.json").write_text("{broken")
    p = scans.snapshot_payloads(spark, str(tmp_path))
    assert [(r["order_index"], r["captured"][:10]) for r in p.orderBy("order_index").collect()] == [(0, "2027-03-01"), (1, "2027-03-02"), (2, "2027-03-03"), (3, "2027-03-04")]
    assert {(r["session_id"], r["order_index"], r["capacity"], r["remaining_capacity"]) for r in scans.snapshot_rows(p).collect()} == {("1", 0, 40, None), ("2", 2, None, None)}
    assert scans.delivered(p).count() == 2
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan  # ranks are taken of the names alone


def test_embedding_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"row_id": 1, "url": "u", "embedding": [1.0]}\n\n{"row_id": 2, "url": "u", "embedding": [2.0]}\n')
    assert [(r["row_id"], r["embedding"]) for r in scans.embeddings(spark, str(tmp_path)).collect()] == [(2, [2.0])]


def test_library_pages(spark):
    page = '<script>library = {"session_12": {"id": "12", "title": "a }", "moreInfoUrl": "u1"}, "session_9": {"id": "9", "moreInfoUrl": ""}}; "session_12": {</script>'
    pages = spark.createDataFrame([("page-2.html", page), ("page-10.html", page.replace("a }", "b")), ("page-3.html", "library = {oops")], "page string, html string")
    recs = scans.library_records(pages)
    assert {(r["page"], r["id"], r["title"]) for r in recs.collect()} == {("page-2.html", "12", "a }"), ("page-10.html", "12", "b")}
    assert [r["title"] for r in scans.latest_listing(recs).collect()] == ["b"]
    assert pages.filter("page = 'page-2.html'").select(scans.listed_ids(F.col("html"))).first()[0] == ["12", "9"]


def test_party_table(spark):
    html = "<tr><td><h2>Mon</h2></td></tr><tr>" + "<td>x</td>" * 5 + "</tr><tr><td>no</td></tr><tr><td><h2>Tue</h2></td></tr><tr>" + "<td><b>y</b></td>" * 5 + "</tr>"
    rows = scans.party_rows(spark.createDataFrame([("p", html)], "page string, html string")).orderBy("pos").collect()
    assert [(r["day"], r["title"]) for r in rows] == [("Mon", "x"), ("Tue", "y")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "a"), ("v", 2, None)], "url string, order_index int, room string")
    sinks.write_snapshots(rows, str(tmp_path / "s"))
    sinks.write_snapshots(rows.filter("order_index = 2").withColumn("room", F.lit("z")), str(tmp_path / "s"))
    assert {tuple(r) for r in sinks.read_snapshots(rows, str(tmp_path / "s")).collect()} == {("u", 1, "a"), ("v", 2, "z")}
    old, new = rows.select("url", "room"), spark.createDataFrame([("v", "n"), ("w", "n")], "url string, room string")
    assert {tuple(r) for r in sinks.merged_manifest(old, new, new).collect()} == {("v", "n"), ("w", "n")}
    full = rows.selectExpr("url", "room", "1 as capacity", "null as remaining_capacity", "2 as registrant_count", "'' as session_category")
    assert {r["remaining_capacity"] for r in sinks.availability_artifact(full).collect()} == {""}


def test_further_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "May 1"), ("2", "May 2"), ("3", "May 1")], "id string, day string")
    at = str(tmp_path / "b")
    sinks.write_buckets(rows, F.col("day"), at)
    sinks.write_buckets(rows.filter("id = '3'"), F.col("day"), at)  # May 1 is replaced, May 2 stays
    assert {(r["id"], r["bucket"]) for r in spark.read.parquet(at).collect()} == {("3", "May 1"), ("2", "May 2")}
    ranked = spark.createDataFrame([(1, 9, 0.5, 2), (1, 8, 0.9, 1), (2, 7, 0.1, 1)], "query_id long, row_id long, score double, place int")
    assert {r["query_id"]: [tuple(x) for x in r["related"]] for r in sinks.related_map(ranked).collect()} == {1: [(8, 0.9), (9, 0.5)], 2: [(7, 0.1)]}
    sinks.json_lines(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("id string, day string").json(str(tmp_path / "j")).collect())) == sorted(map(tuple, rows.collect()))


def test_labels_of_a_client(spark):
    from almanac.operators import rules

    rows = spark.createDataFrame([("1", "agents"), ("2", None)], "id string, title string")
    got = rules.external_labels(rows, lambda b: b.assign(theme=b["title"].fillna("none"))[["id", "theme"]], "id string, theme string")
    assert {tuple(r) for r in got.collect()} == {("1", "agents"), ("2", "none")}


def test_small_sides_are_checked(spark):
    from almanac import session

    df = spark.range(10).select("id", F.repeat(F.lit("x"), 50).alias("s"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small(df)) and not hinted(session.small(df, rows=9)) and not hinted(session.small(df, size=400))
    kept = session.written(df)
    assert kept.count() == 10 and session.discard(spark) > 0 and session.discard(spark) == 0


def test_union_of_shards(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert {tuple(r) for r in incremental.united([a, b]).collect()} == {(1, "x"), (2, None)}


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2027-01-01 00:00:00"), (1, "2027-01-01 02:00:00"), (1, "2027-01-01 04:00:01"), (2, None), (None, "2027-01-01 00:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "e"))
    want = sorted(tuple(r) for r in bursts.burst_windows(rows).collect())
    assert [r[3] for r in want] == [2, 1]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    assert sorted(tuple(r) for r in bursts.finished_bursts(stream).collect()) == want


def test_stream_goes_on_and_drops_late_events(spark, tmp_path):
    """Bursts are given out once, when the watermark has passed them; a burst over two runs is one; late events don't count."""
    write = lambda rows: spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    run = lambda: bursts.append_to(bursts.burst_windows(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "e")), late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    seen = lambda: sorted((r["user_id"], str(r["first_ts"])[11:16], str(r["last_ts"])[11:16], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect())
    write([(1, "2027-01-01 00:00:00"), (1, "2027-01-01 01:00:00")])
    run()
    assert seen() == []
    write([(1, "2027-01-01 02:30:00"), (2, "2027-01-01 09:00:00")])
    run()
    assert seen() == [(1, "00:00", "02:30", 3)]
    write([(1, "2027-01-01 01:30:00"), (3, "2027-01-01 20:00:00")])  # the first is long past the watermark
    run()
    assert seen() == [(1, "00:00", "02:30", 3), (2, "09:00", "09:00", 1)]


def test_session_records(spark):
    from almanac.sources import records

    page = '<script>session = {"id": "12", "title": "", "remaining": 0, "speakers": [{"firstName": "A", "lastName": "B", "company": "C"}, {"fullName": "D E"}, {"company": "x"}]};</script><div class="my description"> </div><section id="abstract"><p>Hello<br>you</p></section> video_id = "abcdef1"'
    pages = spark.createDataFrame([("https://x/session/12/a", page), ("https://x/session/13/b", "broken session = {")], "url string, html string")
    seeds = spark.createDataFrame([("https://x/session/12/a", "T", "R", "40", "7"), ("https://x/session/13/b", "U", None, "", None)], "moreInfoUrl string, title string, room string, capacity string, remaining string")
    got = {r["key"]: r for r in records.session_records(pages, seeds).collect()}
    a, b = got["12"], got["13"]
    assert (a["title"], a["room"], a["capacity"], a["remaining"], a["description"], a["video_url"]) == ("T", "R", 40, 0, "Hello\nyou", "https://youtu.be/abcdef1")
    assert [tuple(s) for s in a["speakers"]] == [("A B", "C", None), ("D E", None, None)]
    assert (b["title"], b["room"], b["capacity"], b["speakers"]) == ("U", "", None, [])


def test_lookups_and_overrides(spark):
    from almanac.sources import records

    s = spark.createDataFrame([("1", ["b", "a", "z"]), ("2", None), ("3", [None])], "id string, refs array<string>")
    p = spark.createDataFrame([("a", "Ann"), ("b", "Bo"), ("a", "Abe"), (None, "x")], "ref string, name string")
    assert {r["id"]: r["names"] for r in records.looked_up(s, p).collect()} == {"1": ["Bo", "Ann", "missing:z"], "2": [], "3": ["missing:?"]}
    events = spark.createDataFrame([("Party\nmore", "open", "none"), ("Other", "open", "none")], "title string, access string, food string")
    o = spark.createDataFrame([("Party", "list", None)], "key string, access string, food string")
    assert {tuple(r) for r in records.overridden(events, o, records.first_line(F.col("title")), ["access", "food"]).collect()} == {("Party\nmore", "list", "none"), ("Other", "open", "none")}


def test_typed_lines(spark):
    from almanac.sources import records

    lines = ["Add to", "Ann Lee", "Ann Lee", "Head of 2 things", "Acme", "Partner", "junk 1", "Bo van Dam", "CTO, R&D", "Beta", "Cy Do", "x"]
    rows = spark.createDataFrame([(1, lines), (2, None), (3, [])], "k int, l array<string>")
    got = {r["k"]: [tuple(x) for x in r["b"]] for r in rows.select("k", records.speaker_blocks("l").alias("b")).collect()}
    assert got == {1: [("Ann Lee", "Head of 2 things", "Acme"), ("Bo van Dam", "CTO, R&D", "Beta")], 2: [], 3: []}
    card = spark.createDataFrame([("Breakout | #AI #data #AI",), ("#x",)], "c string").select(records.card_parts(F.col("c")).alias("p"))
    assert [(r["p"]["type"], r["p"]["tags"]) for r in card.collect()] == [("Breakout", ["AI", "data"]), (None, ["x"])]
    assert [r[0] for r in spark.createDataFrame([("", "u/12/x", 3), (" 7 ", "", 1), (None, "u", 5)], "i string, u string, n int").select(records.cache_key(F.col("i"), F.col("u"), F.col("n"))).collect()] == ["12", "7", "idx-5"]
