"""Text, time, HTML, search and rule expressions on tables of cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from almanac.functions import html, text
from almanac.operators import catalog, rollup, rules, search


def each(spark, f, cases, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], f"k int, x {kind}")
    return [r[0] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


def test_unescape(spark):
    cases = {"a &amp; b": "a & b", "&#39;&#x27;": "''", "&nope; &": "&nope; &", "&amp;amp;": "&amp;", "&eacute;&#128512;": "é😀", "&#55296;": "&#55296;", "&AMP;": "&", "": "", None: None}
    assert each(spark, text.html_unescape, cases) == list(cases.values())


def test_fold(spark):
    cases = {" A  &amp;\tB ": "a & b", " ": None, None: None, "　x ": "x"}
    assert each(spark, text.fold, cases) == list(cases.values())


def test_minutes(spark):
    cases = {"2:15 PM": 855, " 02:15 pm ": 855, "14:15": 855, "12:00 a.m.": 0, "12:30PM": 750, "9 AM": 540, "25:00": None, "13:00 PM": None, "noon": None, "": None, None: None}
    assert each(spark, text.minutes_of_day, cases) == list(cases.values())


def test_strip_tags(spark):
    cases = {"<p>a<br/>b</p>": "a\nb", "x &lt;b&gt; y": "x <b> y", "<i>a</i>  c": "a c", None: None, "": ""}
    assert each(spark, html.strip_tags, cases) == list(cases.values())


def test_anchors_and_first_link(spark):
    page = '<a href="u?a=1&amp;b=2">Slides <b>here</b></a><a class="x" href="v">Video</a>'
    assert each(spark, lambda c: F.to_json(html.anchors(c)), [page, ""]) == ['[{"url":"u?a=1&b=2","label":"Slides here"},{"url":"v","label":"Video"}]', "[]"]
    assert each(spark, lambda c: html.first_link(html.anchors(c), "video"), [page, "none"]) == ["v", None]


def test_json_slice(spark):
    cases = {'var s = {"a": "}{", "b": {"c": "\\"}"}}; x': '{"a": "}{", "b": {"c": "\\"}"}}', "var s = {": None, "nothing": None}
    assert each(spark, lambda c: html.json_slices(c, r"s = \{"), cases) == list(cases.values())


def test_summary_drops_contained_sentences(spark):
    a, b = "This is one sentence that is long enough.", "Another sentence follows which is fine as well."
    assert each(spark, html.summary, [f"Short. {a} {a} {b} {b} Third sentence that would be long enough too."]) == [f"{a} {b}"]


def test_redaction(spark):
    assert each(spark, html.redact, ["key sk-abcdefghijklmnop1234 of a.b@c.example code 4a840624886f"]) == ["key [redacted] of [address] code [code]"]


@pytest.mark.parametrize(("query", "text_", "hit"), [("ai", "ai labs", True), ("ai", "email", False), ("c++", "in c++ now", True), ('"big data"', "so big data", True), ('"big data"', "bigdata", False), ("a.b", "axb", False), ("ai", "éai", True), ("a b", "b c a", True)])
def test_term_match(spark, query, text_, hit):
    assert each(spark, lambda c: search.all_terms(c, query), [text_]) == [hit]


def test_filters_round_trip():
    f = search.Filters(query="a b", theme="Data", ids=["1", "2"])
    assert search.Filters.from_search(f.to_search()) == f and search.Filters.from_search("?x=1") == search.Filters()
    assert search.conditions(search.Filters()) == []


def test_company_key(spark):
    cases = {"Acme, Inc.": "acme", "A & B Ltd": "a and b", "  ": "", None: None}
    assert each(spark, rollup.company_key, cases) == list(cases.values())


def test_band(spark):
    assert each(spark, catalog.band, [None, 0, -1, 5], "int") == ["unknown", "full", "not-full", "not-full"]


def test_session_key(spark):
    cases = {"https://x/session/12/a": "12", "https://x/other": "https://x/other", "": None, None: None}
    assert each(spark, lambda c: catalog.session_key(F.lit(""), c), cases) == list(cases.values())


def test_day_key(spark):
    cases = {"Wednesday, May 12, 2027": "2027-05-12", "Any Day!": "any-day", "": "UNSCHEDULED", None: "UNSCHEDULED"}
    assert each(spark, rollup.day_key, cases) == list(cases.values())


def test_audience(spark):
    cases = [["AI"], ["data", "Data", "security"], ["data", "security", "leaders", "hands-on", "storage"], None, []]
    assert each(spark, rules.audience, cases, "array<string>") == ["General", "Data pros", "General", "General", "General"]
