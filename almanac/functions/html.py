"""Text out of HTML, links, boilerplate and excerpts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.text import html_unescape, squeeze

#: Words that mark navigation, and words that mark an event's own text.
NAV_WORDS = "products|solutions|resources|pricing|blog|docs|support|careers|company|platform"
EVENT_WORDS = "join|invite|event|party|reception|network|networking|happy hour|dinner|lunch|breakfast|drinks|cocktails|food|register|rsvp|builders|leaders|community|founders|engineers"


def strip_tags(c: Column) -> Column:
    """Breaks and paragraph ends as line ends, other tags as blanks, escapes read, blanks collapsed on each line."""
    lines = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n"), r"<[^>]*>", " ")
    each = F.transform(F.split(html_unescape(lines), "\n"), squeeze)
    return F.regexp_replace(F.regexp_replace(F.array_join(each, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def anchors(html: Column) -> Column:
    """The links of a page: array of struct(url, label)."""
    pattern = r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    urls, labels = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(urls, labels, lambda u, t: F.struct(html_unescape(u).alias("url"), squeeze(F.regexp_replace(t, r"<[^>]*>", " ")).alias("label")))


def first_link(links: Column, token: str) -> Column:
    """The url of the first link whose url or label has a token, null if none."""
    hit = F.filter(links, lambda x: F.contains(F.lower(F.concat_ws(" ", x["url"], x["label"])), F.lit(token)))
    return F.try_element_at(hit, F.lit(1))["url"]


def clean_url(c: Column) -> Column:
    """A url without query, fragment and end slash; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", ""), F.lit(""))


def redact(c: Column) -> Column:
    """Keys and addresses that must not be passed on, replaced."""
    keys = F.regexp_replace(c, r"\b(?:AIza[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z]{16,})\b", "[redacted]")
    codes = F.regexp_replace(keys, r"\b[0-9a-f]{10,}\b", "[code]")
    return F.regexp_replace(codes, r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}", "[address]")


def sentences(c: Column) -> Column:
    """Sentences, cut after an end mark before a capital or digit."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9])"), squeeze), lambda x: x != "")


def is_boilerplate(line: Column) -> Column:
    """Short lines, lines of navigation and notices."""
    low = F.lower(line)
    return (F.length(line) < 24) | F.regexp_like(low, F.lit("privacy policy|all rights reserved|cookie|skip to content|open menu")) | (F.regexp_count(line, F.lit(r"[|>]")) >= 4) | (F.regexp_count(low, F.lit(rf"\b({NAV_WORDS})\b")) >= 4)


def block_score(line: Column) -> Column:
    """How much a block looks like an event's text: its length to 500, marks, event words, less navigation words."""
    low = F.lower(line)
    score = F.least(F.length(line), F.lit(500)) + 30 * F.regexp_count(line, F.lit("[.!?;:]")) + 45 * F.regexp_count(low, F.lit(rf"\b({EVENT_WORDS})\b")) - 80 * F.regexp_count(low, F.lit(rf"\b({NAV_WORDS})\b"))
    return F.when(is_boilerplate(line), 0).otherwise(score)


def summary(c: Column, most: int = 2) -> Column:
    """The first sentences of 35 to 220 letters of which none contains another kept before."""
    good = F.filter(sentences(c), lambda s: F.length(s).between(35, 220))
    empty = F.filter(F.array(F.lit("")), lambda s: F.lit(False))

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: F.contains(F.lower(k), F.lower(s)) | F.contains(F.lower(s), F.lower(k)))
        return F.when((F.size(kept) >= most) | clash, kept).otherwise(F.concat(kept, F.array(s)))

    return F.array_join(F.aggregate(good, empty, step), " ")


def json_slices(c: Column, opener: str) -> Column:
    """The balanced JSON object after the first match of a pattern that ends in '{', aware of strings and escapes; null if unbalanced.

    A fold over the characters of the rest keeps depth and state, so it stays in the JVM.
    """
    at = F.regexp_instr(c, F.lit(opener))
    start = at + F.length(F.regexp_substr(c, F.lit(opener))) - 1
    rest = c.substr(start, F.length(c))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(a: Column, ch: Column) -> Column:
        quoted = F.when(a["escaped"], a["quoted"]).when(ch == '"', ~a["quoted"]).otherwise(a["quoted"])
        move = F.when(a["quoted"] | (a["end"] > 0), 0).when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        depth = a["depth"] + move
        end = F.when(a["end"] > 0, a["end"]).when((depth == 0) & (move == -1), a["n"] + 1).otherwise(0)
        return F.struct((a["n"] + 1).alias("n"), depth.alias("depth"), quoted.alias("quoted"), (a["quoted"] & ~a["escaped"] & (ch == "\\")).alias("escaped"), end.alias("end"))

    end = F.aggregate(F.split(rest, ""), zero, step)["end"]
    return F.when((at > 0) & (end > 0), rest.substr(F.lit(1), end))
