"""Filters and text search over current sessions: conditions are built from parameters and left to Catalyst."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.catalog import band, current_sessions, number
from almanac.operators.rollup import company_key


@dataclass
class Filters:
    """The state of the explorer. Empty parameters are inactive and add no condition to the plan."""

    query: str = ""
    exclude: str = ""
    day: str = ""
    topic: str = ""
    start_from: str = ""
    start_to: str = ""
    company: str = ""
    person: str = ""
    ai_focus: str = ""
    theme: str = ""
    audience: str = ""
    availability: str = ""
    sponsored: str = ""
    ids: list[str] | None = field(default=None)

    @classmethod
    def from_search(cls, search: str) -> Filters:
        """Reads the state of a URL's query string; unknown parameters are ignored."""
        got = {k: v[-1] for k, v in parse_qs(search.lstrip("?")).items() if k in cls.__dataclass_fields__}
        if "ids" in got:
            got["ids"] = [x for x in got["ids"].split(",") if x]
        return cls(**got)

    def to_search(self) -> str:
        """The query string of the state, without what is empty."""
        parts = {k: ",".join(v) if isinstance(v, list) else v for k, v in vars(self).items()}
        return urlencode({k: v for k, v in parts.items() if v})


def terms_of(query: str) -> list[str]:
    """Words and quoted phrases of a query, in lower case."""
    return [a or b or c for a, b, c in re.findall(r'"([^"]+)"|\'([^\']+)\'|(\S+)', query.lower())]


def term_match(text: Column, term: str) -> Column:
    """A phrase as a substring, a word between ASCII word boundaries; text must be in lower case."""
    if re.search(r"\s", term):
        return F.contains(text, F.lit(term))
    word = re.sub(r"^\W+|\W+$", "", term)
    if not word:
        return F.lit(False)
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", word)
    return F.contains(text, F.lit(word)) & F.regexp_like(text, F.lit(f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])"))


def haystack() -> Column:
    """All that a text search looks at: title, description, room, topics, speakers and companies, in lower case."""
    people = F.transform("speakers", lambda s: F.concat_ws(" ", s["name"], s["company"]))
    return F.lower(F.concat_ws(" ", "title", "description", "room", F.concat_ws(" ", "topics"), F.concat_ws(" ", people)))


def all_terms(text: Column, query: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [term_match(text, t) for t in terms_of(query)], F.lit(True))


def any_term(text: Column, query: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [term_match(text, t) for t in terms_of(query)], F.lit(False))


def conditions(f: Filters) -> list[Column]:
    """The active conditions, cheap ones first and text search last."""
    out: list[Column] = []
    if f.ids is not None:
        out.append(F.col("id").isin(f.ids) if f.ids else F.lit(False))
    if f.day:
        out.append(F.col("date_text") == f.day)
    if f.topic:
        out.append(F.array_contains("topics", f.topic))
    clock = F.substring("start_at", 12, 5)
    if f.start_from:
        out.append((clock != "") & (clock >= f.start_from))
    if f.start_to:
        out.append((clock != "") & (clock <= f.start_to))
    for name in ("ai_focus", "theme", "audience"):
        if getattr(f, name):
            out.append(F.col(f"llm.{name}") == getattr(f, name))
    if f.availability:
        out.append(band(number(F.col("remaining_capacity"))) == f.availability)
    if f.sponsored:
        out.append(F.coalesce("sponsored", F.lit(False)) == (f.sponsored == "yes"))
    if f.company:
        raw, key = f.company.lower(), re.sub(r"[^a-z0-9]+", " ", f.company.lower().replace("&", " and ")).strip()
        out.append(F.exists("speakers", lambda s: F.coalesce(F.contains(F.lower(s["company"]), F.lit(raw)) | F.contains(company_key(s["company"]), F.lit(key)), F.lit(False))))
    if f.person:
        out.append(F.exists("speakers", lambda s: F.coalesce(F.contains(F.lower(F.concat_ws(" ", s["name"], s["company"])), F.lit(f.person.lower())), F.lit(False))))
    if f.query:
        out.append(all_terms(haystack(), f.query))
    if f.exclude:
        out.append(~any_term(haystack(), f.exclude))
    return out


def search(sessions: DataFrame, f: Filters, columns: tuple[str, ...] = ("title", "start_at", "date_text")) -> DataFrame:
    """Current sessions that meet all active conditions, with their id and the columns asked for; a null is a miss.

    Conditions go before the repeated rows of an id are taken together, so they reach the scan.
    """
    return current_sessions(functools.reduce(lambda df, c: df.filter(c), conditions(f), sessions).select("id", *columns))


def ordered(found: DataFrame, featured: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """By featured rank, start, day and title in binary order, missing ones last, then id."""
    rank = F.array_position(F.array(*[F.lit(x) for x in featured]), F.col("id")) if featured else F.lit(0).cast("bigint")
    keys = [F.when(rank > 0, rank).asc_nulls_last(), F.nullif("start_at", F.lit("")).asc_nulls_last(), F.nullif("date_text", F.lit("")).asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("id").asc()]
    out = found.orderBy(*keys)
    return out.limit(limit) if limit else out


def group_of(query: str) -> Column:
    """The index of the first comma-separated group whose terms all match, null if none; ``title:`` and ``description:`` limit a term."""
    title = F.lower(F.coalesce("title", F.lit("")))
    described = F.lower(F.concat_ws(" ", "title", "description"))
    out = None
    for k, group in enumerate(g.strip() for g in query.split(",") if g.strip()):
        hits = []
        for t in terms_of(group):
            if t.startswith("title:"):
                hits.append(term_match(title, t[6:]))
            elif t.startswith("description:"):
                hits.append(term_match(described, t[12:]))
            else:
                hits.append(term_match(haystack(), t))
        cond = functools.reduce(lambda a, b: a & b, hits)
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(None).cast("int") if out is None else out


def facets(rows: DataFrame, **equal: str) -> DataFrame:
    """Equality on each facet given; those left empty don't limit."""
    return functools.reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v], rows)
