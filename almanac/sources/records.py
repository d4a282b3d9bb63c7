"""Session records out of pages and exports: nested values, fallbacks, lookups and lines that people typed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import html
from almanac.functions.text import squeeze
from almanac.operators.catalog import session_key
from almanac.sources.scans import coalesced

DETAIL = "struct<id: string, title: string, capacity: int, remaining: int, room: string, speakers: array<struct<firstName: string, lastName: string, fullName: string, company: string, jobTitle: string>>>"
#: The places where a page may hold its description, in the order in which they are tried.
DESCRIPTIONS = [r'(?is)<div[^>]*class="[^"]*description[^"]*"[^>]*>(.*?)</div>', r'(?is)<section[^>]*id="abstract"[^>]*>(.*?)</section>', r'(?is)<meta[^>]*property="og:description"[^>]*content="([^"]*)"', r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"']


def detail_source(page: Column) -> Column:
    """The session object assigned in a detail page, null if it is missing or broken."""
    return F.from_json(html.json_slices(page, r"session\s*=\s*\{"), DETAIL)


def speaker_list(source: Column) -> Column:
    """Speakers as (name, company, job_title): first and last name, else the full one; nameless ones are dropped."""
    named = F.transform(F.coalesce(source["speakers"], F.array().cast(f"array<{'struct<firstName: string, lastName: string, fullName: string, company: string, jobTitle: string>'}>")), lambda s: F.struct(squeeze(F.coalesce(F.nullif(F.trim(F.concat_ws(" ", s["firstName"], s["lastName"])), F.lit("")), s["fullName"], F.lit(""))).alias("name"), s["company"].alias("company"), s["jobTitle"].alias("job_title")))
    return F.filter(named, lambda s: s["name"] != "")


def description(page: Column) -> Column:
    """The first description that isn't blank, as plain text."""
    found = [F.nullif(html.strip_tags(F.regexp_extract(page, p, 1)), F.lit("")) for p in DESCRIPTIONS]
    return F.coalesce(*found, F.lit(""))


def video_url(page: Column) -> Column:
    """The address in a player's set-up, else one made of the page's video id, else blank."""
    direct = F.nullif(F.regexp_extract(page, r"(https://www\.youtube\.com/[\w?=&/.-]+)", 1), F.lit(""))
    made = F.nullif(F.regexp_extract(page, r"video_id\s*[:=]\s*[\"']([\w-]{6,})[\"']", 1), F.lit(""))
    return F.coalesce(direct, F.concat(F.lit("https://youtu.be/"), made), F.lit(""))


def session_records(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """One record per detail page, its blanks filled from the listing; pages: ``(url, html)``, seeds: ``(moreInfoUrl, title, room, capacity, remaining)``.

    Texts skip blanks, numbers skip nulls only, so a count of 0 on the page stays.
    """
    d = pages.select("url", F.col("html"), detail_source(F.col("html")).alias("s")).join(seeds.withColumnRenamed("moreInfoUrl", "url").select("url", F.struct("title", "room", "capacity", "remaining").alias("seed")), "url", "left")
    count = lambda a, b: F.coalesce(F.col(a), F.trim(F.col(b)).try_cast("int"))
    return d.select("url", session_key(F.col("s.id"), F.col("url")).alias("key"), coalesced(F.col("s.title"), F.col("seed.title")).alias("title"), coalesced(F.col("s.room"), F.col("seed.room")).alias("room"), count("s.capacity", "seed.capacity").alias("capacity"), count("s.remaining", "seed.remaining").alias("remaining"), speaker_list(F.col("s")).alias("speakers"), description(F.col("html")).alias("description"), video_url(F.col("html")).alias("video_url"))


def cache_key(id_: Column, url: Column, place: Column) -> Column:
    """The id, else the number in the url, else the record's place."""
    return F.coalesce(F.nullif(F.trim(id_), F.lit("")), F.nullif(F.regexp_extract(url, r"/(\d+)(?:/|$)", 1), F.lit("")), F.concat(F.lit("idx-"), place.cast("string")))


def looked_up(sessions: DataFrame, people: DataFrame) -> DataFrame:
    """Sessions with their speakers' names in order; an id that isn't among the people gives ``missing:<id>``.

    sessions: ``(id, refs array<string>)``; people: ``(ref, name)``, of repeated refs the greatest name counts. A session
    without refs keeps an empty list.
    """
    once = people.filter("ref is not null").groupBy("ref").agg(F.max("name").alias("name"))
    d = sessions.select("id", F.posexplode_outer("refs").alias("pos", "ref")).join(once, "ref", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("name", F.concat(F.lit("missing:"), F.coalesce("ref", F.lit("?")))).alias("name")))
    return d.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("s")).select("id", F.transform("s", lambda x: x["name"]).alias("names"))


def overridden(events: DataFrame, overrides: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """Events whose fields are replaced by those of the override with the same key, where it has one."""
    o = overrides.select(F.col("key").alias("_key"), F.struct(*fields).alias("_o"))
    d = events.withColumn("_key", key).join(o, "_key", "left")
    return d.select(*[F.coalesce(F.col(f"_o.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in events.columns])


def first_line(text: Column) -> Column:
    return squeeze(F.element_at(F.split(text, r"\r\n|\n|\r"), 1))


def card_parts(card: Column) -> Column:
    """Type and tags of a session card: the word before the first bar, and the hashed words after it."""
    kind = squeeze(F.regexp_extract(card, r"^([^|#]*)", 1))
    return F.struct(F.nullif(kind, F.lit("")).alias("type"), F.array_distinct(F.regexp_extract_all(card, F.lit(r"#([\w-]+)"), F.lit(1))).alias("tags"))


NAME = re.compile(r"^[^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){1,4}$")
#: Lines that look like names but aren't.
NOT_NAMES = {"add to", "learn more", "view all", "sign in", "read more", "session details"}


def _blocks(lines: list[str]) -> list[tuple[str, str, str]]:
    """Name, role and company out of typed lines; a block has three lines, or four with an affiliation after the company."""
    lines = [x for x, y in zip(lines, [*lines[1:], None]) if x != y]
    out, k = [], 0
    while k + 2 < len(lines):
        name, role, company = lines[k : k + 3]
        if NAME.match(name) and name.lower() not in NOT_NAMES and 3 <= len(role) <= 120 and len(company) < 80 and not NAME.match(role):
            out.append((name, role, company))
            k += 4 if k + 3 < len(lines) and lines[k + 3] in ("Partner", "Customer", "Host") else 3
        else:
            k += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "role", "company")])))
def speaker_blocks(lines: pd.Series) -> pd.Series:
    """The speakers in a list of typed lines; how far a block reaches depends on what was read, so it is read in order."""
    return pd.Series([[dict(zip(("name", "role", "company"), b)) for b in _blocks([x.strip() for x in v if x and x.strip()])] if v is not None else [] for v in lines])


def canonical_earlier(sessions: DataFrame) -> DataFrame:
    """Sessions of the earlier year in the shape of the current ones: counts unknown, companies once each, in order."""
    once = sessions.filter("code is not null").groupBy("code").agg(F.max(F.struct("title", "speakers")).alias("s"))
    companies = F.array_distinct(F.filter(F.transform("s.speakers", lambda x: squeeze(x["company"])), lambda x: x != ""))
    return once.select(F.col("code").alias("id"), "s.title", F.array_join(companies, "; ").alias("companies"), F.coalesce(F.size("s.speakers"), F.lit(0)).alias("n_speakers"), F.lit(None).cast("int").alias("capacity"))
