"""Identity of companies: canonical names by a table of aliases, and which of them belong to the host."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.catalog import current_sessions


def plain_key(c: Column) -> Column:
    """Lower case, & as and, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "&", " and "), r"[^a-z0-9]+", " "))


def plain_text(s: str) -> str:
    """``plain_key`` of one string, for parameters."""
    return re.sub(r"[^a-z0-9]+", " ", s.strip().lower().replace("&", " and ")).strip()


@dataclass(frozen=True)
class CompanyRules:
    """Aliases by name, names that are the host's, and words that make any name the host's; a parameter of the operators.

    The table is written by hand and small. It goes into the plan as one literal map, so nothing is joined or shuffled.
    """

    aliases: dict[str, str]
    own_names: tuple[str, ...] = ()
    own_words: tuple[str, ...] = ()

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CompanyRules:
        """The rules of a JSON file with ``aliases``, ``ownNames`` and ``ownWords``."""
        found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        return cls(dict(found.get("aliases", {})), tuple(found.get("ownNames", ())), tuple(found.get("ownWords", ())))

    def canonical(self, company: Column) -> Column:
        """The canonical name of a company: its alias's, else its own, trimmed; null counts as blank."""
        raw = F.trim(F.coalesce(company, F.lit("")))
        if not self.aliases:
            return raw
        table = F.create_map(*[F.lit(x) for k, v in self.aliases.items() for x in (plain_text(k), v)])
        return F.coalesce(F.try_element_at(table, plain_key(raw)), raw)

    def is_own(self, canonical: Column) -> Column:
        """Whether a canonical name is the host's: by itself or by one of its words."""
        words = F.array(*[F.lit(plain_text(w)) for w in self.own_words]) if self.own_words else F.array().cast("array<string>")
        return (canonical != "") & (canonical.isin(list(self.own_names)) | F.arrays_overlap(F.split(plain_key(canonical), " "), words))

    def matches(self, company: Column, wanted: str) -> Column:
        """Whether a company meets a filter: by a part of its text, or by its canonical name; an empty filter is met by all."""
        wanted = wanted.strip()
        if not wanted:
            return F.lit(True)
        aliases = {plain_text(k): v for k, v in self.aliases.items()}
        name = aliases.get(plain_text(wanted), wanted)
        own = self.canonical(company)
        return F.contains(F.lower(F.trim(F.coalesce(company, F.lit("")))), F.lit(wanted.lower())) | (own == name) | F.contains(plain_key(own), F.lit(plain_text(name)))


def identities(sessions: DataFrame, rules: CompanyRules) -> DataFrame:
    """``(company, canonical, key, own, sessions)`` of every spelling that isn't blank, with the sessions that have it."""
    s = current_sessions(sessions.select("id", F.col("speakers.company").alias("companies")))
    d = s.select("id", F.explode(F.array_distinct("companies")).alias("company")).select("id", F.trim("company").alias("company")).filter("company <> ''")
    counted = d.groupBy("company").agg(F.count_distinct("id").alias("sessions"))
    named = counted.withColumn("canonical", rules.canonical(F.col("company")))
    return named.select("company", "canonical", plain_key(F.col("canonical")).alias("key"), rules.is_own(F.col("canonical")).alias("own"), "sessions")


def ranking(sessions: DataFrame, rules: CompanyRules, least: int = 2, limit: int = 120) -> DataFrame:
    """``(company, sessions)``: canonical companies but the host's by the number of sessions that they speak in.

    A company counts once per session, however many spellings it has there. Ties by name.
    """
    s = current_sessions(sessions.select("id", F.col("speakers.company").alias("companies")))
    d = s.select("id", F.explode(F.array_distinct(F.transform("companies", rules.canonical))).alias("company"))
    counted = d.filter((F.col("company") != "") & ~rules.is_own(F.col("company"))).groupBy("company").agg(F.count("*").alias("sessions"))
    return counted.filter(F.col("sessions") >= least).orderBy(F.col("sessions").desc(), "company").limit(limit)


def distinct_count(sessions: DataFrame, rules: CompanyRules) -> DataFrame:
    """How many canonical companies speak, exactly, in all and without the host's."""
    names = sessions.filter("id is not null").select(F.explode("speakers.company").alias("c")).select(rules.canonical(F.col("c")).alias("company")).filter("company <> ''").distinct()
    return names.agg(F.count("*").alias("companies"), F.count_if(~rules.is_own(F.col("company"))).alias("other_companies"))


def speaking(sessions: DataFrame, rules: CompanyRules, wanted: str) -> DataFrame:
    """``(id, title)`` of sessions with a speaker whose company meets the filter."""
    met = F.exists("speakers.company", lambda c: rules.matches(c, wanted))
    return current_sessions(sessions.filter(met).select("id", "title"))
