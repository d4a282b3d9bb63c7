"""Rule classifiers generated from tables: ladders, evidence tests, scored buckets and labels carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.catalog import current_sessions
from almanac.operators.rollup import mapping

# Words by which a text counts as being about AI, as substrings and as whole words.
AI_PARTS = ["vector search", "model", "agent", "prompt", "inference", "feature store", "speech interface", "moderation", "retrieval"]
AI_WORDS = ["ai", "ml", "agents?", "models?", "prompts?", "inference"]
# Themes in the order in which they are tried, each with the words that decide for it.
THEMES = [
    ("Security", "security|zero-trust|access reviews?|fraud|key rotation|tenant isolation"),
    ("Data", "data|warehouse|streaming|query|feature stores?|schema"),
    ("Infra", "placement|capacity|caching|storage|incident|on-call|disaster"),
    ("Applied AI", "agents?|prompts?|vector search|model|inference|speech|moderation"),
    ("App dev", "code review|developer portals?|release trains?|services"),
]
# Topics that speak for an audience.
AUDIENCES = {"developers": "Developers", "app dev": "Developers", "hands-on": "Developers", "security": "Sec pros", "networking": "Infra/Ops", "infrastructure": "Infra/Ops", "storage": "Infra/Ops", "databases": "Data pros", "data": "Data pros", "analytics": "Data pros", "leaders": "Leaders", "executive": "Leaders", "startups": "Leaders"}


def ladder(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern occurs between word boundaries."""
    out = F
    for label, pattern in rules:
        out = out.when(F.regexp_like(text, F.lit(rf"(?i)\b(?:{pattern})\b")), label)
    return out.otherwise(default)


def has_part(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts occurs, inside words too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def has_word(text: Column, words: list[str]) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:" + "|".join(words) + r")\b"))


def audience(topics: Column) -> Column:
    """The audience with most topics; General if topics speak for three or more and five or more count, or for none; ties by name."""
    tags = F.filter(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.try_element_at(mapping(AUDIENCES), F.lower(F.trim(t)))), lambda x: x.isNotNull())
    kinds = F.array_sort(F.array_distinct(tags))
    scored = F.transform(kinds, lambda k: F.struct((-F.size(F.filter(tags, lambda t: t == k))).alias("score"), k.alias("name")))
    best = F.array_min(scored)["name"]
    return F.when((F.size(tags) >= 5) & (F.size(kinds) >= 3), "General").otherwise(F.coalesce(best, F.lit("General")))


def classified(sessions: DataFrame, *more: str) -> DataFrame:
    """Every current session with the labels of the rules and why, and further columns asked for."""
    text = F.concat_ws(" ", "title", "description")
    ai, sure = has_part(text, AI_PARTS), has_word(text, AI_WORDS)
    theme = ladder(text, THEMES, "Business")
    out = current_sessions(sessions.select("id", *more, F.when(ai, "AI").otherwise("Not AI").alias("ai_focus"), sure.alias("sure"), theme.alias("theme"), audience(F.col("topics")).alias("audience")))
    return out.withColumn("reasoning", F.concat_ws("; ", F.concat(F.lit("theme "), "theme"), F.when(F.col("sure"), "named as such")))


def reclassified(labelled: DataFrame) -> DataFrame:
    """A second pass that is the same when repeated: App dev with a sure AI word becomes Applied AI, unless it is Infra."""
    applied = (F.col("theme") == "App dev") & F.col("sure")
    return labelled.withColumn("theme", F.when(applied, "Applied AI").otherwise(F.col("theme")))


def carried_over(sessions: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior labels by url where they are, else those of the rules; a Not AI that the text contradicts is redone.

    prior: ``(url, labels)``; of several rows with a url the greatest labels count; urls that are gone are dropped.
    """
    known = prior.filter("url <> ''").groupBy("url").agg(F.max("labels.theme").alias("old_theme"), F.max("labels.ai_focus").alias("old_focus"))
    rules = classified(sessions, "url").withColumnRenamed("ai_focus", "new_focus").withColumnRenamed("theme", "new_theme")
    d = rules.join(known, "url", "left")
    redo = F.col("old_focus").isNull() | (F.col("old_focus") == "") | ((F.col("old_focus") == "Not AI") & F.col("sure"))
    return d.select("id", F.when(redo, F.col("new_focus")).otherwise(F.col("old_focus")).alias("ai_focus"), F.when(redo, F.col("new_theme")).otherwise(F.col("old_theme")).alias("theme"), redo.alias("redone"))


def pending(sessions: DataFrame, prior: DataFrame) -> DataFrame:
    """Sessions whose url has no labels yet."""
    s = current_sessions(sessions.select("id", "url"))
    return s.join(prior.filter("labels is not null and labels.theme <> ''").select("url"), "url", "left_anti")


def access_rules(docs: DataFrame) -> DataFrame:
    """What party invitations say of access, food and place, by the first rule that fits."""
    d = docs.filter("source = 'party_invite' and text is not null")
    access = ladder(F.col("text"), [("list", "rsvp|list closes"), ("badge", "bring your badge"), ("open", "open to all|walk-ins?")], "unknown")
    food = ladder(F.col("text"), [("vegetarian", "vegetarian"), ("food", "food|dinner|snacks"), ("drinks", "drinks|music")], "none")
    place = F.regexp_extract("text", r"(?:at|in) the ([A-Z][\w']+(?: & [A-Z]\w+)?(?: [A-Z]\w+)?)", 1)
    return d.select("doc_id", access.alias("access"), food.alias("food"), F.nullif(place, F.lit("")).alias("place"))


def external_labels(rows: DataFrame, classify, schema: str) -> DataFrame:
    """Labels by a client outside Spark, in batches: ``classify`` maps a pandas frame to one that fits ``schema``.

    The client is a parameter; offline, ``classified`` gives labels by rule.
    """
    return rows.mapInPandas(lambda batches: (classify(b) for b in batches), schema)
