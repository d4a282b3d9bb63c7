"""Roll-ups of a catalogue's current sessions by label, company, speaker, word, hour and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import squeeze
from almanac.operators.catalog import band, current_sessions, last_rows, number

#: Words too common to count, short words that count all the same, and plurals that mean the singular. The
#: words of the host's own name are a parameter beside them.
STOP_WORDS = "the a an and or of to for in on at by with from into your you our their this that these those is are be as it its how why what when where who will can all more new using use build building through across after before about session sessions breakout breakouts learn join explore discover talks relevant attending shared contact may they".split()
SHORT_WORDS = ["ai", "ml", "go"]
PLURALS = {"llms": "llm", "models": "model", "meetups": "meetup", "agents": "agent", "databases": "database", "developers": "developer", "leaders": "leader", "scientists": "scientist", "analysts": "analyst", "managers": "manager", "architects": "architect", "teams": "team", "services": "service", "workshops": "workshop", "groups": "group", "applications": "application"}
HOST_WORDS = ("orvanta", "cloud", "summit")
#: How merged words are shown: both forms, initials in capitals.
LABELS = {one: f"{one}/{many}" if one != "llm" else "LLM/LLMs" for many, one in PLURALS.items()}
#: The order of themes and audiences among those equally frequent.
THEME_ORDER = ["App dev", "Applied AI", "Security", "Data", "Business", "Infra", "Other"]
AUDIENCE_ORDER = ["Leaders", "Sec pros", "Infra/Ops", "Data pros", "Developers"]
LEGAL_SUFFIX = r"\s+(?:inc|ltd|llc|corp|gmbh|co|plc|ag|limited|corporation)$"


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


SEATS = {"remaining": "remaining_capacity", "capacity": "capacity", "registrants": "registrant_count", "room": "room"}


def overlay(sessions: DataFrame, facts: DataFrame, columns: tuple[str, ...] = ("title", "session_category", "start_time_text", "end_time_text", "date_text", *SEATS)) -> DataFrame:
    """Current sessions with the seats, registrations and room of their latest snapshot row, where there is one.

    The right side wins in every column, blanks and nulls included; sessions without a row keep their own values. Only
    what ``columns`` asks for is read, on both sides.
    """
    own, seats = [c for c in columns if c not in SEATS], [c for c in columns if c in SEATS]
    fields = [SEATS[c] for c in seats]
    mine = lambda c: F.col(c) if c == "room" else number(F.col(c)).alias(c)
    s = current_sessions(sessions.select("id", *own, *map(mine, fields)))
    if not seats:
        return s
    latest = last_rows(facts, fields).groupBy("session_id").agg(F.max_by(F.struct(*fields), "order_index").alias("f"))
    joined = s.join(latest, s.id == latest.session_id, "left")
    return joined.select("id", *own, *[F.when(F.col("f").isNotNull(), F.col(f"f.{SEATS[c]}")).otherwise(F.col(SEATS[c])).alias(c) for c in seats])


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1))


def availability_counts(seats: DataFrame) -> DataFrame:
    """Sessions by availability band in all and by category, with the share of those known that are full."""
    b = band(F.col("remaining"))
    d = seats.select(F.explode(F.array(F.lit("(all)"), F.coalesce("session_category", F.lit("")))).alias("category"), b.alias("band"))
    known = F.count_if(F.col("band") != "unknown")
    return d.groupBy("category").agg(known.alias("known"), F.count_if(F.col("band") == "full").alias("full"), F.count_if(F.col("band") == "not-full").alias("not_full"), F.count_if(F.col("band") == "unknown").alias("unknown")).withColumn("full_pct", percent(F.col("full"), F.col("known")))


def category_fullness(seats: DataFrame) -> DataFrame:
    """Categories ranked by the share of full sessions; those without a full one are left out."""
    d = availability_counts(seats).filter("category <> '(all)' and full > 0").select("category", "full", "known", F.round(F.col("full") / F.col("known"), 6).alias("share"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.col("share").desc(), F.col("full").desc(), "category")))  # rows: categories


def label_counts(sessions: DataFrame) -> DataFrame:
    """How often each label of each facet occurs; blank labels and the audience General don't count."""
    s = current_sessions(sessions.select("id", "llm.ai_focus", "llm.theme", "llm.audience"))
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("label")) for f in ("ai_focus", "theme", "audience")])).alias("x")
    return s.select(facets).select("x.*").filter("label <> '' and not (facet = 'audience' and label = 'General')").groupBy("facet", "label").agg(F.count("*").alias("n"))


def label_places(sessions: DataFrame) -> DataFrame:
    """Themes within each focus, and audiences within each theme, ranked by sessions and then in their fixed order.

    ``(level, parent, label, n, place)``. Labels that the order doesn't have are left out.
    """
    s = current_sessions(sessions.select("id", "llm.ai_focus", "llm.theme", "llm.audience"))
    pair = lambda level, parent, label, order: F.struct(F.lit(level).alias("level"), F.col(parent).alias("parent"), F.col(label).alias("label"), F.array_position(F.array(*map(F.lit, order)), F.col(label)).alias("at"))
    d = s.select(F.explode(F.array(pair("theme", "ai_focus", "theme", THEME_ORDER), pair("audience", "theme", "audience", AUDIENCE_ORDER))).alias("x")).select("x.*")
    counted = d.filter("parent <> '' and at > 0").groupBy("level", "parent", "label", "at").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("level", "parent").orderBy(F.col("n").desc(), "at"))  # as many rows as labels
    return counted.select("level", "parent", "label", "n", place.alias("place"))


def type_and_tag_counts(sessions: DataFrame, tags: int = 20) -> DataFrame:
    """``(kind, name, n, place)``: all categories, and the ``tags`` commonest topics, by sessions; ties by name."""
    s = current_sessions(sessions.select("id", "session_category", "topics"))
    topics = F.transform(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name")))
    d = s.select(F.explode(F.concat(F.array(F.struct(F.lit("type").alias("kind"), F.col("session_category").alias("name"))), topics)).alias("x")).select("x.*")
    counted = d.filter("name <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "name")))
    return ranked.filter((F.col("kind") == "type") | (F.col("place") <= tags))


def flow_tree(sessions: DataFrame) -> DataFrame:
    """Sessions by focus, by theme within it and by audience within both; General audiences are left out at that level."""
    s = current_sessions(sessions.filter("llm.ai_focus is not null").select("id", "llm.ai_focus", "llm.theme", "llm.audience"))
    rolled = s.groupingSets([["ai_focus"], ["ai_focus", "theme"], ["ai_focus", "theme", "audience"]], "ai_focus", "theme", "audience").agg(F.count("*").alias("n"), F.grouping_id("ai_focus", "theme", "audience").alias("g"))
    level = F.when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)
    return rolled.select("ai_focus", "theme", "audience", "n", level.alias("level")).filter("not (level = 3 and coalesce(audience, '') = 'General')")


def company_key(c: Column) -> Column:
    """A company's name as it is compared: lower case, and for &, letters and digits only, without a legal suffix."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), r"[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(plain), LEGAL_SUFFIX, "")


def speakers_of(sessions: DataFrame, *fields: str) -> DataFrame:
    """``(id, pos, *fields)``: one row per speaker, with the named fields only."""
    s = current_sessions(sessions.select("id", *[F.col(f"speakers.{f}").alias(f) for f in fields]))
    return s.select("id", F.posexplode(F.arrays_zip(*fields)).alias("pos", "s")).select("id", "pos", "s.*")


def company_counts(sessions: DataFrame, host: str = "orvanta", least: int = 2, limit: int = 120) -> DataFrame:
    """Sessions per company, each counted once a session; the host's own names are left out.

    ``company`` is the smallest spelling met. Companies with fewer than ``least`` sessions don't rank.
    """
    d = speakers_of(sessions, "company").withColumn("key", company_key(F.col("company"))).filter("key <> ''").filter(~F.array_contains(F.split("key", " "), host))
    counted = d.groupBy("key").agg(F.count_distinct("id").alias("sessions"), F.min("company").alias("company")).filter(F.col("sessions") >= least)
    return counted.orderBy(F.col("sessions").desc(), "key").limit(limit)


def company_sessions(sessions: DataFrame, least: int = 2) -> DataFrame:
    """Companies with the sorted ids of their sessions."""
    d = speakers_of(sessions, "company").withColumn("key", company_key(F.col("company"))).filter("key <> ''")
    return d.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).filter(F.size("ids") >= least).select("key", F.size("ids").cast("bigint").alias("sessions"), F.array_join("ids", ",").alias("ids"))


def distinct_companies(sessions: DataFrame, host: str = "orvanta") -> DataFrame:
    """How many different companies speak, exactly, in all and without the host's."""
    d = speakers_of(sessions, "company").select(company_key(F.col("company")).alias("key")).filter("key <> ''")
    own = F.array_contains(F.split("key", " "), host)
    return d.agg(F.count_distinct("key").alias("companies"), F.count_distinct(F.when(~own, F.col("key"))).alias("other_companies"))


def speaker_rollup(sessions: DataFrame, least: int = 2) -> DataFrame:
    """Speakers met more than once, every occurrence counted, with the first company met in the order of ids."""
    d = speakers_of(sessions, "name", "company").withColumn("name", squeeze(F.col("name"))).filter("name <> ''")
    company = F.min_by("company", F.when(F.coalesce(F.trim("company"), F.lit("")) != "", F.struct("id", "pos")))
    return d.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("sessions"), company.alias("company")).filter(F.col("n") >= least)


def word_stats(sessions: DataFrame, limit: int = 96, host: tuple[str, ...] = HOST_WORDS) -> DataFrame:
    """The commonest words of titles, descriptions, topics and companies, with how they are shown and how many sessions have them."""
    none = F.array().cast("array<string>")
    text = F.lower(F.concat_ws(" ", "title", "description", F.array_join(F.coalesce("topics", none), " "), F.array_join(F.transform(F.coalesce("speakers.company", none), lambda x: F.coalesce(x, F.lit(""))), " ")))
    s = current_sessions(sessions.select("id", text.alias("text")))
    found = s.select("id", F.explode(F.regexp_extract_all("text", F.lit("[a-z][a-z0-9+.-]*"), F.lit(0))).alias("raw"))
    word = F.regexp_replace("raw", r"[^a-z0-9+#]+$", "")
    word = F.coalesce(F.try_element_at(mapping(PLURALS), word), word)
    kept = found.select("id", word.alias("word")).filter(((F.length("word") >= 3) | F.col("word").isin(SHORT_WORDS)) & ~F.col("word").isin([*STOP_WORDS, *host]))
    top = kept.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("id").alias("sessions")).orderBy(F.col("n").desc(), "word").limit(limit)
    return top.select("word", F.coalesce(F.try_element_at(mapping(LABELS), F.col("word")), F.col("word")).alias("label"), "n", "sessions")


def clock(c: Column) -> Column:
    """Minutes since midnight of a time like '2:15 PM'; null otherwise."""
    p = r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]\s*$"
    return F.regexp_extract(c, p, 1).try_cast("int") % 12 * 60 + F.regexp_extract(c, p, 2).try_cast("int") + F.when(F.lower(F.regexp_extract(c, p, 3)) == "p", 720).otherwise(0)


def scheduled(seats: DataFrame) -> DataFrame:
    """Sessions with a day and both times: the first hour they cover and the one after the last, at least one later."""
    d = seats.withColumn("sm", clock(F.col("start_time_text"))).withColumn("em", clock(F.col("end_time_text"))).filter("date_text <> '' and sm is not null and em is not null")
    return d.withColumn("sh", F.floor(F.col("sm") / 60).cast("int")).withColumn("eh", F.greatest(F.floor(F.col("sm") / 60) + 1, F.ceil(F.col("em") / 60)).cast("int"))


def hour_buckets(seats: DataFrame) -> DataFrame:
    """Per day and covered hour: sessions, registrations and the best attended session, ties to the smaller id."""
    d = scheduled(seats).select("date_text", "id", F.coalesce("registrants", F.lit(0)).alias("reg"), F.explode(F.sequence("sh", F.col("eh") - 1)).alias("hour"))
    return d.groupBy("date_text", "hour").agg(F.count("*").alias("sessions"), F.sum("reg").alias("reserved"), F.min_by("id", F.struct(-F.col("reg"), "id")).alias("top_id"), F.max("reg").alias("top_registrants"))


def hourly_overview(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per delivered snapshot, day and covered hour: sessions, registrations and the best attended session.

    Day, start and registrations are those of the snapshot; the end, which snapshots lack, and the number of speakers
    come from the session's current record, and a session without one lasts an hour. Ties of attendance go to the smaller
    id. Rows are combined per session and snapshot before they move, then per snapshot, day and hour.
    """
    rows = last_rows(facts, ["date_text", "start_time_text", "registrant_count"])
    extra = current_sessions(sessions.select("id", "end_time_text", F.size(F.coalesce("speakers.name", F.array().cast("array<string>"))).alias("people")))
    d = rows.join(extra, rows.session_id == extra.id, "left").withColumn("registrants", F.col("registrant_count"))
    start = clock(F.col("start_time_text"))
    timed = d.withColumn("sm", start).withColumn("em", F.coalesce(clock(F.col("end_time_text")), start + 60)).filter("date_text <> '' and sm is not null")
    first = F.floor(F.col("sm") / 60).cast("int")
    hours = timed.withColumn("hour", F.explode(F.sequence(first, F.greatest(first + 1, F.ceil(F.col("em") / 60).cast("int")) - 1)))
    reg = F.coalesce("registrants", F.lit(0))
    best = F.min_by("session_id", F.struct(-reg, "session_id"))
    return hours.groupBy("order_index", "date_text", "hour").agg(F.count("*").alias("sessions"), F.sum(reg).alias("reserved"), best.alias("top_id"), F.max(reg).alias("top_registrants"), F.sum(F.coalesce("people", F.lit(0))).alias("speakers"))


def heat_rows(seats: DataFrame, most: int = 1000) -> DataFrame:
    """Per day and starting hour: seats taken by sessions that start then and aren't too small or too large; hours without any are hidden."""
    d = scheduled(seats).filter((F.col("registrants") > 1) & (F.col("registrants") < most))
    return d.groupBy("date_text", F.col("sh").alias("hour")).agg(F.sum("registrants").alias("taken"), F.count("*").alias("sessions"), F.min_by("id", F.struct(-F.col("registrants"), "id")).alias("top_id")).filter("taken > 0")


def heat_order(seats: DataFrame) -> DataFrame:
    """Sessions of each day and starting hour in the order in which a cell lists them.

    By registrations, then how full, then the fewest seats left, missing ones last each, then title and id.
    """
    fill = F.when((F.col("capacity") > 0) & F.col("registrants").isNotNull(), F.round(100.0 * F.col("registrants") / F.col("capacity"), 6))
    order = [F.col("registrants").desc_nulls_last(), fill.desc_nulls_last(), F.col("remaining").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("id").asc()]
    d = scheduled(seats).select("date_text", F.col("sh").alias("hour"), "id", "title", "registrants", "capacity", "remaining")
    return d.select("date_text", "hour", "id", F.row_number().over(Window.partitionBy("date_text", "hour").orderBy(*order)).alias("place"))


def fill_scale(seats: DataFrame) -> DataFrame:
    """How full each session is, and its registrations against the most of its room class, both in 0..100."""
    ratio = F.when((F.col("capacity") > 0) & F.col("registrants").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.col("registrants") / F.col("capacity"))))
    fill = F.coalesce(ratio, F.when(F.col("remaining") <= 0, 100.0).when(F.col("remaining") <= 10, 92.0))
    d = seats.filter("registrants > 1 and registrants < 1000").withColumn("is_small", F.coalesce(F.col("capacity") < 100, F.lit(True)))
    most = d.groupBy("is_small").agg(F.max("registrants").alias("most"))
    d = d.join(F.broadcast(most), "is_small")  # two rows
    return d.select("id", F.round(fill, 4).alias("fill_pct"), (F.col("registrants") > F.col("capacity")).alias("overbooked"), "is_small", F.round(F.greatest(F.lit(8.0), F.least(F.lit(100.0), 100.0 * F.col("registrants") / F.col("most"))), 4).alias("marker_pct"))


def time_bounds(seats: DataFrame) -> DataFrame:
    """The first and last quarter hour that any session touches, within 0..95, and the range of hours."""
    d = seats.select(clock(F.col("start_time_text")).alias("sm"), clock(F.col("end_time_text")).alias("em"))
    lo, hi = F.min(F.floor(F.col("sm") / 15)), F.greatest(F.max(F.floor(F.col("sm") / 15)), F.max(F.ceil(F.col("em") / 15)))
    clamp = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(95), F.coalesce(c, F.lit(d)))).cast("int")
    return d.agg(clamp(lo, 0).alias("first_slot"), clamp(hi, 95).alias("last_slot"), F.floor(F.min("sm") / 60).cast("int").alias("first_hour"), (F.floor(F.max("sm") / 60) + 1).cast("int").alias("end_hour"))


def facet_values(sessions: DataFrame) -> DataFrame:
    """The distinct values of each facet with their sessions: days, categories, rooms and topics."""
    s = current_sessions(sessions.select("id", "date_text", "session_category", "room", "topics"))
    facets = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("date_text", "session_category", "room")])
    topics = F.transform(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("topic").alias("facet"), t.alias("value")))
    return s.select("id", F.explode(F.concat(facets, topics)).alias("x")).select("id", "x.*").filter("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def group_total(companies: DataFrame, names: list[str]) -> DataFrame:
    """The places and sum of named members within a limited ranking; a member that doesn't rank counts nothing."""
    ranked = companies.withColumn("place", F.row_number().over(Window.orderBy(F.col("sessions").desc(), "key")))  # as many rows as the ranking's limit
    own = ranked.filter(F.col("key").isin(names))
    return own.select("key", "place", "sessions", F.sum("sessions").over(Window.partitionBy()).alias("total"))


def day_key(date_text: Column) -> Column:
    """The bucket of a day: its ISO date, UNSCHEDULED when blank, else the text in lower case with dashes."""
    date = F.try_to_timestamp(F.regexp_replace(date_text, r"^\w+, ", ""), F.lit("MMMM d, yyyy"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(date_text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.coalesce(date_text, F.lit("")) == "", "UNSCHEDULED").otherwise(F.coalesce(F.date_format(date, "yyyy-MM-dd"), slug))


def day_buckets(sessions: DataFrame) -> DataFrame:
    s = current_sessions(sessions.select("id", "room", day_key(F.col("date_text")).alias("bucket")))
    return s.groupBy("bucket").agg(F.count("*").alias("sessions"), F.count_distinct("room").alias("rooms"), F.min("id").alias("first_id"))


def affiliation_counts(sessions: DataFrame) -> DataFrame:
    """Speaker occurrences by affiliation and company of the earlier year; blank companies and stand-ins don't count."""
    once = sessions.filter("code is not null").groupBy("code").agg(F.max("speakers").alias("speakers"))
    d = once.select(F.explode("speakers").alias("s")).select(F.coalesce("s.affiliation", F.lit("")).alias("affiliation"), squeeze(F.col("s.company")).alias("company"))
    return d.filter("company <> '' and company <> 'Independent'").groupBy("affiliation", "company").agg(F.count("*").alias("n"))


def insights(sessions: DataFrame, seats: DataFrame) -> DataFrame:
    """Headline figures in one long table: ``(section, name, value)``."""
    parts = [
        availability_counts(seats).filter("category = '(all)'").select(F.lit("availability").alias("section"), F.explode(F.create_map(F.lit("known"), F.col("known"), F.lit("full"), F.col("full"), F.lit("unknown"), F.col("unknown"))).alias("name", "value")),
        label_counts(sessions).select(F.concat(F.lit("label:"), "facet").alias("section"), F.col("label").alias("name"), F.col("n").alias("value")),
        company_counts(sessions, limit=8).select(F.lit("company").alias("section"), F.col("key").alias("name"), F.col("sessions").alias("value")),
        distinct_companies(sessions).select(F.lit("companies").alias("section"), F.lit("other").alias("name"), F.col("other_companies").alias("value")),
        word_stats(sessions, 18).select(F.lit("word").alias("section"), F.col("word").alias("name"), F.col("n").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
