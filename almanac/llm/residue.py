"""Template residue, filler, error pages and script notices, by a naive Bayes classifier learnt from positive and unlabelled passages.

Texts are cut into passages (lines and sentences). Passages in which a trusted pattern stands are positive, all others
unlabelled. Expectation-maximisation estimates how far unlabelled passages belong to either class and the words of each
class. Every passage of every text is then scored, and a record is residue if one of its passages is.

What is written in quotes or code marks is only mentioned, so it counts as one mark and never as a trusted pattern.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import squeeze
from almanac.session import written

#: Features are counted in so many hash buckets: the size of the model, whatever the corpus.
BUCKETS = 1 << 20
#: Unlabelled passages at most that the classifier is fitted on, besides all trusted ones; all passages of all texts are scored.
FIT_UNLABELLED = 200_000
ROUNDS = 6
#: Weight, in passages, of the words' background in either class, so that rare words say little.
SMOOTHING = 40.0
PRIOR = 0.01
#: Neighbouring words say much the same, so log odds overstate: a passage is residue from MARGIN on, and the odds used in
#: fitting are those beyond it, divided by TEMPER.
MARGIN, TEMPER = 12.0, 3.0

#: Ways in which templates write a field, each with the mark that replaces it.
PLACEHOLDERS = (
    ("phdouble", r"\{\{\{?\s*[\w .|-]+\s*\}?\}\}"),
    ("phtag", r"\{%-?\s*[\w .|-]+\s*-?%\}"),
    ("phdollar", r"\$\{[\w .-]+\}"),
    ("pherb", r"<%=?\s*[\w .-]+\s*%>"),
    ("phmerge", r"\*\|[\w .:-]+\|\*"),
    ("phsquare", r"\[\[[\w .-]+\]\]"),
    ("phat", r"@@[\w .-]+@@"),
    ("phunder", r"__[A-Z][A-Z_]+__"),
    ("phpercent", r"%[A-Z][A-Z_]{2,}%"),
    ("phhash", r"#[A-Z][A-Z_]{2,}#"),
    ("phcurly", r"\{(?:\d{1,2}|[A-Za-z][A-Za-z_.-]*)\}"),
    ("phyour", r"<(?i:your|insert|enter)[ _][\w ]+>|<[A-Z]{3,}(?:[ _][A-Z]+)*>"),
    ("phinsert", r"\[(?i:insert|your|enter)[ _][\w ]+\]|\[(?:[A-Z]+[ _]){0,3}(?:NAME|TITLE|ROOM|HOST|COMPANY|SPONSOR|DATE|TIME|LINK|URL|TRACK|COUNT|ABSTRACT|ADDRESS|TOPIC|EVENT|SESSION|SPEAKER|VENUE|SEAT|SEATS|EMAIL|CITY|COUNTRY|PHONE|NUMBER|PRICE|TEXT|DESCRIPTION|BIO)\]"),
    ("phguillemet", r"«[\w.-]+(?: [\w.-]+){0,2}»"),
    ("phprintf", r"(?<![\w%])%(?:s|d|\(\w+\)s|1\$s|@)(?!\w)"),
    ("phcross", r"\b[Xx]{3,}\b"),
    ("phobject", r"\[object [A-Z]\w+\]"),
    ("phnan", r"(?<!\w)-?(?:NaN|nan|NAN)(?=\s*(?:$|[,.;:)/%|!]| (?:seats?|of|min|left)\b))"),
    ("phundefined", r"\b(?:undefined|null)\b(?! [a-z]{3,} (?:of|in|for)\b)(?=\s*(?:$|[,.;:)(|/\]]|(?:undefined|null)\b|[a-z]{2} (?:undefined|null)\b))"),
    ("phnone", r"#?\bNone\b(?= (?:in|with|at|by|of) None\b)|(?<=\bNone (?:in|at|by|of|with) )None\b"),
    ("phdate", r"\bInvalid [Dd]ate\b|\b0000-00-00\b"),
)
#: What a passage must have for any of the placeholders to be in it.
MAYBE = r"[{$<*\[@%#«]|__|[Xx]{3}|(?i:nan)|undefined|null|None|[Dd]ate\b|0000"
#: Wordings of filler, error pages and script notices that are sure where they stand unquoted; those that begin a passage,
#: the ones whose case counts apart, and those that may stand anywhere, each with parts of which a passage must have one in lower case.
STARTS = (
    r"(?:todo|tbd|fixme)\b\s*:?",
    r"(?:http |error |status )*(?:code )?[45]\d\d\b\s*[-:.|]*\s*(?:error|not found|forbidden|bad|internal|service|gateway|unauthori|too many|access|page)",
    r"(?:fatal )?error\s*:",
    r"(?:oops|sorry about that|we(?:'|’)?re sorry|we are sorry|apologies|access denied|page not found|not found|forbidden|internal server error|bad gateway|service unavailable|something went wrong|session expired|request timed out)\b",
    r"(?:\w+ ){0,6}?(?:please |must |need to )(?:enable|activate|allow|unblock|turn on|switch on) (?:java ?script|js|scripts?|scripting|cookies)\b",
    r"(?:please )?(?:enable|activate|allow|unblock|turn on|switch on) (?:java ?script|js|scripts?|scripting)\b",
    r"(?:this|the|our) (?:\w+ ){1,3}?(?:requires?|needs?) (?:java ?script|js|scripts?|scripting)\b",
    r"noscript\b",
    r"(?:por favor,? |bitte |veuillez |s'il vous plaît )?(?:active|activez|activer|activar|ative|ativar|habilite|habilitez|habilitar|aktivieren|aktiviere)\b.{0,25}\bjava ?script\b",
    r"(?:página no encontrada|página não encontrada|seite nicht gefunden|page introuvable|page non trouvée|cette page est introuvable|(?:この)?ページが見つかりません|ページは存在しません)",
    r"(?:error|erreur|fehler|erro|エラー)\s*[45]\d\d\b",
    r"(?:texto de ejemplo|texto de exemplo|texte d'exemple|beispieltext|blindtext|mustertext|サンプルテキスト|ダミーテキスト)",
    r"(?:php )?(?:warning|notice|fatal error|parse error)\s*:.* on line \d+",
    r"File mentioned ?, line \d+",
    r"(?:too many requests|rate limit exceeded|bad request|unauthori[sz]ed|gateway time-?out)\b",
    r"(?:your|this|the) (?:session|login|token|link) (?:has )?(?:expired|timed out)\b",
    r"(?:scheduled )?(?:maintenance (?:is )?in progress|down for maintenance)\b",
    r"(?:checking|verifying) your (?:connection|browser|identity)\b",
    r"(?:secure connection failed|connection (?:refused|reset|timed out)|unknown session code|no results(?: found)?\.)",
    r"(?:we (?:can(?:'|’)?t|cannot|could not|couldn(?:'|’)?t) find|the (?:requested )?(?:page|session|url|resource) (?:you (?:are|were) looking for|you requested|was not found))",
    r"(?:type|enter|insert|add|write|paste|put) (?:your|the|a|some) (?:\w+ ){1,3}(?:here|in this box|in this field|below)\b",
    r"(?:to (?:view|see|use|open|load|continue)|for the full|for full|in order to|before|if nothing|the (?:\w+ ){1,3}(?:stays?|remains?|is) (?:blank|empty|hidden))\b.*\b(?:enable|activate|allow|unblock|turn on|switch on) (?:\w+ ){0,2}(?:java ?script|js|scripts?|scripting|cookies)\b",
    r"error (?:establishing|loading|connecting|while|occurred|in)\b",
    r"(?:loading|please wait)\W*$",
    r"if (?:nothing|no content|the page does not) (?:appears?|loads?|happens?)\b",
    r"(?:insert|add|put) (?:\w+ ){1,4}here\b",
    r"(?:\w+ ){1,3}goes here\b",
    r"(?:replace|change|edit) this (?:text|copy|title|description|paragraph)\b",
)
EXACT_STARTS = (
    r"Traceback \(most recent call last\)",
    r"[A-Za-z_.]*[a-z](?:Error|Exception)\b(?:\s*:|\s+at\b|$)",
)
ANYWHERE = (
    (("lorem",), r"(?i)\blorem ipsum\b"),
    ((" text",), r"(?i)\b(sample|placeholder|dummy) text \1 text\b"),
    (("script",), r"(?i)\bjava ?script (?:is|must be|needs to be|has to be) (?:disabled|required|enabled|turned|switched|activated)\b"),
    (("script",), r"(?i)\bscripts? (?:is|are) (?:blocked|disabled|turned off|switched off)\b"),
    (("script",), r"(?i)\bjava ?script\b.{0,20}\b(?:aktivieren|aktiviert|activado|activé|ativado|einschalten|necesario|nécessaire|necessário|erforderlich)\b"),
    (("script",), r"(?i)JavaScript.{0,6}(?:有効|オン|必要)"),
    (("(",), r"\bat\s+[\w.$]+\(\w+\.(?:java|js|py|kt|cs)(?::\d+)+\)"),
    (("unavailable", "offline", "down"), r"(?i)\b(?:service|site|page|server) (?:is )?(?:temporarily|currently) (?:unavailable|offline|down)\b"),
    (("phrepeat",), r"(?:^|\W)phrepeat\b"),
    (("cookies", "script"), r"(?i)\b(?:cookies|java ?script|scripts?) (?:and (?:cookies|java ?script|scripts?) )?(?:must|need to|have to|has to|should) be (?:turned|switched|enabled|allowed|activated)\b"),
    (('answer', 'respond', 'load'), r"(?i)\b(?:did not|didn(?:'|’)t|could not|failed to) (?:answer|respond|load)\b(?: in time| \(code)?"),
    (("blindtext", "dummy", "placeholder", "layout purposes"), r"(?i)\bblindtext\b|\b(?:dummy|placeholder) (?:text|copy|description|content|title)\b|\bfor layout purposes\b"),
    (("tbd", "tba", "tbc", "ship", "publish"), r"(?i)\b(?:text|title|copy|details|abstract|description|room|speaker|time) (?:is |are )?(?:tbd|tba|tbc)\b|\bdo not (?:ship|publish)\b"),
    (("foo bar", "asdf", "qwer"), r"(?i)\bfoo bar\b|\basdf\b|\bqwer(?:ty|tz)?\b"),
    (("",), r"^\W*(\w)\1{9,}\W*$"),
    (("を入力",), r"を入力してください"),
    (("browser",), r"(?i)\byour browser (?:is|does) (?:not supported|not support|out of date|too old|outdated)\b"),
)
#: Words that tell of such wordings instead of using them.
DISCUSSED = r"(?i)\b(?:explain(?:s|ed|ing)?|discuss(?:es|ed|ing)?|describe[sd]?|teach(?:es|ing)?|argue[sd]?|why|history of|(?:talk|session|workshop|lecture|essay|article|lesson)s? (?:on|about))\b"


def passages(text: Column) -> Column:
    """Lines and sentences of a text, without tags and escapes of white space, white space of any kind collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)</?(?:p|br|div|em|strong|b|i|span|h[1-6]|li|ul|a|html|body|title|center|hr|noscript)(?:\s[^<>]*)?/?>", " "), r"(?i)&nbsp;|&#160;|&#9;|[\x{A0}\t]", " ")
    plain = F.regexp_replace(plain, r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "")
    # A bounded number of repeats at a time: the matcher's stack grows with each.
    plain = F.regexp_replace(plain, r"(?i)\b(\p{L}{4,}+)\b(?:[.,]?\s+\1\b){2,40}[.,]?", " phrepeat ")
    return F.filter(F.transform(F.split(plain, r"[\r\n\x{2028}]+|(?<=[.!?])\s+(?![a-z])|(?<=。)"), squeeze), lambda p: p != "")


def marked(passage: Column) -> Column:
    """A passage in which mentions and placeholders are replaced by marks."""
    # A bare error object is no mention, though its names stand in quotes.
    has = lambda parts: functools.reduce(lambda a, b: a | b, [F.contains(passage, F.lit(x)) for x in parts])
    out = F.when(has("{"), F.regexp_replace(passage, r"(?i)^\W*\{\s*\"(?:error|errors|fault|exception)\"\s*:.*\}\s*$", " pherror ")).otherwise(passage)
    out = F.when(has("`\"“”„«"), F.regexp_replace(out, r"`[^`]*`|[\"“”„][^\"“”„]*[\"“”„]|«\s[^»]*»", " mentioned ")).otherwise(out)
    replaced = out
    for mark, pattern in PLACEHOLDERS:
        replaced = F.regexp_replace(replaced, pattern, f" {mark} ")
    return F.when(F.regexp_like(out, F.lit(MAYBE)), replaced).otherwise(out)


def trusted(mark: Column, low: Column) -> Column:
    """Whether a marked passage has a placeholder, or a sure wording without words that discuss it; ``low`` is it in lower case.

    Wordings that begin a passage are tried as one pattern; the others only on passages that have a part of them.
    """
    holds = F.contains(mark, F.lit(" ph")) & F.regexp_like(mark, F.lit(r"(?:^| )(?:" + "|".join(["pherror", *[m for m, _ in PLACEHOLDERS]]) + r") "))
    out = F.regexp_like(mark, F.lit(r"(?i)^\W*(?:" + "|".join(STARTS) + ")")) | F.regexp_like(mark, F.lit(r"^\W*(?:" + "|".join(EXACT_STARTS) + ")"))
    for parts, pattern in ANYWHERE:
        some = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in parts])
        out = out | (some & F.regexp_like(mark, F.lit(pattern)))
    return holds | (out & ~F.regexp_like(mark, F.lit(DISCUSSED)))


def features(low: Column) -> Column:
    """Hash buckets of the distinct words and neighbouring words of a passage in lower case; numbers are alike, other scripts go by character."""
    words = F.regexp_extract_all(F.regexp_replace(low, r"\p{N}+", "0"), F.lit(r"[a-zß-öø-\x{24F}\x{1E00}-\x{1EFF}'’]+|\p{N}|\p{L}|[:|?!]"), F.lit(0))
    padded = F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))
    pairs = F.zip_with(padded, F.slice(padded, F.lit(2), F.size(padded)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.transform(F.concat(words, pairs), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def scorer(weights, bias: float):
    """A function over batches that adds ``score``, the log odds of each passage's ``features``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for pdf in batches:
            lists = list(pdf.pop("features"))
            sums = np.full(len(lists), bias)
            lengths = np.array([len(x) for x in lists], np.int64)
            full = np.flatnonzero(lengths)
            if len(full):
                flat = np.concatenate([lists[i] for i in full])
                sums[full] += np.add.reduceat(w[flat], np.cumsum([0, *lengths[full]])[:-1])
            yield pdf.assign(score=sums)

    return run


def _weights(counts: pd.DataFrame, docs_p: float, docs_n: float) -> np.ndarray:
    """Log ratios by bucket, each class smoothed towards the background, so that unseen buckets weigh nothing."""
    w = np.zeros(BUCKETS)
    p, n = counts["p"].to_numpy(), counts["n"].to_numpy()
    base = (p + n) / (docs_p + docs_n)
    w[counts["bucket"].to_numpy()] = np.log((p + SMOOTHING * base + 1e-9) / (docs_p + SMOOTHING)) - np.log((n + SMOOTHING * base + 1e-9) / (docs_n + SMOOTHING))
    return w


def fit(found: DataFrame) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias; found: ``(doc_id, place, features, sure)`` of all passages.

    The features of all trusted passages are counted once; of the unlabelled ones a part chosen by hash, bounded by
    FIT_UNLABELLED, is fitted on and counts for all of them. What comes to the driver each round is at most one row per
    bucket. Without trusted passages nothing is found.
    """
    spark = found.sparkSession
    totals = found.agg(F.count_if("sure").alias("p"), F.count_if(~F.col("sure")).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return np.zeros(BUCKETS), -1.0
    known = found.filter("sure").select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").cast("double").alias("p"), F.lit(0.0).alias("n")).toPandas()
    pick = F.pmod(F.xxhash64("doc_id", "place", F.lit("fit")), F.lit(1_000_003)) / 1_000_003.0
    sample = written(found.filter(~F.col("sure") & (pick < min(1.0, FIT_UNLABELLED / totals["n"]))).select("features"))
    size = sample.count()
    if not size:
        return np.zeros(BUCKETS), -1.0
    scale = totals["n"] / size
    rated = sample.select("features", F.lit(0.0).alias("r"))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        mass = rated.select(F.explode("features").alias("bucket"), "r").groupBy("bucket").agg((F.sum("r") * scale).alias("p"), (F.sum(1 - F.col("r")) * scale).alias("n")).toPandas()
        extra = float(rated.agg(F.sum("r")).first()[0] or 0.0)
        mass = pd.concat([known, mass]).groupby("bucket", as_index=False).sum()
        weights = _weights(mass, totals["p"] + extra * scale, (size - extra) * scale)
        bias = float(np.log(max(PRIOR, extra / size)) - np.log(1 - min(0.5, extra / size)))
        run = scorer(spark.sparkContext.broadcast(weights), bias)
        scored = sample.mapInPandas(lambda it, run=run: ((y := x.copy(), next(run(iter([y]))).assign(features=x["features"]))[1] for x in it), "score double, features array<int>")
        rated = scored.select("features", (1 / (1 + F.exp((MARGIN - F.col("score")) / TEMPER))).alias("r"))
    return weights, bias


def residue_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, sure, score)`` of every passage of every text; null, empty and blank texts have none.

    ``score`` is the log odds for residue; repeated rows give repeated passages; other columns are ignored. The
    features of all passages are written once to the shared folder, for the fit and the scores alike.
    """
    cut = docs.select("doc_id", F.posexplode(passages(F.col("text"))).alias("place", "passage")).withColumn("mark", marked(F.col("passage"))).withColumn("low", F.lower("mark"))
    found = written(cut.select("doc_id", "place", features(F.col("low")).alias("features"), trusted(F.col("mark"), F.col("low")).alias("sure")))
    weights, bias = fit(found)
    run = scorer(docs.sparkSession.sparkContext.broadcast(weights), bias)
    return found.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place int, sure boolean, score double")


def residue_records(docs: DataFrame) -> DataFrame:
    """``(doc_id, score, passages)`` of every record with residue: its best passage's score and how many passages are residue."""
    bad = residue_passages(docs).filter(F.col("score") > MARGIN)
    return bad.groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("passages"))


def p9_found(docs: DataFrame) -> DataFrame:
    return residue_records(docs).select("doc_id")
