"""Variant spellings of organisations and persons.

A spelling is a bag of tokens, without legal forms, titles and remarks. Tokens that are alike are found by a prefix-filtered
set-similarity join on their q-grams, rarest first. Spellings meet through an index of single tokens and of two at once,
in which those alike are looked up too, so that none is left out, however frequent its tokens are. They are verified by a
soft similarity of all their tokens in which each weighs by its counted rarity: tokens are paired if they are equal,
differ by slips of the hand, or one is short for the other; what both have left over tells them apart. Spellings that
merely lack something, or have an initial for it, join an entity only if a single one fits.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import strip_white
from almanac.operators.components import connected_components
from almanac.session import written

#: Letters from which on a token may have one slip, and two; two spellings may differ by SLIPS altogether.
ONE_SLIP, TWO_SLIPS, SLIPS = 4, 8, 2
#: Length of the q-grams by which tokens with one slip and with two are joined.
GRAMS = {1: 2, 2: 3}
#: Least soft similarity of two spellings of which none lacks anything, and of what a fuller one has equal, or but for slips, in one that does.
SOFT, PART = 0.75, 0.25
#: A spelling is sought by one token if at most so many spellings have it or one alike, else by two at once. Links don't depend on it.
HOT = 20

# What stands in for a missing name or organisation.
STAND_INS = frozenset("independent|self|self employed|selfemployed|freelance|freelancer|unknown|none|null|na|n a|tba|tbd|tbc|speaker tba|speaker tbd|speaker|guest|guest speaker|to be announced|to be confirmed|to be determined|various|anonymous|undisclosed|company|test|moderator|retired|stealth|stealth startup|unaffiliated|private|no company|not applicable|panel|panelist".split("|"))
# Legal forms and fillers in names of organisations.
LEGAL = frozenset("ltd limited inc incorporated corp corporation co company llc llp lp plc gmbh mbh ag kg se sa sas sarl spa srl bv nv ab as oy oyj pty pte kk the of and group holding holdings".split())
# Titles, degrees and remarks beside a person's name.
TITLES = frozenset("dr prof professor mr mrs ms mx miss sir dame dipl ing phd mba md msc bsc ma ba jr sr ii iii iv esq cpa pe rn remote hybrid virtual they them she her he his him".split())
# Common short forms of given names that aren't their beginnings; a parameter of the operators.
SHORT_FORMS = {
    "abigail": "gail", "agnes": "nessie", "alexander": "sandy sasha xander", "alexandra": "lexi sandra sasha", "albert": "al bert", "alfred": "al fred", "andrew": "andy drew", "anthony": "tony", "augustus": "gus", "beatrice": "trixie", "benjamin": "ben benny", "catherine": "cathy kate katie kitty", "charles": "charlie chuck", "charlotte": "charlie lottie", "christina": "chrissy tina", "christine": "chris tina", "christopher": "kit topher", "daniel": "danny", "david": "dave", "deborah": "debbie", "dimitri": "dima mitya", "dmitri": "dima mitya", "dorothy": "dolly dot dottie", "edgar": "ed", "edmund": "ed ned ted", "edward": "ed eddie ned ted teddy", "edwin": "ed", "eleanor": "ellie nell nora", "elizabeth": "bess beth betsy betty eliza libby lisa liz lizzie", "emmanuel": "manny", "eugene": "gene", "florence": "flo flossie", "frances": "fanny frankie", "francesca": "frankie", "francis": "frank", "frederick": "fritz", "gabriel": "gabe", "gerald": "jerry", "giovanni": "gianni nino", "giuseppe": "beppe peppe", "gregory": "greg", "harold": "hal harry", "heinrich": "heiner heinz", "helen": "nell", "henrietta": "etta hetty", "henrik": "henk rik", "henry": "hal hank harry", "ignacio": "nacho", "isabella": "bella izzy", "ivan": "vanya", "jacob": "jake", "james": "jamie jim jimmy", "janet": "jan", "jennifer": "jen jenny", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "jo joe joey", "joshua": "josh", "katherine": "kat kate kathy katie kitty", "lawrence": "larry laurie", "leonard": "len lenny", "leticia": "letty tish", "ludwig": "lutz", "madeleine": "maddie", "margaret": "greta maggie meg peggy", "martha": "patty", "mary": "molly polly", "matilda": "tilly", "matthew": "matt", "maximilian": "max", "michael": "mick mickey mike", "mikhail": "misha", "nathaniel": "nate", "nicholas": "nick nicky", "nikolai": "kolya", "oluwaseun": "seun", "patricia": "patty tricia trish", "patrick": "paddy", "peter": "pete", "rebecca": "becky", "richard": "dick rick", "robert": "bob bobby bert rob robbie", "ronald": "ron", "rosemary": "romy", "samantha": "sammy", "samuel": "sammy", "sebastian": "basti seb", "sophia": "fia", "stephanie": "steffi", "stephen": "steve", "susan": "sue susie", "susanna": "sanna sue susie", "theodora": "dora thea", "theodore": "ted teddy theo", "theresa": "tess terry", "thomas": "tom tommy", "ursula": "ulla uschi", "victoria": "tori vicky", "vincent": "vinnie", "virginia": "ginny", "vladimir": "vova", "walter": "wally", "wilhelm": "willi", "william": "bill billy liam will", "yevgeny": "zhenya", "zachary": "zack", "zofia": "zosia",
}


def plain(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def tokens_of(s: str) -> list[str]:
    """Runs of letters and digits, without what stands in brackets; hyphens and apostrophes inside words join."""
    s = re.sub(r"\([^)]*\)", " ", plain(s))
    s = re.sub(r"\bs\.\s?a\.|\bl\.l\.c\.|\bp\.l\.c\.", " ", s)
    return re.findall(r"[^\W_]+", re.sub(r"(?<=\w)['’-](?=\w)", "", s))


def slips(a: str, b: str, most: int) -> int:
    """Letters left out, put in or replaced and neighbours swapped to make a of b; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row_before = row, before
        row = [i]
        for j, y in enumerate(b, 1):
            least = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if row_before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, row_before[j - 2] + 1)
            row.append(least)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


def slips_allowed(n: int) -> int:
    return 0 if n < ONE_SLIP else 1 if n < TWO_SLIPS else 2


def shortens(a: str, b: str) -> bool:
    """Whether a is the beginning of b, or its consonants with few vowels, and clearly shorter."""
    if not 3 <= len(a) <= 8 or len(a) >= len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return b.startswith(a) or sum(c in "aeiou" for c in a[1:]) * 3 <= len(a) and all(c in rest for c in a)


@functools.lru_cache(100_000)
def full_names(token: str) -> frozenset[str]:
    """The given names that a token may stand for by the table of short forms, itself included; a slip in a long one is allowed."""
    near = {f for f in SHORT_FORMS if f == token or (len(token) >= 6 and len(f) >= 6 and slips(f, token, 1) <= 1)}
    return frozenset({token} | near | {f for f, xs in SHORT_FORMS.items() if token in xs.split()})


def alike(a: str, b: str, name: bool) -> tuple[float, int, bool]:
    """How alike two tokens are, the slips between them, and whether one is only an initial; 0 if they aren't alike."""
    if a == b:
        return 1.0, 0, False
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        fits = name and len(other) > 1 and any(f[0] == one for f in full_names(other))
        return (0.9 if fits else 0.0), 0, fits
    most = slips_allowed(min(len(a), len(b)))
    n = slips(a, b, most) if most else 1
    if n <= most:
        return 1 - n / max(len(a), len(b)), n, False
    short = shortens(a, b) or shortens(b, a) or (name and bool(full_names(a) & full_names(b)))
    return (0.9 if short else 0.0), 0, False


def _joined(t: list[str], w: list[float]):
    """The tokens as they are, and with each two neighbours of more than one letter written as one word; with the place of that word, else -1."""
    yield t, w, -1
    for k in range(len(t) - 1):
        if len(t[k]) > 1 and len(t[k + 1]) > 1:
            yield [*t[:k], t[k] + t[k + 1], *t[k + 2 :]], [*w[:k], max(w[k], w[k + 1]), *w[k + 2 :]], k


def _paired(a: list[str], wa: list[float], b: list[str], wb: list[float], name: bool, joined: tuple[int, int]):
    """Tokens paired best first: soft similarity, what either has left over, slips, whether a or b has an initial for a name,
    and the places in a and b of those that are equal or differ by slips only.

    A word that was joined is never short for another one, nor the other way round.
    """
    options = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s, n, first = alike(x, y, name)
            if s and (n or x == y or (i != joined[0] and j != joined[1])):
                options.append((s * (wa[i] + wb[j]), s, n, first, i, j))
    options.sort(key=lambda o: (o[1] < 1, o[3], -o[0], o[4], o[5]))  # equal ones first, initials last
    left, right, total, count, short_a, short_b, firm = set(range(len(a))), set(range(len(b))), 0.0, 0, False, False, []
    for gain, _, n, first, i, j in options:
        if i in left and j in right:
            left.remove(i)
            right.remove(j)
            total += gain
            count += n
            short_a |= first and len(a[i]) == 1
            short_b |= first and len(b[j]) == 1
            if n or a[i] == b[j]:
                firm.append((i, j))
    return total, left, right, count, short_a, short_b, firm


def verdict(kind: str, a: list[str], wa: list[float], b: list[str], wb: list[float]) -> tuple[str, bool]:
    """``same``, ``a`` or ``b`` lacks something (``a-`` or ``b-``), has an initial for it (``a.`` or ``b.``) or ``other``; and whether without slips."""
    for lone, many, code in ((a, b, "a-"), (b, a, "b-")):
        if kind == "company" and len(lone) == 1 and len(many) > 2 and lone[0] == "".join(t[0] for t in many):
            return code, True
    best = ("other", False)
    rank = {"other": 0, "a-": 1, "b-": 1, "a.": 2, "b.": 2, "same": 3}
    pairs = [(x, u, b, wb, (k, -1)) for x, u, k in _joined(a, wa)] + [(a, wa, y, v, (-1, k)) for y, v, k in list(_joined(b, wb))[1:]]
    for x, u, y, v, joined in pairs:
        total, left, right, count, short_a, short_b, firm = _paired(x, u, y, v, kind == "name", joined)
        # Beginnings, short forms and initials alone, without a token in common, link nothing.
        if not firm or count > SLIPS or (short_a and short_b):
            continue
        # A middle initial that the other spelling has nothing for tells nothing.
        if not right and len(x) - len(left) > 1:
            left = {i for i in left if len(x[i]) > 1}
        if not left and len(y) - len(right) > 1:
            right = {j for j in right if len(y[j]) > 1}
        mine, theirs = sum(u), sum(v)
        code = "other"
        if not left and not right:
            whole = mine + theirs - sum(w for t, w in zip([*x, *y], [*u, *v]) if len(t) == 1)
            code = ("a." if short_a else "b." if short_b else "same") if total >= SOFT * whole else "other"
        elif not left and not short_b and count <= 1:
            code = "a-" if sum(v[j] for _, j in firm) >= PART * theirs else "other"
        elif not right and not short_a and count <= 1:
            code = "b-" if sum(u[i] for i, _ in firm) >= PART * mine else "other"
        if code[1:] == "." and count > 1:
            code = "other"
        if (rank[code], count == 0) > (rank[best[0]], best[1]):
            best = (code, count == 0)
    return best


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, spelling in zip(pdf["kind"], pdf["spelling"]):
            tokens = tokens_of(spelling)
            if tokens and " ".join(re.findall(r"[^\W_]+", plain(spelling))) not in STAND_INS:
                tokens = [t for t in tokens if t not in (LEGAL if kind == "company" else TITLES)] or tokens
                rows.append((kind, spelling, tokens, [x + y for x, y in zip(tokens, tokens[1:])]))
        yield pd.DataFrame(rows, columns=["kind", "spelling", "tokens", "glued"])


def spellings(sessions: DataFrame) -> DataFrame:
    """``(kind, spelling)``: every distinct company and name without white space around it; blank ones don't count."""
    people = sessions.select(F.explode("speakers").alias("s"))
    both = people.select(F.explode(F.array(F.struct(F.lit("company").alias("kind"), F.col("s.company").alias("spelling")), F.struct(F.lit("name").alias("kind"), F.col("s.name").alias("spelling")))).alias("x"))
    return both.select("x.kind", strip_white(F.col("x.spelling")).alias("spelling")).filter("spelling <> ''").distinct()


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The q-grams of tokens; a token of just TWO_SLIPS letters has both kinds, as its partner may be shorter."""
    for pdf in batches:
        rows = []
        for kind, token, glued in zip(pdf["kind"], pdf["token"], pdf["glued"]):
            padded, n = f"^{token}$", len(token)
            for most, q in GRAMS.items():
                if (ONE_SLIP <= n <= TWO_SLIPS) if most == 1 else n >= TWO_SLIPS:
                    rows += [(kind, token, glued, n, most, g) for g in {padded[k : k + q] for k in range(len(padded) - q + 1)}]
        yield pd.DataFrame(rows, columns=["kind", "token", "glued", "size", "most", "gram"])


def near_tokens(tokens: DataFrame) -> DataFrame:
    """``(kind, x, y)`` in both directions of different tokens alike but for slips; tokens: ``(kind, token, glued)``, of which one isn't glued.

    A slip changes at most q + 1 of a token's q-grams. So tokens with as many slips as their length allows share one of
    the rarest (q + 1) * slips + 1 q-grams of each, and only these are joined, among tokens of a length that is near
    enough.
    """
    grams = tokens.mapInPandas(_grams, "kind string, token string, glued boolean, size int, most int, gram string")
    counts = grams.groupBy("kind", "most", "gram").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("kind", "most", "token").orderBy("often", "gram"))
    kept = F.when(F.col("most") == 1, GRAMS[1] + 2).otherwise(2 * (GRAMS[2] + 1) + 1)
    prefix = written(grams.join(counts, ["kind", "most", "gram"]).withColumn("place", place).filter(F.col("place") <= kept).select("kind", "most", "gram", "size", "token", "glued"))
    a = prefix.filter("not glued").select("kind", "most", "gram", "size", F.col("token").alias("x"), F.explode(F.array(*[F.lit(k) for k in range(-2, 3)])).alias("more"))
    a = a.filter(F.abs("more") <= F.col("most")).withColumn("size", F.col("size") + F.col("more"))
    b = prefix.select("kind", "most", "gram", "size", F.col("token").alias("y"), F.col("glued").alias("gy"))
    once = (F.col("x") < F.col("y")) | (F.col("gy") & (F.col("x") != F.col("y")))
    close = F.levenshtein("x", "y", 4).between(0, 2 * F.col("most"))
    found = a.join(b, ["kind", "most", "gram", "size"]).filter(once & close).select("kind", "x", "y").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            most = [slips_allowed(min(len(x), len(y))) for x, y in zip(pdf["x"], pdf["y"])]
            good = pdf[[slips(x, y, m) <= m for x, y, m in zip(pdf["x"], pdf["y"], most)]]
            yield good
            yield good.rename(columns={"x": "y", "y": "x"})

    return written(found.mapInPandas(verify, found.schema))


def weighed(forms: DataFrame, near: DataFrame) -> DataFrame:
    """Adds ``weights`` to ``(form, kind, tokens)``: of each token 1 / (1 + ln n), if n forms have it or a token alike.

    So a slip in a frequent word doesn't make it a rare one, and a weight depends on no other count.
    """
    own = forms.select("kind", "form", F.posexplode("tokens").alias("at", "token"))
    counts = own.groupBy("kind", "token").agg(F.count_distinct("form").alias("n"))
    others = near.join(counts.select("kind", F.col("token").alias("y"), "n"), ["kind", "y"]).groupBy("kind", F.col("x").alias("token")).agg(F.sum("n").alias("more"))
    soft = counts.join(others, ["kind", "token"], "left").select("kind", "token", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    each = own.join(soft, ["kind", "token"]).groupBy("form", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "token", "n"))).alias("t"))
    return each.select("form", "kind", F.transform("t", lambda t: t["token"]).alias("tokens"), F.transform("t", lambda t: (1 / (1 + F.log(t["n"].cast("double"))))).alias("weights"), F.transform("t", lambda t: t["n"]).alias("counts"))


def _initials(token: str, kind: str) -> set[str]:
    """The letters that may stand for a token: only names have initials."""
    return {f[0] for f in full_names(token)} if kind == "name" and len(token) > 1 else set()


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The index of spellings: every token and every two neighbours in one word (beside ``*``), and any two of these at once.

    A name's tokens also stand under their initials (``^``), a company of three tokens or more under all of them in one (``@``).
    """
    for pdf in batches:
        rows = []
        for form, kind, tokens in zip(pdf["form"], pdf["kind"], pdf["tokens"]):
            tokens, keys = list(tokens), set()
            under = [[t, *("^" + c for c in _initials(t, kind))] for t in tokens]
            glued = [(k, [x + y]) for k, (x, y) in enumerate(zip(tokens, tokens[1:])) if len(x) > 1 and len(y) > 1]
            keys |= {(x, "*") for part in [*under, *(g for _, g in glued)] for x in part}
            two = [(part, other) for j, part in enumerate(under) for other in under[:j]]
            two += [(g, other) for k, g in glued for j, other in enumerate(under) if j not in (k, k + 1)]
            keys |= {(max(x, y), min(x, y)) for part, other in two for x in part for y in other}
            if kind == "company" and len(tokens) > 2:
                keys.add(("@" + "".join(t[0] for t in tokens), "*"))
            rows += [(form, kind, *k) for k in sorted(keys)]
        yield pd.DataFrame(rows, columns=["form", "kind", "token", "beside"])


def _seeks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys under which a spelling finds every other in which all its tokens have partners.

    Tokens of more than one letter always have one then, and of several tokens two at least have. So one such token is
    enough, or two at once: the one that fewest spellings have, and the one with fewest tokens alike. What stands alone
    must be equal or differ by slips. known: of every token those alike, those of them that are close, and how many
    spellings have them.
    """
    for pdf in batches:
        rows = []
        for form, kind, tokens, known in zip(pdf["form"], pdf["kind"], pdf["tokens"], pdf["known"]):
            alike_, close, often = ({x["x"]: x[c] for x in known} for c in ("ys", "close", "n"))
            under = lambda t: [t, *(["^" + t] if kind == "name" else [])] if len(t) == 1 else alike_[t]  # noqa: B023, E731
            tokens, keys = list(tokens), set()
            for parts, _, _ in _joined(tokens, [0.0] * len(tokens)):
                words = sorted((t for t in parts if len(t) > 1), key=lambda t: (often[t], t))  # noqa: B023
                ones = [t for t in parts if len(t) == 1]
                if len(parts) == 1 or (words and often[words[0]] <= HOT):
                    keys |= {(x, "*") for x in (close[parts[0]] if len(parts) == 1 else alike_[words[0]])}
                    continue
                if len(words) > 1:
                    two = [(words[0], min(words[1:], key=lambda t: len(alike_[t])))]  # noqa: B023
                else:
                    two = [(x, y) for x in words for y in ones] or [(x, y) for j, x in enumerate(ones) for y in ones[:j]]
                keys |= {(max(x, y), min(x, y)) for s, t in two for x in under(s) for y in under(t)}
            if kind == "company" and len(tokens) == 1:
                keys.add(("@" + tokens[0], "*"))
            rows += [(form, kind, *k) for k in sorted(keys)]
        yield pd.DataFrame(rows, columns=["form", "kind", "token", "beside"])


def _full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(kind, token, f) for kind, token in zip(pdf["kind"], pdf["token"]) for f in full_names(token)]
        yield pd.DataFrame(rows, columns=["kind", "x", "f"])


def _begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys that a token and a longer one it may be short for have in common: a beginning, or the first three letters in their order."""
    for pdf in batches:
        rows = []
        for kind, t in zip(pdf["kind"], pdf["token"]):
            if 3 <= len(t) <= 8:
                rows += [(kind, t, "=" + t, True), (kind, t, "~" + t[:3], True)]
            rows += [(kind, t, "=" + t[:k], False) for k in range(3, min(8, len(t) - 1) + 1)]
            first = {c: k for k, c in reversed(list(enumerate(t))) if k}
            last = {c: k for k, c in enumerate(t) if k}
            rows += [(kind, t, "~" + t[0] + c + d, False) for c, k in first.items() for d, m in last.items() if k < m]
        yield pd.DataFrame(rows, columns=["kind", "token", "key", "short"])


def alike_tokens(words: DataFrame, near: DataFrame) -> DataFrame:
    """``(kind, x, y, close)``: the tokens y that ``alike`` may pair with x, x itself and its initials among them, and whether
    they are equal or differ by slips; words: ``(kind, token, glued)``.

    A single letter has only itself here. Those alike but for slips are given; beginnings, short spellings and short forms of
    given names are joined by what they must have in common.
    """
    plain_ = words.filter("not glued").select("kind", "token")
    full = written(plain_.filter("kind = 'name' and length(token) > 1").mapInPandas(_full, "kind string, x string, f string"))
    called = full.join(full.withColumnRenamed("x", "y"), ["kind", "f"]).select("kind", "x", "y")
    initials = full.select("kind", "x", F.substring("f", 1, 1).alias("y"))
    begun = written(plain_.mapInPandas(_begun, "kind string, token string, key string, short boolean"))
    a, b = begun.filter("short").select("kind", "key", F.col("token").alias("x")), begun.filter("not short").select("kind", "key", F.col("token").alias("y"))
    # All letters of the short one occur in the longer one, which is cheaper to see than their order.
    met = a.join(b, ["kind", "key"]).filter("length(x) < length(y) and translate(x, y, '') = ''").select("kind", "x", "y").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = pdf[[shortens(x, y) for x, y in zip(pdf["x"], pdf["y"])]]
            yield good
            yield good.rename(columns={"x": "y", "y": "x"})[["kind", "x", "y"]]

    short = met.mapInPandas(verify, met.schema)
    own = words.select("kind", F.col("token").alias("x"), F.col("token").alias("y"))
    close, other = own.unionByName(near.select("kind", "x", "y")), called.unionByName(initials).unionByName(short)
    both = close.withColumn("close", F.lit(True)).unionByName(other.withColumn("close", F.lit(False)))
    return both.groupBy("kind", "x", "y").agg(F.max("close").alias("close"))


def compared(forms: DataFrame, near: DataFrame) -> DataFrame:
    """``(kind, a, b, code, exact)`` of all two forms whose verdict isn't ``other``, near holding all tokens alike but for slips; forms: of ``weighed``.

    Two forms are linked only if all tokens of one have partners in the other, or if it is short for its initials. So each
    form looks one or two of its tokens, and all alike, up in an index of all tokens of all forms, however many have them.
    """
    index = written(forms.mapInPandas(_keys, "form string, kind string, token string, beside string"))
    glued = F.expr("filter(transform(tokens, (t, i) -> if(length(t) > 1 and length(get(tokens, i + 1)) > 1, concat(t, get(tokens, i + 1)), null)), g -> g is not null)")
    words = forms.select("kind", F.explode("tokens").alias("token"), F.lit(False).alias("glued")).unionByName(forms.select("kind", F.explode(glued).alias("token"), F.lit(True).alias("glued")))
    often = index.filter("beside = '*'").groupBy("kind", F.col("token").alias("y")).agg(F.count("*").alias("n"))
    found = alike_tokens(written(words.groupBy("kind", "token").agg(F.min("glued").alias("glued"))), near).join(often, ["kind", "y"])
    known = found.groupBy("kind", F.col("x").alias("token")).agg(F.struct(F.first("x").alias("x"), F.collect_list("y").alias("ys"), F.collect_list(F.when(F.col("close"), F.col("y"))).alias("close"), F.sum("n").alias("n")).alias("known"))
    each = forms.select("form", "kind", F.explode(F.array_distinct(F.concat("tokens", glued))).alias("token")).join(known, ["kind", "token"])
    seeks = forms.select("form", "kind", "tokens").join(each.groupBy("form").agg(F.collect_list("known").alias("known")), "form").mapInPandas(_seeks, index.schema)
    key = F.xxhash64("kind", "token", "beside").alias("key")
    pairs = seeks.select(key, F.col("form").alias("f")).join(index.select(key, "form"), "key")
    pairs = pairs.filter("f <> form").select(F.least("f", "form").alias("a"), F.greatest("f", "form").alias("b")).distinct()
    side = lambda c: forms.select(F.col("form").alias(c), "kind", F.col("tokens").alias(f"t{c}"), F.col("weights").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b").withColumnRenamed("kind", "kb"), "b").filter("kind = kb").drop("kb")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [verdict(k, list(x), list(u), list(y), list(v)) for k, x, u, y, v in zip(pdf["kind"], pdf["ta"], pdf["wa"], pdf["tb"], pdf["wb"])]
            out = pd.DataFrame({"kind": pdf["kind"], "a": pdf["a"], "b": pdf["b"], "code": [c for c, _ in got], "exact": [e for _, e in got]})
            yield out[out["code"] != "other"]

    return both.mapInPandas(judge, "kind string, a string, b string, code string, exact boolean")


def grouped_spellings(sessions: DataFrame) -> DataFrame:
    """``(kind, entity, spelling)`` of every spelling; ``entity`` is one of the entity's spellings.

    Null and empty speakers, blank names and stand-ins don't count; a spelling that repeats counts once.
    """
    parsed = written(spellings(sessions).mapInPandas(_parse, "kind string, spelling string, tokens array<string>, glued array<string>"))
    forms = written(parsed.groupBy("kind", "tokens", "glued").agg(F.concat_ws(":", F.first("kind"), F.min("spelling")).alias("form")))
    words = forms.select("kind", F.explode("tokens").alias("token"), F.lit(False).alias("glued"))
    words = words.unionByName(forms.select("kind", F.explode("glued").alias("token"), F.lit(True).alias("glued")))
    near = near_tokens(words.groupBy("kind", "token").agg(F.min("glued").alias("glued")))
    links = written(compared(written(weighed(forms, near)), near))
    strong = connected_components(links.filter("code = 'same'").select("a", "b"))
    at = written(forms.select("form").join(strong.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("component", "form").alias("entity")))
    turned = F.substring("code", 1, 1) == "b"
    weak = links.filter("code <> 'same'").select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("less"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("more"), F.substring("code", 2, 1).alias("how"), "exact")
    # First what has an initial joins what has the name, then what lacks something joins what has it, the fullest last.
    for how in (".", "-", "-"):
        less, more = at.select(F.col("form").alias("less"), F.col("entity").alias("own")), at.select(F.col("form").alias("more"), "entity")
        met = weak.filter(F.col("how") == how).join(less, "less").join(more, "more").filter("own <> entity")
        met = met.groupBy("own", "exact").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
        first = met.groupBy("own").agg(F.max_by(F.struct("low", "high"), "exact").alias("m")).filter("m.low = m.high").select(F.col("own").alias("a"), F.col("m.low").alias("b"))
        # Of two that would join each other the greater one does; what is joined may itself join another.
        back = first.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("both"))
        one = first.join(back, ["a", "b"], "left").filter("both is null or a > b").select("a", "b")
        two = one.join(one.toDF("b", "c"), "b", "left").select(F.col("a").alias("entity"), F.coalesce("c", "b").alias("target"))
        at = written(at.join(two, "entity", "left").select("form", F.coalesce("target", "entity").alias("entity")))
    return parsed.drop("glued").join(forms, ["kind", "tokens"]).join(at, "form").select("kind", "entity", "spelling")


def p6_found(sessions: DataFrame) -> DataFrame:
    """``(kind, spelling_a, spelling_b)`` of two spellings of one entity, a < b by code points."""
    placed = written(grouped_spellings(sessions))
    a = placed.select("kind", "entity", F.col("spelling").alias("spelling_a"))
    b = placed.select("kind", "entity", F.col("spelling").alias("spelling_b"))
    return a.join(b, ["kind", "entity"]).filter("spelling_a < spelling_b").select("kind", "spelling_a", "spelling_b")
