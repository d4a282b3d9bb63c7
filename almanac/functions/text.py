"""Text normalisation as column expressions that stay in the JVM."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any kind of white space: ASCII, the information separators, next line, and Unicode separators (no-break included).
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}]+"


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to one blank and removed at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def strip_white(c: Column) -> Column:
    """White space of any kind removed at the ends only."""
    return F.regexp_replace(c, rf"^{WHITE}|{WHITE}$", "")


def _named() -> Column:
    names = {**html.entities.name2codepoint, "apos": 39}
    return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])


def html_unescape(c: Column) -> Column:
    """HTML escapes (named with semicolon, decimal, hexadecimal) read as their characters, once; unknown ones stay.

    Names are also looked up in lower case, so that ``&AMP;`` of an upper-cased text is read too.
    """
    names = _named()

    def piece(x: Column) -> Column:
        body = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        number = (
            F.when(F.lower(F.substring(body, 1, 2)) == "#x", F.conv(F.substring(body, 3, 9), 16, 10).try_cast("int"))
            .when(F.substring(body, 1, 1) == "#", F.substring(body, 2, 9).try_cast("int"))
            .otherwise(F.coalesce(F.try_element_at(names, body), F.try_element_at(names, F.lower(body))))
        )
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
        return F.when(fits, F.concat(char, x.substr(F.length(body) + 2, F.length(x)))).otherwise(F.concat(F.lit("&"), x))

    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.contains(c, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(c)


def fold(c: Column) -> Column:
    """The form in which titles, rooms and the like are compared: unescaped, lower case, squeezed; blank is null."""
    return F.nullif(squeeze(F.lower(html_unescape(c))), F.lit(""))


def minutes_of_day(c: Column) -> Column:
    """Minutes since midnight of '2:15 PM', '02:15 p.m.', '2:15PM', '14:15' or '9 AM'; null if it isn't a time of day."""
    s = F.lower(squeeze(c))
    pattern = r"^(\d{1,2})(?:[:.h](\d{2}))?(?::\d{2})? ?([ap])?(?:\.? ?m\.?)?$"
    hour = F.regexp_extract(s, pattern, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(s, pattern, 2).try_cast("int"), F.lit(0))
    half = F.regexp_extract(s, pattern, 3)
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when((hour24 < 24) & (minute < 60), hour24 * 60 + minute)


def time_key(c: Column) -> Column:
    """A time of day however it is written, as text to compare; what isn't one is compared as folded text."""
    return F.coalesce(minutes_of_day(c).cast("string"), fold(c))
