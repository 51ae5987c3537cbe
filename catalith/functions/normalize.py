"""Value normalisation as column expressions: numbers, units, ranges, controlled vocabularies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions import vocabulary

_DASHES = "‐‑‒–—−"
_FRACTIONS = {"¼": "0.25", "½": "0.5", "¾": "0.75", "⅐": "0.142857", "⅓": "0.333333", "⅔": "0.666667", "⅛": "0.125", "⅜": "0.375", "⅝": "0.625", "⅞": "0.875"}
_NUMBER = r"([-+]?)\s*(?:(\d[\d,]*)\s+(\d+)\s*/\s*(\d+)|(\d+)\s*/\s*(\d+)|(\d[\d,]*(?:\.\d+)?))"


def plain(text: Column) -> Column:
    """Vulgar fractions as decimals, any dash as a hyphen, typographic quotes as straight ones."""
    for sign, value in _FRACTIONS.items():
        text = F.replace(text, F.lit(sign), F.lit(" " + value))
    return F.translate(text, _DASHES + "‘’“”", "-" * len(_DASHES) + "''\"\"")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def round_half_up(x: Column, places: int) -> Column:
    """Rounding that SQL engines agree on: away from zero at half, on the binary value."""
    scale = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_number(text: Column) -> Column:
    """First number: mixed fraction, fraction (by the usual denominators, else its left part), or decimal; commas are thousands."""

    def number(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit("")).try_cast("double")

    def fraction(a: Column, b: Column) -> Column:
        up, down = number(a), number(b)
        real = b.isin([str(d) for d in vocabulary.FRACTION_DENOMINATORS]) & (up > 0) & (up < down)
        return F.when(real, up / down)

    def read(t: Column) -> Column:
        part = [F.regexp_extract(t, _NUMBER, k) for k in range(8)]
        mixed, simple = fraction(part[3], part[4]), fraction(part[5], part[6])
        size = (
            F.when(part[2] != "", number(part[2]) + F.coalesce(mixed, F.lit(0.0)))
            .when(part[5] != "", F.coalesce(simple, number(part[5])))
            .otherwise(number(part[7]))
        )
        return F.when(part[1] == "-", -size).otherwise(size)

    return bound(plain(text), read)


def _alias_pattern(aliases: list[str]) -> str:
    longest = sorted(aliases, key=lambda a: (-len(a), a))
    words = [rf"(?<![a-z]){re.escape(a)}(?![a-z0-9])" if a[-1].isalnum() and a[0].isalnum() else re.escape(a) for a in longest]
    return "(" + "|".join(words) + ")"


def unit_in(lower: Column, family: str) -> Column:
    """Unit of the family whose longest alias a plain, lower-case text holds; digits may stand right before it."""
    rows = [r for r in vocabulary.unit_aliases() if r[0] == family]
    found = F.lit(None).cast("string")
    for alias, unit in sorted(((r[1], r[2]) for r in rows), key=lambda r: len(r[0])):
        found = F.when(lower.rlike(_alias_pattern([alias])), F.lit(unit)).otherwise(found)
    return found


def detect_unit(text: Column, family: str) -> Column:
    """Unit of the family whose longest alias the text holds."""
    return bound(F.lower(plain(text)), lambda t: unit_in(t, family))


#: What a unit takes off before it's scaled, and adds after.
_BEFORE, _AFTER = {"degF": 32.0}, {"K": -273.15}


def to_canonical(value: Column, unit: Column, family: str) -> Column:
    """Value in the family's canonical unit; unchanged where no unit is given."""
    return _scaled(value, unit, family, lambda v, factor, before, after: (v - before) * factor + after)


def from_canonical(value: Column, unit: Column, family: str) -> Column:
    """A canonical value in another unit of the family, as attributes have it whose unit isn't the canonical one."""
    return _scaled(value, unit, family, lambda v, factor, before, after: (v - after) / factor + before)


def _scaled(value: Column, unit: Column, family: str, change) -> Column:
    rows = F.create_map(*[F.lit(x) for name, factor in {r[2]: r[3] for r in vocabulary.unit_aliases() if r[0] == family}.items() for x in (name, factor)])

    def given(u: Column, table: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for name, x in table.items():
            out = F.when(u == name, x).otherwise(out)
        return out

    plain_unit = lambda u: F.struct(F.coalesce(F.try_element_at(rows, u), F.lit(1.0)).alias("factor"), given(u, _BEFORE).alias("before"), given(u, _AFTER).alias("after"))
    return bound(plain_unit(F.coalesce(unit, F.lit(""))), lambda s: change(value, s["factor"], s["before"], s["after"]))


def quantity(text: Column, family: str, target: str | None = None) -> Column:
    """Number in the family's canonical unit, or in ``target``, to six places, from text such as '1 1/2 in' or '65,000 A'."""
    canonical = to_canonical(parse_number(text), detect_unit(text, family), family)
    return round_half_up(from_canonical(canonical, F.lit(target), family) if target else canonical, 6)


def heal_split_numbers(text: Column) -> Column:
    """Join digits that a layout split: '2 15,719', '8 ,927' and '1, 200', but never two bare digit groups."""
    text = F.regexp_replace(text, r"(\d)\s+,(\d{3})(?!\d)", "$1,$2")
    text = F.regexp_replace(text, r"(\d),\s+(\d{3})(?!\d)", "$1,$2")
    return F.regexp_replace(text, r"(?<![\d,.])(\d)\s+(\d{1,2},\d{3})(?!\d)", "$1$2")


def split_range(text: Column) -> Column:
    """Struct of low and high for 'a to b', 'a...b', 'a ~ b' and the like; null where there is no range."""
    pattern = r"(?i)([-+]?\s*\d+(?:\.\d+)?)[^\d+-]*?(?:to|\.\.\.|\.\.|~|-|/|through)\s*([-+]?\s*\d+(?:\.\d+)?)"
    side = [F.regexp_replace(F.regexp_extract(plain(text), pattern, k), r"\s", "").try_cast("double") for k in (1, 2)]
    return F.when(side[0].isNotNull() & side[1].isNotNull(), F.struct(F.least(*side).alias("low"), F.greatest(*side).alias("high")))


def label(text: Column) -> Column:
    """A label without what stands in brackets, its words in lower case with single blanks."""
    text = F.regexp_replace(F.lower(text), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def enum_value(text: Column, allowed: list[str], synonyms: dict[str, str]) -> Column:
    """Controlled value: equal but for case, by synonym, by containment either way in order of the list, by longest synonym held; else null."""
    t = F.lower(F.trim(text))
    found = F.lit(None).cast("string")
    for key in sorted(synonyms, key=lambda k: (len(k), k)):
        if synonyms[key] in allowed:
            found = F.when(t.contains(key), F.lit(synonyms[key])).otherwise(found)
    for value in reversed(allowed):
        v = value.lower()
        found = F.when((t != "") & (t.contains(v) | F.lit(v).contains(t)), F.lit(value)).otherwise(found)
    for key, value in synonyms.items():
        if value in allowed:
            found = F.when(t == key, F.lit(value)).otherwise(found)
    for value in allowed:
        found = F.when(t == value.lower(), F.lit(value)).otherwise(found)
    return found


def certifications(text: Column, canonical: dict[str, str]) -> Column:
    """Array of certification labels, in order, each once: split, then exact form, longest form held as words, or the token."""
    tokens = F.filter(F.transform(F.split(text, r"[;,/•\n]|\s{2,}"), lambda t: F.trim(t)), lambda t: (t != "") & (F.length(t) <= 60))

    def one(token: Column) -> Column:
        t, out = F.lower(token), token
        for key in sorted(canonical, key=lambda k: (len(k), k)):
            out = F.when(t.rlike(rf"(^|[^a-z0-9]){re.escape(key)}([^a-z0-9]|$)"), F.lit(canonical[key])).otherwise(out)
        for key, value in canonical.items():
            out = F.when(t == key, F.lit(value)).otherwise(out)
        return out

    return F.array_distinct(F.transform(tokens, one))


def render_number(x: Column) -> Column:
    """Shortest form of six significant digits: 12.7, 20, 1e+06."""
    text = F.format_string("%.6g", x)
    short = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(x.isNotNull(), F.regexp_replace(short, r"\.(e|$)", "$1"))


def squeezed(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def quote_found(quote: Column, source: Column) -> Column:
    """Whether a source holds a quote: as it is, or, from eight characters, any window of 85 % of it. Both squeezed."""
    n = F.length(quote)
    width = F.greatest(F.floor(n * 0.85).cast("int"), F.lit(10))
    step = F.greatest(F.floor(width / 8).cast("int"), F.lit(1))
    starts = F.when((n >= 8) & (n > width), F.sequence(F.lit(0), n - width, step)).otherwise(F.array().cast("array<int>"))
    windows = F.exists(starts, lambda i: F.contains(source, F.substring(quote, i + 1, width)))
    return (quote != "") & (F.contains(source, quote) | windows)
