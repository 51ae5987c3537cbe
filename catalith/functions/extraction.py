"""Column expressions that read attribute values and hints out of texts, tables and file names."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalith.functions.normalize import plain, split_range, squeezed

# Parts of file names that tell what an image shows, in order.
SHOT_HINTS = [
    ("dimension", "dimension"), ("dim-", "dimension"), ("drawing", "line_drawing"), ("line", "line_drawing"), ("schematic", "line_drawing"),
    ("wiring", "line_drawing"), ("hero", "hero"), ("main", "hero"), ("primary", "hero"), ("angle", "angle"), ("alt", "angle"), ("side", "angle"),
    ("lifestyle", "lifestyle"), ("install", "lifestyle"), ("application", "lifestyle"),
]
# Parts of a first header cell that mark a table with one product a row.
KEY_COLUMN_HINTS = ["part", "catalog", "cat no", "model", "order", "mpn", "sku", "item", "type", "code", "reference"]
# Words for true and false.
TRUE_WORDS = ["yes", "true", "y", "1", "included", "standard"]
FALSE_WORDS = ["no", "false", "n", "0", "not included", "optional"]


def _any_of(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


def shot_type(file_name: Column, black_white: Column, saturation: Column, background: Column) -> Column:
    """What an image shows: by its name, else by shares of black and white, mean saturation and background; null statistics decide nothing."""
    guess = F.when((black_white > 0.82) & (saturation < 12), "line_drawing").when((background == "white") & (saturation >= 12), "hero").when(background == "non-white", "lifestyle").otherwise("unknown")
    for hint, kind in reversed(SHOT_HINTS):
        guess = F.when(F.contains(F.lower(file_name), F.lit(hint)), F.lit(kind)).otherwise(guess)
    return guess


def table_orientation(rows: Column) -> Column:
    """'variant_matrix' if an array of rows has a header of three or more cells whose first names a key, else 'label_value'."""
    header = F.get(rows, F.lit(0))
    first = F.lower(F.trim(F.get(header, F.lit(0))))
    matrix = (F.size(rows) >= 2) & (F.size(header) >= 3) & first.rlike(_any_of(KEY_COLUMN_HINTS))
    return F.when(F.coalesce(matrix, F.lit(False)), "variant_matrix").otherwise("label_value")


def prose_value(text: Column, alias: str) -> Column:
    """Value that prose gives for an alias of four characters or more; null if none.

    The text is split at the alias. What follows, to the end of the line or clause, is a value if a colon, a
    dash between blanks (that is no minus sign) or a gap of two blanks leads it; where no place has that, the
    first number that follows directly.
    """
    if len(alias) < 4:
        return F.lit(None).cast("string")
    pieces = F.split(text, rf"(?i)(?<!\w){re.escape(alias)}")
    tails = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda t: F.substring_index(F.substring_index(F.substring_index(t, "\n", 1), ";", 1), "|", 1))

    def led(t: Column) -> Column:
        rest = F.ltrim(t)
        dash = F.left(rest, F.lit(1))
        gap = F.length(t) - F.length(rest)
        after = F.substring(rest, 2, 1 << 20)
        spaced = (gap > 0) & F.startswith(after, F.lit(" "))
        return F.when(dash == ":", after).when(spaced & dash.isin("–", "—"), after).when(spaced & (dash == "-") & ~F.ltrim(after).rlike("^[0-9]"), after).when(gap >= 2, rest)

    def number(t: Column) -> Column:
        return F.when(F.startswith(t, F.lit(" ")) & F.ltrim(t).rlike("^[-+−]?[0-9]"), t)

    def clean(t: Column) -> Column:
        return F.nullif(F.rtrim(F.regexp_replace(F.trim(F.left(F.ltrim(t), F.lit(90))), r"[.,;]+$", "")), F.lit(""))

    def first(read) -> Column:
        return F.get(F.filter(F.transform(tails, lambda t: clean(read(t))), lambda t: t.isNotNull()), F.lit(0))

    return F.coalesce(first(led), first(number))


#: What may stand between a label and its value.
_MARKS = [":", " – ", " — ", " - ", "  "]


def label_and_value(clause: Column) -> Column:
    """Struct of label and value of 'label: value', 'label - value' or 'label  value', split at the first such mark; a dash before a digit is a sign."""
    t = F.trim(clause)
    places = []
    for mark in _MARKS:
        at = F.instr(t, mark)
        after = F.ltrim(F.substring(t, at + len(mark), F.length(t)))
        sign = F.lit(mark == " - ") & after.rlike("^[0-9]")
        places.append(F.struct(F.when((at > 1) & ~sign, at).alias("at"), F.trim(F.left(t, at - 1)).alias("label"), after.alias("value")))
    return F.array_min(F.filter(F.array(*places), lambda x: x["at"].isNotNull()))


def labelled_value(text: Column, labels: list[str], accepts: Callable[[Column], Column]) -> Column:
    """Value of the first line or clause whose label ends in one of ``labels`` and whose value is accepted."""
    pairs = F.transform(F.split(text, "[\n;|]"), label_and_value)
    known = lambda x: F.lower(x["label"]).rlike(f"({'|'.join(labels)})$")
    return F.get(F.filter(pairs, lambda x: x.isNotNull() & known(x) & accepts(x["value"])), F.lit(0))["value"]


def truth(text: Column) -> Column:
    """Boolean of a word, null for other words."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def bounded_text(text: Column, longest: int) -> Column:
    """Text with single blanks, cut to a length with dots to show it."""
    t = F.trim(F.regexp_replace(plain(text), r"\s+", " "))
    return F.when(F.length(t) > longest, F.concat(F.rtrim(F.left(t, F.lit(longest))), F.lit("..."))).otherwise(t)


def bound_error(value: Column, low: Column, high: Column) -> Column:
    """Why a number is implausible, null if it isn't or there are no bounds."""
    return F.when(value < low, "below minimum").when(value > high, "above maximum")


def range_observations(code_low: Column, code_high: Column, text: Column) -> Column:
    """Array of (code, value): both ends of a range; to be exploded."""
    ends = split_range(text)
    pair = F.array(F.struct(code_low.alias("code"), ends["low"].alias("value")), F.struct(code_high.alias("code"), ends["high"].alias("value")))
    return F.when(ends.isNotNull(), pair)


def highlight_offset(quote: Column, text: Column) -> Column:
    """Zero-based place in a text where a quote starts, comparing letters and digits only; of long quotes the first 60 % will do; null if absent."""
    needle = squeezed(quote)
    start = F.greatest(F.floor(F.length(needle) * 0.6).cast("int"), F.lit(1))
    whole, most = F.instr(squeezed(text), needle), F.instr(squeezed(text), F.substring(needle, F.lit(1), start))
    found = F.when(needle == "", F.lit(0)).when(whole > 0, whole).when(F.length(needle) > 20, most).otherwise(0)
    places = F.filter(F.transform(F.split(F.lower(text), ""), lambda c, i: F.when(c.rlike("[a-z0-9]"), i)), lambda i: i.isNotNull())
    return F.when(found > 0, F.get(places, found - 1))


def _completed(text: str) -> str:
    """Text with what a cut-off JSON value lacks at its end."""
    open_, quoted = [], False
    for token in re.findall(r'\\.|["{}\[\]]', text, re.S):
        if token == '"':
            quoted = not quoted
        elif not quoted and token in "{[":
            open_.append("}" if token == "{" else "]")
        elif not quoted and open_ and token == open_[-1]:
            open_.pop()
    if quoted:
        text += '"'
    text = re.sub(r"[\s,]+$", "", text)
    return text + (" null" if text.endswith(":") else "") + "".join(reversed(open_))


def _lenient(text: str | None) -> str | None:
    if not text:
        return None
    fenced = re.search(r"```(?:json)?(.*?)(?:```|$)", text, re.S) if text.lstrip().startswith("```") else None
    body = (fenced[1] if fenced else text).strip()
    value = re.search(r"[{\[].*", body, re.S)
    if not body.startswith(("{", "[")) and value:
        body = value[0][: max(value[0].rfind("}"), value[0].rfind("]")) + 1] or value[0]
    for attempt in (body, _completed(re.sub(r",\s*([}\]])", r"\1", body))):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """Compact JSON from a fenced, trailed or cut-off one; null where there is none."""
    return texts.map(_lenient, na_action="ignore")
