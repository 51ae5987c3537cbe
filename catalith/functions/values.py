"""Normalisation of raw values by their attribute's definition, for all attributes in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import vocabulary
from catalith.functions.extraction import truth
from catalith.functions.normalize import bound, certifications, collapse, parse_number, plain, render_number, round_half_up, unit_in

#: Columns of a definition that ``normalized`` looks at; those that the rows lack count as null.
DEFINITION = {"datatype": "string", "cardinality": "string", "unit_family": "string", "canonical_unit": "string", "low": "double", "high": "double", "allowed": "array<string>", "max_length": "int", "pattern": "string"}


def _texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _any_unit(text: Column, family: Column) -> Column:
    """Unit of the row's own family."""
    def look(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in vocabulary.UNITS:
            out = F.when(family == name, unit_in(t, name)).otherwise(out)
        return out

    return bound(F.lower(plain(text)), look)


def _scales() -> Column:
    """Map from 'family unit' to factor, and what is taken off before and added after."""
    cells = []
    for family, units in vocabulary.UNITS.items():
        for unit, (factor, _) in units.items():
            scale, before, after = {"fahrenheit": (5 / 9, 32.0, 0.0), "kelvin": (1.0, 0.0, -273.15)}.get(factor, (factor, 0.0, 0.0))
            cells += [F.lit(f"{family} {unit}"), F.struct(F.lit(float(scale)).alias("factor"), F.lit(before).alias("before"), F.lit(after).alias("after"))]
    return F.create_map(*cells)


def _canonical(family: Column) -> Column:
    first = [x for name, units in vocabulary.UNITS.items() for x in (F.lit(name), F.lit(next(iter(units))))]
    return F.try_element_at(F.create_map(*first), family)


def number_value(raw: Column, family: Column, target: Column, low: Column, high: Column) -> Column:
    """Struct of value, unit, errors, notes and unit_assumed: the number in the attribute's unit, to six places.

    Without a unit the attribute's own is assumed, and a note says so; a value outside its plausible bounds is
    kept with an error.
    """
    def worked_out(x: Column) -> Column:
        found, wanted = x["unit"], F.coalesce(target, _canonical(family))
        own, other = (F.try_element_at(_scales(), F.concat_ws(" ", family, u)) for u in (found, wanted))
        changed = (((x["number"] - own["before"]) * own["factor"] + own["after"]) - other["after"]) / other["factor"] + other["before"]
        value = round_half_up(F.when(found.isNotNull(), F.coalesce(changed, x["number"])).otherwise(x["number"]), 6)
        return F.struct(x["number"].alias("number"), found.alias("found"), wanted.alias("wanted"), value.alias("value"))

    def told(x: Column) -> Column:
        assumed = x["number"].isNotNull() & x["found"].isNull() & family.isNotNull() & target.isNotNull()
        errors = _texts(
            F.when(x["number"].isNull(), F.format_string("could not parse a number from '%s'", raw)),
            F.when(x["value"] < low, F.format_string("%s is below the plausible minimum %s", render_number(x["value"]), render_number(low))),
            F.when(x["value"] > high, F.format_string("%s exceeds the plausible maximum %s", render_number(x["value"]), render_number(high))),
        )
        notes = _texts(
            F.when(x["found"] != x["wanted"], F.format_string("%s %s -> %s %s", render_number(x["number"]), x["found"], render_number(x["value"]), x["wanted"])),
            F.when(assumed, F.concat(F.lit("no unit found; assumed "), target)),
        )
        return F.struct(x["value"].alias("value"), F.when(x["number"].isNotNull(), target).alias("unit"), errors.alias("errors"), notes.alias("notes"), assumed.alias("unit_assumed"))

    unit = F.when(family.isNotNull(), _any_unit(raw, family))
    return bound(F.struct(parse_number(raw).alias("number"), unit.alias("unit")), lambda a: bound(worked_out(a), told))


def enum_choice(raw: Column, allowed: Column, learned: Column, synonyms: Column) -> Column:
    """Struct of value and note: equal but for case, by a learned synonym, by a built-in one, by containment either way, by the longest synonym held.

    allowed: array of values in order; learned and synonyms: maps from spelling to value.
    """
    token = F.trim(plain(raw))
    spelt = F.btrim(F.lower(token), F.lit(".,;:"))

    def choose(t: Column) -> Column:
        first = lambda test: F.get(F.filter(allowed, test), F.lit(0))
        legal = lambda v: F.when(F.array_contains(allowed, v), v)
        held = F.filter(F.map_entries(synonyms), lambda e: F.contains(t, e["key"]) & F.array_contains(allowed, e["value"]))
        longest = F.array_max(F.transform(held, lambda e: F.struct(F.length(e["key"]).alias("n"), e["value"].alias("v"))))["v"]
        steps = [
            (first(lambda a: F.lower(a) == t), None),
            (legal(F.try_element_at(learned, t)), "applied a learned mapping: '%s' -> '%s'"),
            (legal(F.try_element_at(synonyms, t)), "mapped '%s' -> '%s'"),
            (first(lambda a: F.contains(t, F.lower(a)) | F.contains(F.lower(a), t)), "matched '%s' -> '%s'"),
            (longest, "inferred '%s' -> '%s'"),
        ]
        out = F.struct(F.lit(None).cast("string").alias("value"), F.format_string("'%s' is not a legal value (allowed: %s...)", token, F.array_join(F.slice(allowed, 1, 6), ", ")).alias("note"))
        for value, note in reversed(steps):
            said = F.format_string(note, token, value) if note else F.lit(None).cast("string")
            out = F.when(value.isNotNull(), F.struct(value.alias("value"), said.alias("note"))).otherwise(out)
        return out

    return bound(spelt, choose)


def normalized(rows: DataFrame, synonyms: dict[str, str] | None = None, learned: Column | None = None, canonical: dict[str, str] | None = None) -> DataFrame:
    """Rows (code, raw and the columns of DEFINITION) with value_number, value_text, value_boolean, value_list, unit, errors, notes and unit_assumed.

    A null or blank raw value has the error 'empty value'. learned: a map column from spelling to value, of
    the row's code; canonical: certification labels; both maps and ``synonyms`` are those of the vocabulary if left out. An error leaves the value null, but for bounds and patterns.
    """
    for name, kind in DEFINITION.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    table = F.create_map(*[F.lit(x) for pair in (vocabulary.ENUM_SYNONYMS if synonyms is None else synonyms or {"": ""}).items() for x in pair])
    own = learned if learned is not None else F.lit(None).cast("map<string,string>")
    raw = F.col("raw").cast("string")
    empty = F.trim(F.coalesce(raw, F.lit(""))) == ""
    multi = F.coalesce(F.col("cardinality") == "multi", F.lit(False))
    none, text_array = F.lit(None), F.array().cast("array<string>")

    def result(number=none, text=none, boolean=none, values=none, unit=none, errors=text_array, notes=text_array, assumed=F.lit(False)) -> Column:
        return F.struct(number.cast("double").alias("value_number"), text.cast("string").alias("value_text"), boolean.cast("boolean").alias("value_boolean"), values.cast("array<string>").alias("value_list"), unit.cast("string").alias("unit"), errors.alias("errors"), notes.alias("notes"), assumed.alias("unit_assumed"))

    def several() -> Column:
        pieces = F.filter(F.transform(F.split(raw, r"[;,•\n]"), lambda t: F.trim(plain(t))), lambda t: t != "")
        values = F.when(F.col("code") == "certifications", certifications(raw, vocabulary.CERTIFICATIONS if canonical is None else canonical)).otherwise(pieces)
        return bound(values, lambda v: result(values=F.when(F.size(v) > 0, v), errors=_texts(F.when(F.size(v) == 0, F.lit("no values parsed")))))

    def text() -> Column:
        limit = F.col("max_length")

        def cut(t: Column) -> Column:
            longer = F.coalesce(F.length(t) > limit, F.lit(False)) & (limit > 0)
            shown = F.when(longer, F.concat(F.rtrim(F.left(t, limit)), F.lit("..."))).otherwise(t)
            return F.struct(shown.alias("shown"), longer.alias("longer"))

        def checked(x: Column) -> Column:
            wrong = F.col("pattern").isNotNull() & ~F.regexp_like(x["shown"], F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")")))
            return result(text=x["shown"], errors=_texts(F.when(wrong, F.format_string("'%s' does not match the required pattern %s", x["shown"], F.col("pattern")))), notes=_texts(F.when(x["longer"], F.format_string("truncated to %d characters", limit))))

        return bound(collapse(plain(raw)), lambda t: bound(cut(t), checked))

    number = bound(number_value(raw, F.col("unit_family"), F.col("canonical_unit"), F.col("low"), F.col("high")), lambda x: result(number=x["value"], unit=x["unit"], errors=x["errors"], notes=x["notes"], assumed=x["unit_assumed"]))
    choice = bound(enum_choice(raw, F.col("allowed"), own, table), lambda x: result(text=x["value"], errors=_texts(F.when(x["value"].isNull(), x["note"])), notes=_texts(F.when(x["value"].isNotNull(), x["note"]))))
    boolean = bound(truth(raw), lambda b: result(boolean=b, errors=_texts(F.when(b.isNull(), F.format_string("'%s' is not a boolean", raw)))))
    enum = (F.col("datatype") == "enum") & (F.size("allowed") > 0)
    found = F.when(empty, result(errors=F.array(F.lit("empty value")))).when(multi, several()).when(F.col("datatype") == "number", number).when(enum, choice).when(F.col("datatype") == "boolean", boolean).otherwise(text())
    # one generated row, so that the planner doesn't repeat the expression for each of its fields
    return rows.select("*", F.inline(F.array(found)))
