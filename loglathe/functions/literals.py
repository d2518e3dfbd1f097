"""Records are maps from field names to JSON literals: ``{"level": '"info"', "port": '80'}``.

A literal keeps a value's type, the text ``null`` is an explicit null, and a missing key is a missing
field.  Every operator is an expression over such a map, so a whole chain of them is one projection.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RECORD = "map<string,string>"


def _named(value):
    """What tells an argument of compiled(): a column by its tree, or None where that holds a table's own column."""
    if not isinstance(value, Column):
        return ("", value)
    tree = getattr(value, "_jc", None) and value._jc.node().normalized().toString()
    return None if not tree or "ExpressionColumnNode" in tree or ",Some(" in tree else ("column", tree)


def compiled(build: Callable) -> Callable:
    """Keeps the columns that a function builds of names, text and flat values: a chain of patterns or
    rules is put together once in a session, not once in a query.  Columns count as names where they
    are; what is built of a table's own column (``table["x"]``) isn't kept, since no other table has it."""
    known: dict = {}

    @functools.wraps(build)
    def wrapped(*args):
        session = SparkSession.getActiveSession()
        names = tuple(map(_named, args))
        if None in names:
            return build(*args)
        key = (id(getattr(session, "_jvm", None)), *names)
        if key not in known:
            known[key] = build(*args)
        return known[key]

    return wrapped


def among(text: Column, words) -> Column:
    """Whether a text is one of many words; one literal, folded by the optimiser."""
    return F.array_contains(F.split(F.lit("\n".join(words)), "\n"), text)


def looked_up(text: Column, table: dict[str, str]) -> Column:
    """The value of a text in a table, or SQL NULL; one literal, folded by the optimiser."""
    return F.element_at(F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in table.items())), F.lit("\n"), F.lit("\t")), text)


def null() -> Column:
    return F.lit("null")


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value), with value worked out once: where it stands several times, or within a lambda, the
    optimiser leaves copies, of which each is worked out for each element."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def quoted(text: Column) -> Column:
    """The JSON literal of a string; SQL NULL stays.  Only what may have to be escaped goes through to_json."""
    escaped = lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1)
    return bound(text, lambda t: F.when(t.rlike(r"[^ !#-\[\]-~]"), escaped(t)).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))


def word(text: str) -> Column:
    import json

    return F.lit(json.dumps(text, ensure_ascii=False))


def text_of(literal: Column) -> Column:
    """A literal as text: strings without quotes, null as SQL NULL, other literals as they are.  Only
    strings without escapes are cut from their quotes, all else is read as JSON."""
    read = lambda v: F.get_json_object(F.concat(F.lit('{"a":'), v, F.lit("}")), "$.a")
    return bound(literal, lambda v: F.when(v.rlike(r'\A"[ !#-\[\]-~]*+"\z'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(read(v)))


def number_of(literal: Column) -> Column:
    return F.when(literal.rlike(r"^-?\d"), literal.cast("double"))


def obj(**members: Column) -> Column:
    """The literal of an object of those members that aren't SQL NULL, in the order given."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def record(**fields: Column) -> Column:
    """A record of those fields that aren't SQL NULL."""
    made = F.map_from_arrays(F.split(F.lit("\n".join(fields)), "\n"), F.array(*fields.values()))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def overlay(base: Column, over: Column) -> Column:
    """base with over's fields added or put in their place."""
    return F.map_zip_with(base, over, lambda _, b, o: F.coalesce(o, b))


def put(base: Column, **fields: Column) -> Column:
    """base with fields set; a field whose value is SQL NULL stays as it is."""
    return overlay(base, record(**fields))


def drop(base: Column, *names: str) -> Column:
    return F.map_filter(base, lambda k, _: ~among(k, names))


def field(base: Column, name: str) -> Column:
    return F.element_at(base, name)


def falsy(literal: Column) -> Column:
    """Missing, null, false, zero, or empty."""
    return literal.isNull() | literal.isin("null", "false", '""', "{}", "[]") | literal.rlike(r"^-?0(\.0*)?([eE].*)?$")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parsed(json: Column) -> Column:
    """The record of a JSON object's text, or SQL NULL for anything else."""
    variant = F.try_parse_json(json)
    whole = F.to_json(variant)
    return F.when(whole.startswith("{"), F.transform_values(variant.cast("map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))))
