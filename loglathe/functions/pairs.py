"""key=value pairs of a message as a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import quoted, strip

_SINGLE, _DOUBLE, _BRACES, _SQUARE = r"'([^']*)'", r'"([^"]*)"', r"(\{[^}]*\})", r"(\[[^\]]*\])"

#: The kinds of values of a pair, by the family of lines that uses them (fixed values).
FORMS = {
    "llm_level": (r"([^\s,;]+)",),
    "llm_plain": (r"([^\s,;)]+)",),
    "session": (_SINGLE, _DOUBLE, r"([^\s]+)"),
    "tool": (_SINGLE, _DOUBLE, _BRACES, _SQUARE, r"([^\s,]+)"),
    "agentic": (_SINGLE, _DOUBLE, _BRACES, _SQUARE, r"([^\s,;]+)"),
    "cv": (_SINGLE, _DOUBLE, r"([^\s,;]+)"),
    "cv_model": (_SINGLE, _DOUBLE, _SQUARE, r"([^\s,;]+)"),
    "cv_component": (_SINGLE, _DOUBLE, _SQUARE, _BRACES, r"([^\s,;]+)"),
}

_DIGITS = r"\d(?:_?\d)*"
INTEGER = rf"^[+-]?{_DIGITS}$"
FLOAT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def pattern(form: str) -> str:
    return r"(\w+)=(?:" + "|".join(FORMS[form]) + ")"


def typed(value: Column) -> Column:
    """The literal of a value: an integer, else a float, else a string."""
    bare = F.regexp_replace(strip(value), "_", "")
    real = bare.cast("double").cast("string")
    return F.when(strip(value).rlike(INTEGER), bare.cast("decimal(38,0)").cast("string")).when(strip(value).rlike(FLOAT), real).otherwise(quoted(value))


def pairs(message: Column, form: str) -> Column:
    """The pairs of a message; of equal keys the last counts."""
    regex, n = pattern(form), len(FORMS[form])
    groups = [F.regexp_extract_all(message, F.lit(regex), F.lit(i + 1)).alias(f"g{i}") for i in range(n + 1)]
    # the last pair of a key wins: pairs are put in from the last, and those of keys already there left out
    entries = F.transform(F.arrays_zip(*groups), lambda g: F.struct(g["g0"].alias("key"), F.greatest(*(g[f"g{i + 1}"] for i in range(n))).alias("value")) if n > 1 else F.struct(g["g0"].alias("key"), g["g1"].alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    last = F.aggregate(F.reverse(entries), empty, lambda s, e: F.when(F.exists(s, lambda x: x["key"] == e["key"]), s).otherwise(F.array_append(s, e)))
    return F.transform_values(F.map_from_entries(F.reverse(last)), lambda _, v: typed(v))


def has_empty_value(message: Column, form: str) -> Column:
    """Whether a quoted value is empty, on which the compatible mode fails the record."""
    if len(FORMS[form]) == 1:
        return F.lit(False)
    return message.rlike(r"\w=(?:''|\"\")")
