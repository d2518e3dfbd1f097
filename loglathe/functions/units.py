"""Durations and numbers with separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import quoted, strip

#: Milliseconds of a unit (fixed values).
MILLISECONDS = {"ms": 1.0, "s": 1000.0, "m": 60000.0, "min": 60000.0, "h": 3600000.0, "hr": 3600000.0}
DURATION = r"^([\d.]+)\s*([a-zA-Z]+)$"


def duration_ms(text: Column) -> Column:
    """A duration such as ``75s`` in milliseconds; SQL NULL for what isn't one."""
    number, unit = F.regexp_extract(strip(text), DURATION, 1), F.lower(F.regexp_extract(strip(text), DURATION, 2))
    chain = F
    for name, factor in MILLISECONDS.items():
        chain = chain.when(unit == name, F.lit(factor))
    return F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)$"), number.cast("double") * chain.otherwise(F.lit(None).cast("double")))


def plain(number: Column) -> Column:
    """The literal of a double; whole ones up to 1e16 without an exponent."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e16)
    return F.when(whole, F.concat(number.cast("bigint").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))


def clean_numeric(text: Column) -> Column:
    """The literal of a number without its separators; SQL NULL for what isn't one."""
    bare = F.regexp_replace(text, "[,_]", "")
    return F.when(bare.contains(".") & strip(bare).rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), bare.cast("double").cast("string")).when(
        ~bare.contains(".") & strip(bare).rlike(r"^[+-]?\d+$"), strip(bare).cast("decimal(38,0)").cast("string")
    )


def joined_trace(lines: Column) -> Column:
    return F.array_join(lines, "\n")


__all__ = ["clean_numeric", "duration_ms", "joined_trace", "quoted"]
