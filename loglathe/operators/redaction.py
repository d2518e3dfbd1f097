"""Redaction of raw lines: what detectors find is merged as intervals and replaced by placeholders, with
keyed pseudonyms where equal values should stay equal.

Detectors are regular expressions in an order; where their finds overlap or touch, the interval from the
first to the last becomes one placeholder, of the detector that comes first in the order.  All of it is
one expression over a line; places are code points of the line as it was.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is redacted, by the name of its placeholder, in the order that decides.
DETECTORS: dict[str, str] = {
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "TOKEN": r"(?i)(?:api[_\-]?key|access[_\-]?key|secret|token|password|passwd|pwd)[\"']?[ \t]*[:=][ \t]*[\"']?[^\s\"'&,;<>]+"
    r"|sk-[A-Za-z0-9_\-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|[0-9a-f]{32,}",
    "CARD": r"(?:[0-9]{4}[ \-]){3}[0-9]{4}",
    "PHONE": r"\+?[0-9]{0,3}[ .\-]?\([0-9]{3}\)[ .\-]?[0-9]{3}[.\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}",
    "IP": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}",
    "ACCOUNT_ID": r"[0-9]{12,}",
    "USER": r"/(?:users|home)/[^/\s<>]+",
    "QUERY": r"\?[A-Za-z0-9_.\-]+=[^\s\"'<>]*",
    "HOST": r"(?:[A-Za-z0-9][A-Za-z0-9\-]*\.)+(?:com|net|org|io|dev|local|internal|corp|cloud)",
}
#: Hexadecimal digits of a pseudonym: so few that no detector takes it for a find.
DIGITS = 10
_SPAN = "struct<start: int, end: int, rank: int>"


def hmac_sha256(value: Column, key: bytes) -> Column:
    """The keyed digest of a text, in hexadecimal digits.  The key's two pads become part of the plan: keep
    plans of such queries as you keep the key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def _found(text: Column, regex: str, rank: int) -> Column:
    """Where a detector matches: its matches, and what stands before each, tell the places."""
    before, matches = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        first = s["at"] + F.length(x["before"])
        last = first + F.length(x["match"])
        return F.struct(last.alias("at"), F.array_append(s["spans"], F.struct(first.alias("start"), last.alias("end"), F.lit(rank).alias("rank"))).alias("spans"))

    pairs = F.zip_with(F.slice(before, 1, F.size(matches)), matches, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one, of the least rank."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.least(last["rank"], x["rank"]).alias("rank"))
        meets = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"])
        return F.when(meets, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, x))

    empty = F.array().cast(f"array<{_SPAN}>")
    return F.aggregate(F.sort_array(spans), empty, step)


def spans(text: Column, detectors: Mapping[str, str] = DETECTORS) -> Column:
    """The intervals of a text that detectors find, in order: (start, end, kind), end excluded."""
    some = [F.when(F.regexp_like(text, F.lit(regex)), _found(text, regex, i)).otherwise(F.array().cast(f"array<{_SPAN}>")) for i, regex in enumerate(detectors.values())]
    kinds = F.split(F.lit("\n".join(detectors)), "\n")
    return F.transform(_merged(F.concat(*some)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(kinds, x["rank"]).alias("kind")))


def redacted(text: Column, found: Column) -> Column:
    """The text with placeholders for the spans (start, end, kind, pseudonym) found in it, pseudonyms
    following the kind where there are any."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        name = F.concat(F.lit("<"), F.concat_ws("#", x["kind"], x["pseudonym"]), F.lit(">"))
        between = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(between, name)).alias("parts"))

    done = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))


def redact(rows: DataFrame, name: str, key: bytes | None = None, detectors: Mapping[str, str] = DETECTORS) -> DataFrame:
    """Rows with the text in the column ``name`` redacted, and the column ``redacted_spans``: (start, end,
    kind, pseudonym) of what was found in the text as it was, by code points from 0.

    key: pseudonyms are the first DIGITS digits of the keyed digest of the value found, so that equal
    values stay equal and can't be told without the key; without one, placeholders have the kind only and
    pseudonym is null.  A null text has null spans; a text without finds stays as it is.
    """
    text = F.col(name)
    value = lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])
    pseudonym = lambda x: F.substring(hmac_sha256(value(x), key), 1, DIGITS) if key is not None else F.lit(None).cast("string")
    found = F.when(text.isNotNull(), F.transform(spans(text, detectors), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), pseudonym(x).alias("pseudonym"))))
    marked = rows.withColumn("redacted_spans", found)
    return marked.withColumn(name, redacted(text, F.col("redacted_spans")))
