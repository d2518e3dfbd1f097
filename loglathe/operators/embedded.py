"""JSON inside text: the objects that a line holds, and lines that are records written as text.

A fold over a line's brackets, quotes and escapes tells where an object that starts at a brace ends;
what isn't JSON is passed over, and the search goes on at the next brace.  One expression over a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.literals import parsed, strip

#: Escapes, brackets and quotes, blanks, and what stands between them: together a whole text.
_TOKENS = r'(?s)\\.|[\\"{}\[\] ]|[^\\"{}\[\] ]+'
_SPAN = "struct<start: int, end: int, json: string>"
#: What a record written as text starts with (fixed value).
RAW_TEXT = "RAW_TXT "


def _depth(s: Column, token: Column) -> tuple[Column, Column]:
    """(depth, whether within a string) after a token."""
    quoted = F.when(token == '"', ~s["quoted"]).otherwise(s["quoted"])
    step = F.when(s["quoted"], 0).when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
    return s["depth"] + step, quoted


def _length(rest: Column) -> Column:
    """How long the object at the start of a text is, in code points, or SQL NULL if no brace closes it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, token: Column) -> Column:
        depth, quoted = _depth(s, token)
        at = s["at"] + F.length(token)
        end = F.coalesce(s["end"], F.when(depth == 0, at))
        return F.when(s["end"].isNotNull(), s).otherwise(F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), end.alias("end")))

    return F.aggregate(F.regexp_extract_all(rest, F.lit(_TOKENS), F.lit(0)), start, step, lambda s: s["end"])


def objects(text: Column) -> Column:
    """The JSON objects in a text, in order: (start, end, json), by code points from 0, end excluded.  Of
    objects within each other the outermost that is JSON counts; brackets within strings don't.  A text
    without any has an empty array, SQL NULL has SQL NULL."""
    pieces = F.split(text, r"\{", -1)
    lengths = F.transform(pieces, lambda x: F.length(x) + 1)
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(s: Column, n: Column) -> Column:
        brace = s["at"] + n - 1  # a brace stands after each piece but the last
        rest = F.substring(text, brace + 1, F.length(text))
        size = F.when(brace >= s["free"], _length(rest))
        json = F.substring(rest, F.lit(1), size)
        good = F.try_parse_json(json).isNotNull()
        hit = F.struct(brace.alias("start"), (brace + size).alias("end"), json.alias("json"))
        return F.struct(
            (s["at"] + n).alias("at"),
            F.when(good, brace + size).otherwise(s["free"]).alias("free"),
            F.when(good, F.array_append(s["found"], hit)).otherwise(s["found"]).alias("found"),
        )

    return F.when(text.isNotNull(), F.aggregate(F.slice(lengths, 1, F.size(lengths) - 1), state, step, lambda s: s["found"]))


def _words(text: Column) -> Column:
    """A text cut at the blanks that are in no string and no bracket."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.array(F.lit("")).alias("words"))

    def step(s: Column, token: Column) -> Column:
        depth, quoted = _depth(s, token)
        last = F.size(s["words"])
        longer = F.array_append(F.slice(s["words"], F.lit(1), last - 1), F.concat(F.get(s["words"], last - 1), token))
        cut = (token == " ") & (s["depth"] == 0) & ~s["quoted"]
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), F.when(cut, F.array_append(s["words"], F.lit(""))).otherwise(longer).alias("words"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), state, step, lambda s: s["words"])


def written_record(text: Column) -> Column:
    """The record of a line ``RAW_TXT name=<json> ...``, or SQL NULL for other lines and for those of which a
    value isn't JSON.  Words without ``=`` are left out; of equal names the last counts."""
    rest = F.substring(text, F.lit(len(RAW_TEXT) + 1), F.length(text))
    pairs = F.transform(F.filter(_words(rest), lambda w: w.contains("=")), lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.to_json(F.try_parse_json(F.substring(w, F.instr(w, F.lit("=")) + 1, F.length(w)))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == p["key"]))
    whole = ~F.exists(pairs, lambda p: p["value"].isNull())
    return F.when(text.startswith(RAW_TEXT) & whole, F.map_from_entries(last))


def generated_record(message: Column) -> Column:
    """The record that a line is as a whole: a JSON object, or one written as text; SQL NULL for others."""
    text = strip(message)
    whole = text.startswith("{") & (_length(text) == F.length(text))
    return F.coalesce(F.when(whole, parsed(text)), written_record(message))
