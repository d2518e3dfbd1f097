"""Patterns as data: rows of one's own become patterns beside the built-in ones, or in their place.

A row says which lines it matches and what its groups are called; it is checked on the driver and becomes
columns like the built-in patterns, so that no line leaves the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import null, obj, quoted, record
from ..functions.pairs import FORMS, typed
from .parsing import BUILT_IN, PATTERNS, Pattern, Registry

#: What can be done with a group's text, as the literal of its field.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "text": quoted,
    "lower": lambda x: quoted(F.lower(x)),
    "upper": lambda x: quoted(F.upper(x)),
    "integer": lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.cast("decimal(38,0)").cast("string")).otherwise(quoted(x)),
    "number": lambda x: F.when(x.rlike(r"^[+-]?\d+(\.\d+)?$"), x.cast("double").cast("string")).otherwise(quoted(x)),
    "value": typed,
}
#: Rows that a registry may have: they all become part of one plan.
MOST = 500
#: The columns of a table of patterns.
SCHEMA = "domain string, pattern_id string, confidence double, regex string, fields array<struct<group: int, field: string, transform: string>>, constants map<string,string>, pairs string"


class BadPattern(ValueError):
    """A row that can't become a pattern, named by its pattern_id."""


def _groups(spark: SparkSession, name: str, regex: str) -> int:
    """How many groups a regular expression of Java's has."""
    try:
        return spark._jvm.java.util.regex.Pattern.compile(regex).matcher("").groupCount()
    except Exception as e:
        raise BadPattern(f"{name}: {str(getattr(e, 'java_exception', e)).splitlines()[0]}") from e


def _nested(fields: dict[str, Column]) -> dict[str, Column]:
    """Fields by their top names; those with dots become objects."""
    out: dict[str, Any] = {}
    for name, value in fields.items():
        top, _, rest = name.partition(".")
        if rest:
            out.setdefault(top, {})[rest] = value
        else:
            out[top] = value
    return {k: obj(**_nested(v)) if isinstance(v, dict) else v for k, v in out.items()}


def _pattern(spark: SparkSession, row: dict[str, Any]) -> Pattern:
    name = row.get("pattern_id") or ""
    if not re.fullmatch(r"\w+", name):
        raise BadPattern(f"{name!r}: a pattern's name has letters, digits and _ only")
    if row.get("domain") not in PATTERNS:
        raise BadPattern(f"{name}: no domain {row.get('domain')!r}")
    confidence = row.get("confidence")
    if not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        raise BadPattern(f"{name}: confidence {confidence!r} isn't from 0 to 1")
    if (form := row.get("pairs")) is not None and form not in FORMS:
        raise BadPattern(f"{name}: no form of pairs {form!r}")
    regex, groups = row.get("regex") or "", None
    if not regex:
        raise BadPattern(f"{name}: no regex")
    groups = _groups(spark, name, regex)
    fields = [(x["group"], x["field"], x.get("transform") or "text") for x in row.get("fields") or ()]
    constants = dict(row.get("constants") or {})
    names = [f for _, f, _ in fields] + list(constants)
    for group, target, transform in fields:
        if not 0 <= group <= groups:
            raise BadPattern(f"{name}: {target}: no group {group} of {groups}")
        if transform not in TRANSFORMS:
            raise BadPattern(f"{name}: {target}: no transform {transform!r}")
    for x in names:
        if not x or names.count(x) > 1 or any(y.startswith(f"{x}.") for y in names):
            raise BadPattern(f"{name}: field {x!r} is empty, doubled or within another")

    def read(line: Column) -> Column:
        group = lambda i: F.nullif(F.regexp_extract(line, regex, i), F.lit(""))
        values = {target: F.coalesce(TRANSFORMS[transform](group(i)), null()) for i, target, transform in fields}
        return record(**_nested(values | {k: quoted(F.lit(v)) for k, v in constants.items()}))

    return Pattern(name, float(confidence), lambda line: line.rlike(regex), read, form)


def registry_of(spark: SparkSession, rows: DataFrame | Iterable[dict[str, Any]], base: Registry = BUILT_IN) -> Registry:
    """base with the patterns of the rows (SCHEMA): one with the name of a pattern of its domain takes its
    place, others are added.  Patterns are tried by falling confidence, of equal ones those of the rows
    first, in the rows' order for dicts and in that of their names for a table.

    Fields with dots make objects; a group that took no part gives null.  Raises BadPattern for a row that
    can't become a pattern, for a name that comes twice, and for one that is a pattern of another domain.
    """
    if isinstance(rows, DataFrame):
        found = [r.asDict(recursive=True) for r in rows.orderBy("domain", "pattern_id").limit(MOST + 1).collect()]
    else:
        found = list(rows)
    if len(found) > MOST:
        raise BadPattern(f"more than {MOST} patterns")
    own: dict[str, list[Pattern]] = {}
    taken: dict[str, str] = {}
    for row in found:
        p = _pattern(spark, row)
        if p.name in taken:
            raise BadPattern(f"{p.name}: comes twice")
        taken[p.name] = row["domain"]
        own.setdefault(row["domain"], []).append(p)
    domains = []
    for domain, patterns in base.domains:
        for p in patterns:
            if taken.get(p.name, domain) != domain:
                raise BadPattern(f"{p.name}: is a pattern of {domain}")
        kept = [p for p in patterns if p.name not in taken]
        domains.append((domain, tuple(sorted([*own.get(domain, ()), *kept], key=lambda p: -p.confidence))))
    return Registry(tuple(domains))


def read_patterns(spark: SparkSession, path: str, base: Registry = BUILT_IN) -> Registry:
    """registry_of() a JSON file on the driver: ``{"patterns": [...]}`` or a list."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    return registry_of(spark, given["patterns"] if isinstance(given, dict) else given, base)
