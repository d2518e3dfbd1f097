"""Classification: ordered rules, of which the first that a record meets labels it.

A rule is a JSON condition tree with an action.  Conditions are compiled to columns over a record; the
number of the first rule that is met is computed once, and actions are looked up by it.

Dialects: ``production`` tells a record's domain from its fields and gives it the default label where
they don't tell; ``label`` takes the domain from the field ``schema_id``, compares like with like only
and names the rule in ``provenance.rule_id``.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import compiled, field, number_of, obj, overlay, quoted, record, text_of, word
from .ruleset import ALIASES, RULES, RULES_VERSION

OPERATORS = "exists eq neq gt gte lt lte in nin regex contains starts_with ends_with extract_ms extract_number extract_percent".split()
_COMPARE = ("gt", "gte", "lt", "lte", "eq")
DIALECTS = ("production", "label")


def value_at(fields: Column, path: str) -> Column:
    """The literal at a dotted path, or SQL NULL; null counts as missing."""
    head, _, rest = path.partition(".")
    top = field(fields, head)
    if rest:
        variant = F.when(top.startswith("{"), F.try_parse_json(top))
        top = F.to_json(F.try_variant_get(variant, "$." + rest, "variant"))
    return F.when(top != "null", top)


def paths_of(rules: list[dict], aliases: dict[str, list[str]] = ALIASES) -> list[str]:
    """The paths that rules look at, aliases resolved."""
    found: dict[str, None] = {}

    def walk(spec: dict) -> None:
        for x in [*spec.get("all", []), *spec.get("any", []), *([spec["not"]] if "not" in spec else [])]:
            walk(x)
        for name in [spec["field"]] if "field" in spec else spec.get("field_any", []):
            found.update(dict.fromkeys(aliases.get(name, []) if name.startswith("@") else [name]))

    for r in rules:
        walk(r["when"])
    return list(found)


def resolve(values: dict[str, Column], name: str, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The literal of a field, or of the first that an alias finds."""
    if name.startswith("@"):
        return F.coalesce(*(values[p] for p in aliases[name])) if aliases.get(name) else F.lit(None).cast("string")
    return values[name]


def _same(value: Column, other: Any) -> Column:
    """Equality as between JSON values: numbers by value, booleans as 0 and 1."""
    if isinstance(other, bool):
        return value.isin("true", "1", "1.0") if other else value.isin("false", "0", "0.0")
    if isinstance(other, (int, float)):
        return number_of(value) == float(other)
    return value == json.dumps(other, ensure_ascii=False) if isinstance(other, str) else value == F.lit(json.dumps(other))


def _order(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b, "eq": a == b}[op]


def _compare(op: str, value: Column, other: Any) -> Column:
    if isinstance(other, str):
        return value.startswith('"') & _order(op, text_of(value), F.lit(other))
    return _order(op, number_of(value), F.lit(float(other)))


def _java(regex: str) -> str:
    return re.sub(r"\(\?P<\w+>", "(", regex)


def atom(value: Column, op: str, spec: dict, dialect: str) -> Column:
    """Whether a value meets an operator; a missing value meets none but ``exists``."""
    other = spec.get("value")
    text = text_of(value)
    if op == "exists":
        wanted = True if dialect == "label" else spec.get("value", True)
        return value.isNotNull() if wanted else value.isNull()
    if op in ("eq", "neq"):
        same = F.coalesce(_same(value, other), F.lit(False))
        met = same if op == "eq" else ~same & value.isNotNull()
    elif op in _COMPARE:
        met = _compare(op, value, other)
    elif op in ("in", "nin"):
        among = F.lit(other).contains(text) if isinstance(other, str) else F.lit(False)
        for x in other if isinstance(other, list) else []:
            among = among | F.coalesce(_same(value, x), F.lit(False))
        met = among if op == "in" else ~among & value.isNotNull()
    elif op == "regex":
        try:
            re.compile(other)
        except re.error:
            return F.lit(False)
        met = text.rlike(_java(other))
    elif op == "contains":
        member = F.array_contains(F.from_json(F.when(value.startswith("["), value), "array<string>"), str(other))
        inside = text.contains(str(other))
        met = F.when(value.startswith("["), member if dialect == "label" else member | inside).otherwise(F.when(value.startswith('"'), inside) if dialect == "label" else inside)
    elif op in ("starts_with", "ends_with"):
        only = F.when(value.startswith('"'), text) if dialect == "label" else text
        met = only.startswith(str(other)) if op == "starts_with" else only.endswith(str(other))
    elif op.startswith("extract_"):
        regex = spec.get("pattern") or other
        found = F.nullif(F.regexp_extract(text, _java(regex), 1), F.lit(""))
        found = F.regexp_replace(found, "[,_]", "") if dialect == "production" or op == "extract_number" else F.regexp_replace(found, "%", "") if op == "extract_percent" else found
        number = F.when(found.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(found).cast("double")) * (1000.0 if op == "extract_ms" else 1.0)
        how = next((x for x in _COMPARE if x in spec), None)
        met = _order(how, number, F.lit(float(spec[how]))) if how else number.isNotNull()
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(met, F.lit(False))


def condition(values: dict[str, Column], spec: dict, dialect: str = "production", aliases: dict[str, list[str]] = ALIASES) -> Column:
    """A condition tree over the values of its paths, as a column that is true or false, never SQL NULL."""
    if "all" in spec:
        met = F.lit(True)
        for x in spec["all"]:
            met = met & condition(values, x, dialect, aliases)
        return met
    if "any" in spec:
        met = F.lit(False)
        for x in spec["any"]:
            met = met | condition(values, x, dialect, aliases)
        return met
    if "not" in spec:
        return ~condition(values, spec["not"], dialect, aliases)
    paths = [spec["field"]] if "field" in spec else spec.get("field_any", [])
    met = F.lit(False)
    for p in paths:
        met = met | atom(resolve(values, p, aliases), spec["op"], spec, dialect)
    return met


def domain_of(fields: Column) -> Column:
    """The domain that a record's fields tell, or SQL NULL."""
    has = lambda *names: _any(F.map_contains_key(fields, n) for n in names)
    phases = ("ingest", "preprocess", "inference", "postprocess", "eval", "serve", "track", "pose", "training")
    return (
        F.when(has("step_kind"), "agentic").when(has("pipeline_stage"), "llm").when(text_of(field(fields, "phase")).isin(*phases), "cv").when(has("http_status", "http_method", "endpoint", "event_type"), "core_api")
    )


def _any(columns) -> Column:
    met = F.lit(False)
    for c in columns:
        met = met | c
    return met


def problems(rules: list[dict]) -> list[str]:
    """What is wrong with a list of rules: identifiers, operators, domains, actions."""
    found, seen = [], set()

    def walk(spec: dict, rule: str) -> None:
        for key in ("all", "any"):
            for x in spec.get(key, []):
                walk(x, rule)
        if "not" in spec:
            walk(spec["not"], rule)
        if "op" in spec and spec["op"] not in OPERATORS:
            found.append(f"{rule}: operator {spec['op']!r}")
        if not spec.keys() & {"all", "any", "not", "field", "field_any"}:
            found.append(f"{rule}: a condition without a field")

    for r in rules:
        name = r.get("id", "")
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", name) or name in seen:
            found.append(f"{name}: identifier")
        seen.add(name)
        if not set(r.get("applies_to", [])) <= {"core_api", "llm", "agentic", "computer_vision", "cv"}:
            found.append(f"{name}: domains")
        walk(r.get("when", {}), name)
    return found


def first_rule(rows: DataFrame, name: str = "record", dialect: str = "production", rules: list[dict] | None = None, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rows with the column ``rule``: the place of the first rule that the record in the column
    ``name`` meets, or SQL NULL.

    What the rules look at is read from the record once.  Rules are grouped by domain, so that a
    record is only held against those that apply to it.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    rules = RULES if rules is None else rules
    if found := problems(rules):
        raise ValueError("; ".join(found))
    values, chain = _chain(name, dialect, json.dumps(rules), json.dumps(aliases))
    return rows.withColumn("_read", values).withColumn("rule", chain).drop("_read")


@compiled
def _chain(name: str, dialect: str, text: str, names: str) -> tuple[Column, Column]:
    """What rules look at in a record, as one struct ``_read``, and the place of the first that it meets."""
    rules, aliases = json.loads(text), json.loads(names)
    paths, rec = paths_of(rules, aliases), F.col(name)
    domain = domain_of(rec) if dialect == "production" else text_of(field(rec, "schema_id"))
    domain = F.when(domain == "computer_vision", "cv").otherwise(domain)
    read = F.struct(domain.alias("domain"), *(value_at(rec, p).alias(f"p{i}") for i, p in enumerate(paths)))
    values = {p: F.col(f"_read.p{i}") for i, p in enumerate(paths)}
    chain = F
    for domain_name in ("core_api", "llm", "agentic", "cv"):
        inner, own = F, {domain_name, {"cv": "computer_vision"}.get(domain_name, domain_name)}
        for i, r in enumerate(rules):
            if r.get("enabled", True) and (not r.get("applies_to") or own & set(r["applies_to"])):
                inner = inner.when(condition(values, r["when"], dialect, aliases), F.lit(i))
        if inner is not F:
            chain = chain.when(F.col("_read.domain") == domain_name, inner)
    if dialect == "label":  # a record of no domain can still meet rules that apply to all
        inner = F
        for i, r in enumerate(rules):
            if r.get("enabled", True) and not r.get("applies_to"):
                inner = inner.when(condition(values, r["when"], dialect, aliases), F.lit(i))
        if inner is not F:
            chain = inner if chain is F else chain.otherwise(F.when(~F.coalesce(F.col("_read.domain"), F.lit("")).isin("core_api", "llm", "agentic", "cv"), inner))
    return read, F.lit(None).cast("int") if chain is F else chain


LABELS = ("level", "category", "sub_category", "outcome", "tags")
DEFAULT = {"level": "info", "category": "core_api", "outcome": "success"}


def classify(rows: DataFrame, name: str = "record", dialect: str = "production", rules: list[dict] | None = None, aliases: dict[str, list[str]] = ALIASES, default_action: dict = DEFAULT) -> DataFrame:
    """Rows whose record has its first rule's labels and provenance; where no rule is met the default's
    labels fill what is missing.  Adds the column ``rule``."""
    rules = RULES if rules is None else rules
    return first_rule(rows, name, dialect, rules, aliases).withColumn(name, _labels(name, dialect, json.dumps(rules), json.dumps(default_action)))


@compiled
def _labels(name: str, dialect: str, rules: str, default_action: str) -> Column:
    return labelled(F.col(name), F.col("rule"), dialect, json.loads(rules), json.loads(default_action))


def labelled(fields: Column, index: Column, dialect: str = "production", rules: list[dict] | None = None, default_action: dict = DEFAULT) -> Column:
    rules = RULES if rules is None else rules

    def action(r: dict) -> dict[str, str]:
        if dialect == "label":
            source = {"rule_id": r["id"]}
        else:
            source = {"parser_rule_id": r["id"], "rule_version": r.get("version", "1.0.0"), "rule_name": r.get("name", r["id"])}
        labels = {k: r["action"][k] for k in LABELS if k in r["action"]} | {"provenance": source}
        return {k: json.dumps(v, ensure_ascii=False) for k, v in labels.items()}

    actions = F.from_json(F.lit(json.dumps([action(r) for r in rules])), "array<map<string,string>>")
    found = F.try_element_at(actions, index + 1)
    default = record(**{k: F.lit(json.dumps(v, ensure_ascii=False)) for k, v in default_action.items()})
    if dialect == "production":
        default = overlay(default, record(provenance=obj(parser_rule_id=word("default"), rule_version=word(RULES_VERSION), rule_name=word("Default action"))))
        provenance = record(provenance=obj(parser_rule_id=word("default"), rule_version=word(RULES_VERSION), rule_name=word("Default action")))
        return F.when(index.isNotNull(), overlay(fields, found)).otherwise(overlay(overlay(default, fields), provenance))
    return F.when(index.isNotNull(), overlay(fields, found)).otherwise(overlay(fields, default))


__all__ = ["classify", "condition", "domain_of", "first_rule", "labelled", "problems", "quoted"]
