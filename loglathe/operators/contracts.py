"""Contracts: what records of a domain must look like, compiled on the driver.

A contract is a small JSON Schema.  It becomes a table of statements about paths, which one
expression holds against the record's values; the statements that aren't kept are its failures.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import compiled, text_of
from ..functions.vocabulary import ERROR_CODE, WORDS, Vocabulary

_TEXT = {"type": "string", "minLength": 1}
_AMOUNT = {"type": "number", "minimum": 0}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
_WHOLE = {"type": "integer", "minimum": 0}


def _enum(words) -> dict:
    return {"enum": list(words)}


def _object(required: tuple[str, ...] = (), closed: bool = True, **properties: dict) -> dict:
    return {"type": "object", "required": list(required), "properties": properties} | ({"additionalProperties": False} if closed else {})


_FLAG = _enum(WORDS["safety_flags"])
_FLAGS = {"type": "array", "items": _FLAG, "maxItems": 10, "uniqueItems": True}
_LEVEL, _CATEGORY, _SUB, _OUTCOME = (_enum(WORDS[x]) for x in ("level", "category", "sub_category", "outcome"))
_PARSE = {"parser_name": _TEXT, "parser_version": {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"}, "pattern_id": _TEXT, "confidence": _SHARE, "ok": {"type": "boolean"}, "error": {"type": "string"}}
_META = _object(("raw_message",), raw_message={"type": "string", "maxLength": 10000}, parse=_object(("parser_name", "parser_version"), **_PARSE), validation=_object(closed=False))

#: The contracts, with the engine's own fields (message, meta.validation, meta.parse.ok) besides; closed: other fields are failures (limits and words are fixed values).
CONTRACTS: dict[str, dict] = {
    "core_api": _object(
        ("meta", "timestamp", "outcome", "event_type", "service", "env"),
        meta=_META, timestamp={"type": "string"}, outcome=_OUTCOME, level=_LEVEL, category=_CATEGORY, sub_category=_SUB, component=_TEXT | {"maxLength": 100},
        latency_ms=_AMOUNT, duration_ms=_AMOUNT, endpoint=_TEXT, action=_enum("GET POST PUT PATCH DELETE HEAD OPTIONS INTERNAL".split()), http_status={"type": "integer", "minimum": 100, "maximum": 599}, request_id=_TEXT,
        error={"oneOf": [_TEXT, _object(("type", "message"), type=_TEXT, message=_TEXT | {"maxLength": 2000}, stack={"type": "string"})]},
        error_code=_enum(WORDS["error_code"]) | {"pattern": ERROR_CODE}, safety_flags=_FLAGS, service=_TEXT, module=_TEXT, version=_TEXT, message={"type": "string"},
        event_type=_enum("http_request http_response startup shutdown build dependency_install exception health_check apprunner_event".split()),
        env=_enum("production staging development test local".split()), metadata=_object(closed=False),
    )
    | {
        "when": [
            ({"event_type": ["http_request", "http_response"]}, ("endpoint", "action")),
            ({"outcome": ["failure"]}, ("error",)),
        ]
    },
    "llm": _object(
        ("meta", "timestamp", "outcome", "request_id", "model", "pipeline_stage"),
        meta=_META, timestamp={"type": "string"}, outcome=_OUTCOME, level=_LEVEL, category=_CATEGORY, component=_TEXT, request_id=_TEXT, model=_TEXT, message={"type": "string"},
        pipeline_stage=_enum("serve tokenizer load quant inference sampling rag_retrieve rag_embed rag_rerank safety_check".split()),
        result=_object(output_preview={"type": "string", "maxLength": 256}, output_text_length=_WHOLE, safety_flags=_FLAGS, model_quality_flags={"type": "array"}),
        usage=_object(prompt_tokens=_WHOLE, completion_tokens=_WHOLE, total_tokens=_WHOLE),
        sampler=_object(temperature={"type": "number"}, top_p={"type": "number"}, top_k={"type": "integer"}, max_tokens={"type": "integer"}, presence_penalty={"type": "number"}, frequency_penalty={"type": "number"}, stop_sequences={"type": "array"}, seed={"type": "integer"}),
        metrics=_object(p50_ms=_AMOUNT, p95_ms=_AMOUNT, extra=_object(closed=False)), finish_reason=_enum("stop length content_filter tool_calls timeout interrupted other".split()), endpoint=_TEXT, latency_ms=_AMOUNT, ttft_ms=_AMOUNT,
        error={"oneOf": [_TEXT, _object(("type", "message"), type=_TEXT, message=_TEXT, stack={"type": "string"})]}, sub_category=_SUB, metadata=_object(closed=False),
    )
    | {"when": [({"outcome": ["success"]}, ("result",)), ({"outcome": ["failure"]}, ("error",))]},
    "agentic": _object(
        ("meta", "status", "step_kind", "workflow_id", "step_id", "tool_name", "input_summary", "output_summary"),
        meta=_object(("raw_message",), raw_message={"type": "string"}, parse=_object(**_PARSE, timestamp={"type": "string"}, version={"type": "string"}), validation=_object(closed=False)),
        status=_enum("success retry timeout failed".split()), outcome=_OUTCOME, level=_LEVEL, category=_CATEGORY, sub_category=_SUB, component=_TEXT, message={"type": "string"},
        step_kind=_enum("session_start plan_created tool_selected step stream_start guardrails cost cache".split()), workflow_id=_TEXT, step_id=_TEXT, parent_step_id=_TEXT, plan_id=_TEXT, tool_name=_TEXT,
        ranked_tools={"type": "array"}, input_summary=_TEXT | {"maxLength": 4096}, output_summary=_TEXT | {"maxLength": 4096}, duration_ms=_AMOUNT,
        cost=_object(closed=False, tokens_in=_WHOLE, tokens_out=_WHOLE, est_cost_usd=_AMOUNT), error=_object(("message",), message=_TEXT | {"maxLength": 4096}), safety_flags=_FLAGS, metadata=_object(closed=False),
    )
    | {"when": [({"status": ["failed", "timeout"]}, ("error",))]},
    "cv": _object(
        ("meta", "outcome", "latency_ms", "metrics", "model_name", "phase", "dataset_id", "image_count", "batch_size", "hardware"),
        meta=_object(("raw_message", "parse"), raw_message={"type": "string"}, parse=_object(("parser_name", "parser_version", "pattern_id"), parser_name={"type": "string"}, parser_version={"type": "string"}, pattern_id={"type": "string"}, confidence=_SHARE, ok={"type": "boolean"}, error={"type": "string"}), validation=_object(closed=False)),
        timestamp={"type": "string"}, outcome=_OUTCOME, level=_LEVEL, category=_CATEGORY, component=_TEXT, latency_ms=_AMOUNT, error=_object(("message",), message=_TEXT | {"maxLength": 4096}),
        safety_flags={"oneOf": [_FLAG | {"type": "string"}, _FLAGS]}, metadata=_object(closed=False), message={"type": "string"}, sub_category=_SUB,
        metrics=_object(fps=_AMOUNT, map=_SHARE, ap=_SHARE, ap50=_SHARE, iou=_SHARE, accuracy=_SHARE, precision=_SHARE, recall=_SHARE, f1_score=_SHARE, loss=_AMOUNT, extra=_object(closed=False)) | {"minProperties": 1},
        model_name=_TEXT, phase=_enum("ingest preprocess inference postprocess eval serve track pose".split()), dataset_id=_TEXT,
        image_count={"type": "integer", "minimum": 1}, batch_size={"type": "integer", "minimum": 1},
        hardware={"oneOf": [_TEXT, _object(("accelerator",), accelerator=_TEXT, runtime={"type": "string"}, memory_gb=_AMOUNT, component={"type": "string"}, level={"type": "string"})]},
    )
    | {"when": [({"outcome": ["failure"]}, ("error",))]},
}



def with_words(contracts: dict[str, dict], vocabulary: Vocabulary) -> dict[str, dict]:
    """Contracts with the words of another vocabulary where they have those of the built-in one."""

    def changed(spec: Any) -> Any:
        if isinstance(spec, dict):
            own = [k for k, v in WORDS.items() if spec.get("enum") == v]
            return {k: list(vocabulary.words(own[0])) if own and k == "enum" else changed(v) for k, v in spec.items()}
        return [changed(x) for x in spec] if isinstance(spec, list) else spec

    return contracts if not vocabulary.fields else {k: changed(v) for k, v in contracts.items()}


_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
_TYPES = {"string": '^"', "number": _NUMBER, "integer": r"^-?\d+(\.0+)?$", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\[", "null": "^null$"}
_ROW = "array<struct<path: string, keyword: string, text: string, number: double, words: array<string>, under: string, forms: string, like: string>>"


def _rows(spec: dict[str, Any], path: str, under: str | None, form: str | None) -> list[dict]:
    """A contract as a table of statements, each about the value at a path.  under: a path whose value
    has to be an object for the statement to count; form: which form of which oneOf it belongs to."""
    out: list[dict] = []

    def add(keyword: str, text: str = "", number: float | None = None, words: list[str] | None = None) -> None:
        like = "^" + re.sub(r"\\\[\\\]", r"[0-9]+", re.escape(path)) + "$" if "/[]" in path else None
        out.append({"path": path, "keyword": keyword, "text": text, "number": number, "words": words or [], "under": under, "forms": form, "like": like})

    if "type" in spec:
        add("type", _TYPES[spec["type"]])
    if "enum" in spec:
        add("enum", words=[json.dumps(x) for x in spec["enum"]])
    if "const" in spec:
        add("enum", words=[json.dumps(spec["const"])])
    for key in ("minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "maxItems", "minProperties"):
        if key in spec:
            add(key, number=float(spec[key]))
    if "pattern" in spec:
        add("pattern", spec["pattern"])
    if spec.get("uniqueItems"):
        add("uniqueItems")
    items = spec.get("items", {})
    if "enum" in items:
        add("items", words=list(items["enum"]))
    elif items:  # a statement about each element, by its place
        if "oneOf" in json.dumps(items):
            raise ValueError(f"{path}: oneOf within items")
        out += _rows(items, f"{path}/[]", path or None, form)
    if spec.get("type") == "object":
        for name in spec.get("required", ()):
            add("required", name)
        if spec.get("additionalProperties") is False:
            add("additionalProperties", words=list(spec.get("properties", {})))
        for name, sub in spec.get("properties", {}).items():
            out += _rows(sub, f"{path}/{name}", path or None, form)
    for given, needed in spec.get("when", ()):
        for name, values in given.items():
            for x in needed:
                add("then", f"{name} {x}", words=[json.dumps(v) for v in values])
    if "oneOf" in spec:
        add("oneOf", number=float(len(spec["oneOf"])))
        for i, sub in enumerate(spec["oneOf"]):
            out += _rows(sub, path, under, f"{path} {i}")
    return out


def _extent(contracts: dict[str, dict]) -> tuple[int, bool]:
    """How many levels of values the contracts speak of, and whether they speak of lists' elements."""
    rows = [r for c in contracts.values() for r in _rows(c, "", None, None)]
    inner = ("required", "additionalProperties", "minProperties", "then")
    return max([1, *(r["path"].count("/") + (r["keyword"] in inner) for r in rows)]), any(r["like"] for r in rows)


@compiled
def _table(contract: str) -> Column:
    rows = _rows(json.loads(contract), "", None, None)
    return F.from_json(F.lit(json.dumps(rows)), _ROW)


def flat(values: Column, lists: bool = False) -> Column:
    """The members of the objects among values by path, by their own paths: ``/meta/parse`` of ``/meta``;
    lists: also the elements of lists, by place: ``/tags/0``."""
    text = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    own = lambda e, k, v: F.struct(F.concat(e["key"], F.lit("/"), k).alias("key"), text(v).alias("value"))
    members = lambda e: F.transform(F.map_entries(F.try_parse_json(e["value"]).cast("map<string,variant>")), lambda m: own(e, m["key"], m["value"]))
    entries = F.filter(F.map_entries(values), lambda e: e["value"].startswith("{"))
    if not lists:
        return F.map_from_entries(F.flatten(F.transform(entries, members)))
    elements = lambda e: F.transform(F.try_parse_json(e["value"]).cast("array<variant>"), lambda v, i: own(e, i.cast("string"), v))
    entries = F.filter(F.map_entries(values), lambda e: e["value"].rlike(r"^[{\[]"))
    return F.map_from_entries(F.flatten(F.transform(entries, lambda e: F.when(e["value"].startswith("{"), members(e)).otherwise(elements(e)))))


def _names(values: Column, path: Column) -> Column:
    """The names of the members of the object at a path."""
    start = F.concat(path, F.lit("/"))
    return F.transform(F.filter(F.map_keys(values), lambda k: k.startswith(start) & ~F.contains(F.substr(k, F.length(start) + 1), F.lit("/"))), lambda k: F.substr(k, F.length(start) + 1))


def _keeps(values: Column, row: Column) -> Column:
    value = F.element_at(values, row["path"])
    text = text_of(value)
    whole = row["path"] == ""
    number = F.when(value.rlike(_NUMBER), value.cast("double"))
    items = F.from_json(F.when(value.startswith("["), value), "array<string>")
    names = _names(values, row["path"])
    k = row["keyword"]
    there = whole | value.isNotNull()
    member = lambda name: F.map_contains_key(values, F.concat(row["path"], F.lit("/"), name))
    parts = F.split(row["text"], " ")
    asked = F.array_contains(row["words"], F.element_at(values, F.concat(row["path"], F.lit("/"), parts[0])))
    string, object_ = value.startswith('"'), whole | value.startswith("{")
    met = (
        F.when(k == "type", whole | F.regexp_like(value, row["text"]))
        .when(k == "enum", F.array_contains(row["words"], value))
        .when(k == "minLength", ~string | (F.length(text) >= row["number"]))
        .when(k == "maxLength", ~string | (F.length(text) <= row["number"]))
        .when(k == "pattern", ~string | F.regexp_like(text, row["text"]))
        .when(k == "minimum", number.isNull() | (number >= row["number"]))
        .when(k == "maximum", number.isNull() | (number <= row["number"]))
        .when(k == "exclusiveMinimum", number.isNull() | (number > row["number"]))
        .when(k == "maxItems", items.isNull() | (F.size(items) <= row["number"]))
        .when(k == "minProperties", ~object_ | (F.size(names) >= row["number"]))
        .when(k == "uniqueItems", items.isNull() | (F.size(items) == F.size(F.array_distinct(items))))
        .when(k == "items", items.isNull() | (F.size(F.array_except(items, row["words"])) == 0))
        .when(k == "required", ~object_ | member(row["text"]))
        .when(k == "additionalProperties", ~object_ | (F.size(F.array_except(names, row["words"])) == 0))
        .when(k == "then", ~F.coalesce(asked, F.lit(False)) | member(parts[1]))
        .otherwise(F.lit(True))
    )
    return ~there | F.coalesce(met, F.lit(False))


def check(rows: DataFrame, name: str, domain: Column, contracts: dict[str, dict] = CONTRACTS) -> DataFrame:
    """Rows with the column ``failures``: an array of (path, keyword, text), empty for a record in the
    column ``name`` that keeps to the contract of its domain, and one ``schema`` failure without one.

    A contract is a table of statements, so one expression serves them all.  Values are looked at as deep
    as the contracts speak of them; what is said of a list's items holds for each, at ``/list/<place>``.
    """
    rec = F.col(name)
    table = F
    for d, contract in contracts.items():
        table = table.when(domain == d, _table(json.dumps(contract)))
    rows = rows.withColumn("_contract", table)
    top = F.map_from_entries(F.transform(F.map_entries(rec), lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("key"), e["value"].alias("value"))))
    depth, lists = _extent(contracts)
    rows = rows.withColumn("_level1", top)
    for i in range(2, depth + 1):
        rows = rows.withColumn(f"_level{i}", flat(F.col(f"_level{i - 1}"), lists))
    levels = [f"_level{i}" for i in range(1, depth + 1)]
    rows = rows.withColumn("_values", F.map_concat(*levels))
    if lists:
        places = lambda r: F.transform(F.filter(F.map_keys("_values"), lambda k: F.regexp_like(k, r["like"])), lambda k: r.withField("path", k))
        rows = rows.withColumn("_contract", F.flatten(F.transform("_contract", lambda r: F.when(r["like"].isNull(), F.array(r)).otherwise(places(r)))))
    values = F.col("_values")
    broken = F.filter(F.col("_contract"), lambda r: ~_keeps(values, r))
    rows = rows.withColumn("_broken", broken)
    # of a oneOf exactly one form has to be kept
    def one(r: Column) -> Column:
        bad = F.filter(F.array_distinct(F.filter(F.col("_broken.forms"), lambda f: f.isNotNull())), lambda f: F.split_part(f, F.lit(" "), F.lit(1)) == r["path"])
        return F.element_at(values, r["path"]).isNull() | (r["number"] - F.size(bad) == 1)

    fail = F.concat(
        F.filter(F.col("_broken"), lambda r: r["forms"].isNull()),
        F.filter(F.col("_contract"), lambda r: (r["keyword"] == "oneOf") & ~one(r)),
    )
    said = F.transform(fail, lambda r: F.struct(r["path"].alias("path"), r["keyword"].alias("keyword"), r["text"].alias("text")))
    none = F.array(F.struct(F.lit("").alias("path"), F.lit("schema").alias("keyword"), F.lit("no contract").alias("text")))
    return rows.withColumn("failures", F.coalesce(said, none)).drop("_contract", *levels, "_values", "_broken")
