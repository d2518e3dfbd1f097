"""Normalising: units, synonyms, vocabulary, required fields and unknown ones."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import among, bound, compiled, looked_up, null, parsed, drop, falsy, field, obj, overlay, put, quoted, record, text_of, word
from ..functions.units import clean_numeric, duration_ms, plain
from ..functions.vocabulary import BUILT_IN, Vocabulary, canonical, canonical_flags


@dataclass(frozen=True)
class Defaults:
    """Values for fields that a line doesn't tell."""

    service: str = "unknown-service"
    env: str = "development"
    model: str = "unknown-model"

    @classmethod
    def from_environment(cls, prefix: str = "LOGLATHE_") -> Defaults:
        """The driver's variables PREFIX + SERVICE, ENV and MODEL where they are set and not empty."""
        return cls(**{f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if os.environ.get(prefix + f.name.upper())})


#: Fields that hold durations, and those that hold numbers with separators (fixed values).
DURATIONS = "latency_ms duration_ms ttft_ms latency duration ttft".split()
NUMBERS = "tokens prompt_tokens completion_tokens total_tokens http_status status_code count size bytes".split()
LEVEL_ALIASES = {"warning": "warn", "fatal": "critical", "trace": "debug"}
EVENTS = {
    "build": "deployment_artifact source_pull dependency_download build_event",
    "exception": "service_failure stacktrace python_error error",
    "startup": "server_running",
}
#: Sub-categories by the field that tells them (fixed values).
SUB_CATEGORIES = {
    "core_api": ("event_type", {"http_request": "network", "http_response": "network", "build": "build", "dependency_install": "build", "startup": "service"}),
    "llm": (
        "pipeline_stage",
        {"serve": "service", "tokenizer": "tokenizer", "quant": "quantization", "load": "model_load", "inference": "inference", "rag_retrieve": "data_io", "rag_embed": "embedding_service", "rag_rerank": "reranker", "safety_check": "safety", "sampling": "inference"},
    ),
    "agentic": ("step_kind", {"plan_created": "planner", "tool_selected": "tool_call", "cache": "storage", "guardrails": "safety", "cost": "metrics", "stream_start": "streaming"}),
    "cv": ("phase", {"ingest": "data_io", "preprocess": "preproc", "inference": "inference", "postprocess": "preproc", "eval": "metrics", "serve": "service", "track": "tracking", "pose": "inference"}),
}
STATUS_OUTCOMES = {"failed": "failure", "timeout": "timeout", "retry": "running", "success": "success"}
#: Fields of a domain's records; others go to metadata (fixed values).
ALLOWED = {
    "core_api": (
        "action category component duration_ms endpoint env error error_code event_type http_status latency_ms level meta metadata module outcome "
        "message request_id safety_flags service sub_category timestamp version unparsed_reason latency duration tokens prompt_tokens "
        "completion_tokens total_tokens status_code"
    ).split(),
    "llm": (
        "category component endpoint error finish_reason latency_ms level meta metadata metrics model outcome message pipeline_stage request_id "
        "result sampler timestamp ttft_ms usage unparsed_reason sub_category latency duration ttft tokens prompt_tokens completion_tokens total_tokens"
    ).split(),
    "agentic": (
        "category component cost duration_ms error input_summary level meta metadata outcome message output_summary parent_step_id plan_id "
        "ranked_tools safety_flags status step_id step_kind sub_category tool_name workflow_id unparsed_reason latency duration tokens"
    ).split(),
    "cv": (
        "batch_size category component dataset_id error hardware image_count latency_ms level meta metadata metrics model_name outcome message "
        "phase safety_flags timestamp unparsed_reason sub_category latency duration count size bytes"
    ).split(),
}


def required(domain: str, defaults: Defaults) -> dict[str, Column]:
    """The fields that a domain's records must have, with what stands in for a missing or empty one."""
    unknown = word("unknown")
    if domain == "core_api":
        return {"timestamp": unknown, "outcome": unknown, "event_type": unknown, "service": word(defaults.service), "env": word(defaults.env)}
    if domain == "llm":
        return {"timestamp": unknown, "outcome": unknown, "request_id": unknown, "model": word(defaults.model), "pipeline_stage": word("serve")}
    if domain == "agentic":
        return {x: unknown for x in "step_kind workflow_id step_id tool_name input_summary output_summary".split()} | {"status": word("success")}
    return {
        "timestamp": unknown, "outcome": unknown, "phase": unknown, "model_name": word(defaults.model), "dataset_id": unknown, "image_count": F.lit("1"),
        "metrics": F.lit('{"fps": 0}'), "latency_ms": F.lit("0"), "batch_size": F.lit("1"), "hardware": unknown,
    }


def _table(text: Column, table: dict[str, str]) -> Column:
    return looked_up(text, table)


#: The parts of a JSON text: strings, and what stands between them.
_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'
#: A member of an object within a value that units() should look at.
_NAMED = rf'"({"|".join(DURATIONS + NUMBERS)})"\s*:\s*"'


def _nested(literal: Column) -> Column:
    return literal.startswith("{") | literal.startswith("[")


def _in_units(name: Column, text: Column) -> Column:
    """The literal that a string in a field of that name stands for, or SQL NULL."""
    return F.when(name.isin(DURATIONS), plain(duration_ms(text))).when(name.isin(NUMBERS), clean_numeric(text))


def _rewritten(literal: Column) -> Column:
    """The literal of an object or list with the units of all its members, however deep: a string that
    follows a colon is a value, and the string before that is its name, so no level needs to be known."""
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(literal)), F.lit(_PARTS), F.lit(0))

    def part(every: Column, token: Column, i: Column) -> Column:
        name = text_of(F.get(every, i - 2))
        done = F.when(F.get(every, i - 1) == ":", _in_units(name, text_of(token)))
        return F.when(token.startswith('"'), F.coalesce(done, token)).otherwise(F.regexp_replace(token, "([,:])", "$1 "))

    return bound(tokens, lambda every: F.array_join(F.transform(every, lambda x, i: part(every, x, i)), ""))


def units(fields: Column) -> Column:
    """Durations in milliseconds and numbers without separators, also in objects and lists below, at any
    depth; what isn't one stays as it is."""

    def value(name: Column, literal: Column) -> Column:
        own = F.when(literal.startswith('"') & among(name, DURATIONS + NUMBERS), _in_units(name, text_of(literal)))
        return F.when(_nested(literal) & literal.rlike(_NAMED), _rewritten(literal)).otherwise(F.coalesce(own, literal))

    return F.transform_values(fields, value)


def unit_errors(fields: Column) -> Column:
    """What units() had to leave: strings in fields of durations and numbers, those of objects and lists
    below after the record's own."""
    left = F.map_keys(F.map_filter(fields, lambda k, v: k.isin(DURATIONS + NUMBERS) & v.startswith('"')))
    below = F.transform(F.filter(F.map_values(fields), lambda v: _nested(v) & v.rlike(_NAMED)), lambda v: F.regexp_extract_all(v, F.lit(_NAMED), F.lit(1)))
    every = F.concat(left, F.coalesce(F.flatten(below), F.array().cast("array<string>")))
    return F.array_join(F.transform(every, lambda k: F.concat(k, F.lit(": not a "), F.when(k.isin(DURATIONS), "duration").otherwise("number"))), "; ")


def with_errors(fields: Column, errors: Column) -> Column:
    """fields with errors of normalising noted in meta.parse, after those noted before."""
    before = text_of(F.get_json_object(field(fields, "meta"), "$.parse.error").cast("string"))
    noted = obj(parse=obj(ok=F.lit("false"), error=quoted(F.concat_ws("; ", F.nullif(before, F.lit("")), errors))))
    return F.when(errors != "", put(fields, meta=noted)).otherwise(fields)


def synonyms(fields: Column, domain: str) -> Column:
    """Levels, events and actions by their common names; outcome and sub-category where they can be told."""
    get = lambda name: text_of(field(fields, name))
    level = F.lower(get("level"))
    level = F.coalesce(_table(level, LEVEL_ALIASES), level)
    event = get("event_type")
    for name, old in EVENTS.items():
        event = F.when(event.isin(old.split()), name).otherwise(event)
    if domain == "core_api":
        outcome = F.when((event == "exception") | (level == "error"), "failure").when(level == "warn", "running").otherwise("success")
    elif domain == "llm":
        given = lambda name: ~falsy(field(fields, name))
        outcome = F.when(given("error"), "failure").when(get("finish_reason") == "timeout", "timeout").when(given("result") | given("finish_reason"), "success").otherwise("running")
    elif domain == "agentic":
        outcome = F.coalesce(_table(F.lower(get("status")), STATUS_OUTCOMES), F.when(level == "error", "failure").otherwise("success"))
    else:
        outcome = F.lit(None).cast("string")
    none = F.coalesce(field(fields, "outcome"), null()) == "null"
    told, table = SUB_CATEGORIES[domain]
    sub = _table(event if told == "event_type" else get(told), table)
    return put(
        fields, level=quoted(level), category=word(domain), event_type=quoted(event), outcome=F.when(none, quoted(outcome)),
        sub_category=F.when(~F.map_contains_key(fields, "sub_category"), quoted(sub)), action=quoted(F.upper(get("action"))) if domain == "core_api" else F.lit(None).cast("string"),
    )


SCALARS = ("level", "outcome", "category", "sub_category")


def _flags(literal: Column) -> Column:
    parts = F.when(literal.startswith('"'), F.split(text_of(literal), ",")).when(literal.startswith("["), F.from_json(literal, "array<string>"))
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def _known(name: Column, literal: Column, words: Vocabulary) -> Column:
    """The vocabulary's literal for a field's, or SQL NULL."""
    chain = F
    for x in SCALARS:
        chain = chain.when(name == x, quoted(canonical(x, text_of(literal), words)))
    return chain.when(name == "safety_flags", F.to_json(canonical_flags(_flags(literal), words)))


def unknown_words(fields: Column, words: Vocabulary = BUILT_IN) -> Column:
    """The fields whose values the vocabulary doesn't have, in its order."""
    there = lambda k, v: k.isin(*SCALARS, "safety_flags") & (v != "null") & _known(k, v, words).isNull()
    bad = F.map_keys(F.map_filter(fields, there))
    return F.array_intersect(F.array(*map(F.lit, (*SCALARS, "safety_flags"))), bad)


def vocabulary(fields: Column, words: Vocabulary = BUILT_IN) -> Column:
    """Words of the vocabulary for level, outcome, category, sub-category and flags; others stay."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*SCALARS, "safety_flags"), F.coalesce(_known(k, v, words), v)).otherwise(v))


def word_errors(fields: Column, unknown: Column) -> Column:
    name = lambda k: F.when(k == "safety_flags", "invalid_safety_flags").otherwise(F.concat(F.lit("invalid_"), k, F.lit("_value")))
    return F.array_join(F.transform(unknown, lambda k: F.concat(name(k), F.lit("(original="), F.element_at(fields, k), F.lit(")"))), "; ")


def first_reason(unknown: Column) -> Column:
    k = F.try_element_at(unknown, F.lit(1))
    return F.when(k == "safety_flags", word("invalid_safety_flags")).when(k.isNotNull(), quoted(F.concat(F.lit("invalid_"), k, F.lit("_value"))))


def one_flag(fields: Column) -> Column:
    """The first flag other than none, for the domain that has one at a time."""
    flags = F.from_json(F.when(field(fields, "safety_flags").startswith("["), field(fields, "safety_flags")), "array<string>")
    return put(fields, safety_flags=quoted(F.coalesce(F.try_element_at(F.filter(flags, lambda x: x != "none"), F.lit(1)), F.when(F.size(flags) > 0, "none"))))


def complete(fields: Column, domain: str, defaults: Defaults) -> Column:
    return put(fields, **{k: F.when(falsy(field(fields, k)), v) for k, v in required(domain, defaults).items()})


def relocate(fields: Column, domain: str) -> Column:
    """Fields that the domain doesn't know, in metadata."""
    unknown = F.map_filter(fields, lambda k, _: ~among(k, ALLOWED[domain]))
    before = F.transform_values(F.coalesce(F.try_parse_json(F.coalesce(field(fields, "metadata"), F.lit("{}"))).cast("map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    every = overlay(before, unknown)
    return F.when(F.size(unknown) > 0, put(F.map_filter(fields, lambda k, _: among(k, ALLOWED[domain])), metadata=literal(every))).otherwise(fields)


def literal(fields: Column) -> Column:
    """A record as the literal of an object, keys in alphabetical order."""
    member = lambda rec, k: F.concat(quoted(k), F.lit(": "), F.element_at(rec, k))
    members = lambda rec: F.transform(F.array_sort(F.map_keys(rec)), lambda k: member(rec, k))
    return bound(fields, lambda rec: F.concat(F.lit("{"), F.array_join(members(rec), ", "), F.lit("}")))


def conditional(fields: Column, domain: str) -> Column:
    """What a record's outcome or status requires besides."""
    if domain == "core_api":
        return fields
    name, member = ("result", "output_text_length") if domain == "llm" else ("error", "message")
    value = F.lit("0") if domain == "llm" else word({"agentic": "Step failed or timed out", "cv": "CV operation failed"}[domain])
    asked = {"llm": field(fields, "outcome") == '"success"', "agentic": field(fields, "status").isin('"failed"', '"timeout"'), "cv": field(fields, "outcome") == '"failure"'}[domain]
    there = field(fields, name)
    lacks = there.startswith("{") & F.get_json_object(there, f"$.{member}").isNull()
    added = F.regexp_replace(F.regexp_replace(there, r"\}\s*$", F.concat(F.lit(f', "{member}": '), value, F.lit("}"))), r"^\{\s*, ", "{")
    return put(fields, **{name: F.when(F.coalesce(asked, F.lit(False)), F.when(there.isNull(), obj(**{member: value})).when(lacks, added))})


def normalise(rows: DataFrame, name: str = "fields", domain: str = "domain", defaults: Defaults = Defaults(), words: Vocabulary = BUILT_IN) -> DataFrame:
    """Rows with the record in the column ``name`` normalised as the domain in the column ``domain``
    asks, with the words of a vocabulary.  Each step is a projection of its own, so that what it reads is computed once."""

    for column, value in _steps(name, domain, defaults, words):
        rows = rows.withColumn(column, value)
    return rows.drop("_bad")


@compiled
def _steps(name: str, domain: str, defaults: Defaults, words: Vocabulary) -> list[tuple[str, Column]]:
    def by_domain(step) -> Column:
        chain = F
        for d in ALLOWED:
            chain = chain.when(F.col(domain) == d, step(d))
        return chain

    rec = F.col(name)
    noted = put(with_errors(vocabulary(rec, words), word_errors(rec, F.col("_bad"))), unparsed_reason=F.when(~F.map_contains_key(rec, "unparsed_reason"), first_reason(F.col("_bad"))))
    return [
        (name, units(rec)), ("_bad", unit_errors(rec)), (name, with_errors(rec, F.col("_bad"))),
        (name, by_domain(lambda d: synonyms(rec, d))),
        ("_bad", unknown_words(rec, words)), (name, F.when(F.size("_bad") > 0, noted).otherwise(vocabulary(rec, words))),
        (name, F.when(F.col(domain) == "cv", one_flag(rec)).otherwise(rec)),
        (name, by_domain(lambda d: complete(rec, d, defaults))), (name, by_domain(lambda d: relocate(rec, d))), (name, by_domain(lambda d: conditional(rec, d))),
    ]


__all__ = ["ALLOWED", "Defaults", "drop", "normalise", "record"]
