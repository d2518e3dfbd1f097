"""Whole records: envelopes for lines that fail, provenance, canonical order, path branches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.literals import among, bound, falsy, field, obj, overlay, put, quoted, record, text_of, word
from .normalising import Defaults
from .parsing import VERSION

#: The order of a record's fields; others follow alphabetically (fixed values).
ORDER = (
    "timestamp message level category event_type service env outcome action endpoint http_status request_id model pipeline_stage usage sampler "
    "finish_reason ttft_ms agent_id step_kind tool_name status phase model_name dataset_id image_count batch_size hardware result component module "
    "version error error_code safety_flags latency_ms duration_ms metrics python_path stack_frames sub_category tags metadata meta provenance "
    "validation unparsed_reason"
).split()
#: Fields that classifying and validating give or need; the parse surface leaves them out (fixed values).
CLASSIFIED = (
    "category event_type service env level tags provenance validation component module endpoint action request_id http_status latency_ms "
    "duration_ms error error_code version safety_flags metadata sub_category outcome phase model_name dataset_id image_count metrics "
    "batch_size hardware result pipeline_stage model usage sampler finish_reason ttft_ms"
).split()


def canonical_json(fields: Column) -> Column:
    """The record as one JSON object, in canonical order at its top."""

    def text(rec: Column) -> Column:
        known = [F.concat(F.lit(f'"{k}": '), field(rec, k)) for k in ORDER]
        others = F.array_sort(F.filter(F.map_keys(rec), lambda k: ~among(k, ORDER)))
        rest = F.transform(others, lambda k: F.concat(quoted(k), F.lit(": "), F.element_at(rec, k)))
        return F.when(rec.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *known, rest), F.lit("}")))

    return bound(fields, text)


def with_provenance(fields: Column) -> Column:
    """The pattern that parsed a record, in its provenance, where the record tells it."""
    pattern = F.get_json_object(field(fields, "meta"), "$.parse.pattern_id")
    before = field(fields, "provenance")
    version, name = F.get_json_object(before, "$.rule_version"), F.get_json_object(before, "$.rule_name")
    return F.when(F.coalesce(pattern, F.lit("")) != "", put(fields, provenance=obj(parser_rule_id=quoted(pattern), rule_version=quoted(version), rule_name=quoted(name)))).otherwise(fields)


def unclassified(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, _: ~among(k, CLASSIFIED))


def is_normalised(fields: Column) -> Column:
    return F.map_contains_key(fields, "timestamp") & F.map_contains_key(fields, "meta")


def parse_meta(raw: Column, domain: Column, pattern: Column, confidence: Column, error: Column) -> Column:
    """meta of a parsed line: its text and how it was parsed."""
    ok = error.isNull()
    parse = obj(
        parser_name=quoted(F.concat(domain, F.lit("_parser"))), parser_version=word(VERSION), pattern_id=F.when(ok, quoted(pattern)), confidence=confidence.cast("string"),
        ok=F.when(ok, F.lit("true")).otherwise(F.lit("false")), error=quoted(error),
    )
    return obj(raw_message=quoted(raw), parse=parse)


def _defaults(domain: str, d: Defaults) -> Column:
    """What an envelope says of the fields that its domain requires."""
    if domain == "core_api":
        return record(event_type=word("exception"), service=word(d.service), env=word(d.env), outcome=word("failure"))
    if domain == "llm":
        return record(request_id=word("unknown"), model=word(d.model), pipeline_stage=word("serve"), outcome=word("failure"))
    if domain == "agentic":
        return record(step_kind=word("unknown"), workflow_id=word("unknown"), outcome=word("failure"))
    return record(phase=word("unknown"), model_name=word(d.model), outcome=word("failure"))


def envelope(timestamp: Column, raw: Column, domain: Column, reason: Column, defaults: Defaults) -> Column:
    """A record for a line that couldn't be parsed or wasn't complete."""
    chain = F
    for name in ("llm", "agentic", "cv"):
        chain = chain.when(domain == name, _defaults(name, defaults))
    base = chain.otherwise(_defaults("core_api", defaults))
    parse = obj(parser_name=quoted(F.concat(domain, F.lit("_parser"))), parser_version=word(VERSION), ok=F.lit("false"), error=quoted(reason))
    meta = obj(raw_message=quoted(F.coalesce(raw, F.lit(""))), parse=parse)
    return overlay(base, record(timestamp=quoted(F.coalesce(timestamp, F.lit(""))), message=quoted(F.coalesce(raw, F.lit(""))), level=word("error"), category=quoted(domain), unparsed_reason=quoted(reason), meta=meta))


def parse_ok(fields: Column) -> Column:
    return F.coalesce(F.get_json_object(field(fields, "meta"), "$.parse.ok") == "true", F.lit(False))


def merge_meta(fields: Column, name: str, value: Column) -> Column:
    """meta with a member added at its end."""
    meta = field(fields, "meta")
    empty = F.coalesce(meta, F.lit("{}")).rlike(r"^\{\s*\}$")
    added = F.concat(F.lit(f'"{name}": '), value, F.lit("}"))
    return put(fields, meta=F.when(empty, F.concat(F.lit("{"), added)).otherwise(F.concat(F.substring(meta, F.lit(1), F.length(meta) - 1), F.lit(", "), added)))


__all__ = ["canonical_json", "envelope", "falsy", "is_normalised", "merge_meta", "parse_meta", "parse_ok", "text_of", "unclassified", "with_provenance"]
