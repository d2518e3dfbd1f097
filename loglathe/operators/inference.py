"""The domain of a record that is already parsed, told from its fields.

Three callers ask in three ways, each an ordered table of what a record has and the domain that this
tells: the chain's own (``by_parse``), the contract check's (``by_contract``) and the statistics'
(``by_shape``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.literals import field, text_of
from .routing import DOMAINS, _domain

#: Fields that only records of a domain have, in the order asked (fixed values).
OWN_FIELDS = (
    ("core_api", "event_type http_status endpoint action service"),
    ("llm", "pipeline_stage usage ttft_ms sampler finish_reason request_id model"),
    ("agentic", "step_kind workflow_id tool_name plan_id ranked_tools"),
    ("cv", "phase model_name dataset_id metrics hardware image_count"),
)
#: Parts of pattern names that tell a domain, in the order asked (fixed values).
OWN_PATTERNS = (("agentic", "agent"), ("core_api", "http apprunner build"), ("llm", "token kv_cache llm"), ("cv", "infer cv batch"))


def _has(fields: Column, names: str) -> Column:
    return F.arrays_overlap(F.map_keys(fields), F.split(F.lit(names), " "))


def by_parse(fields: Column) -> Column:
    """By the domain that the record's parse notes, else by its fields, else by its pattern's name."""
    meta = field(fields, "meta")
    noted, pattern = F.get_json_object(meta, "$.parse.domain"), F.lower(F.get_json_object(meta, "$.parse.pattern_id"))
    chain = F.when(noted.isin(*DOMAINS), noted)
    for domain, names in OWN_FIELDS:
        chain = chain.when(_has(fields, names), domain)
    for domain, parts in OWN_PATTERNS:
        chain = chain.when(pattern.rlike("|".join(parts.split())), domain)
    return chain


def by_contract(fields: Column) -> Column:
    """By the field that a contract asks for first, else by the category."""
    category = text_of(field(fields, "category"))
    phase = text_of(field(fields, "phase")).isin("inference", "training", "evaluation")
    told = F.when(_has(fields, "step_kind"), "agentic").when(_has(fields, "pipeline_stage"), "llm").when(phase, "cv")
    return told.when(_has(fields, "http_method endpoint http_status event_type"), "core_api").when(category.isin(*DOMAINS), category)


def by_shape(fields: Column) -> Column:
    """By the category, else by the field of a domain, else by routing the line that the record is of."""
    category, raw = text_of(field(fields, "category")), F.get_json_object(field(fields, "meta"), "$.raw_message")
    told = F.when(category.isin(*DOMAINS), category)
    for name, domain in (("event_type", "core_api"), ("pipeline_stage", "llm"), ("step_kind", "agentic"), ("phase", "cv")):
        told = told.when(_has(fields, name), domain)
    return told.when(raw.isNotNull(), _domain(F.trim(raw)))
