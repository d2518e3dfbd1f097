"""Queries over records: rules, their operators, ways in, and what the chain says of LINES, with SQL
that tells the results from the events' numbers alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import field, parsed, text_of
from ..operators import inference, rules, stats
from ..operators.normalising import units
from ..operators.records import CLASSIFIED, canonical_json, unclassified, with_provenance
from ..sources.lines import spread
from .pipeline import Options, classify_records, normalise, parse, validate

#: Records, as templates in which # is the event's number, and the rule that each one meets.
RULE_CASES = (
    ('{"event_type": "startup"}', "api-startup-guard", "info"),
    ('{"event_type": "build"}', "api-build-guard", "info"),
    ('{"event_type": "health_check"}', "api-health-check-guard", "info"),
    ('{"http_status": 503}', "api-5xx-critical", "critical"),
    ('{"http_status": 403, "latency_ms": #}', "api-unauthorized", "warn"),
    ('{"endpoint": "/#", "error": {"code": 409}}', "api-conflict-error", "warn"),
    ('{"http_status": 404}', "api-4xx-client-error", "warn"),
    ('{"endpoint": "/#", "latency_ms": 2#, "outcome": "failure", "trace_id": "#", "http_status": 99}', "all-failure-high", "error"),
    ('{"endpoint": "/#", "latency_ms": 2000.#, "outcome": "success"}', "api-high-latency", "warn"),
    ('{"endpoint": "/#", "meta": {"raw_message": "error rate 12.5% now"}}', "core-api-error-rate-high", "warn"),
    ('{"endpoint": "/#", "error": {"type": "stacktrace"}}', "api-python-stacktrace", "error"),
    ('{"http_status": 204}', "core-api-http-2xx-success", "info"),
    ('{"event_type": "e#"}', "core-api-general-event", "info"),
    ('{"pipeline_stage": "serve", "safety_flags": ["policy_violation"]}', "llm-safety-flag-critical", "critical"),
    ('{"pipeline_stage": "serve", "usage": {"total_tokens": 1000#}}', "llm-token-budget-exceeded", "warn"),
    ('{"pipeline_stage": "serve", "error": {"code": 429}}', "llm-rate-limited", "error"),
    ('{"pipeline_stage": "serve", "metrics": {"kv_cache_usage_percent": 95}}', "llm-kv-cache-anomaly", "warn"),
    ('{"pipeline_stage": "serve", "ttft_ms": 1500, "outcome": "success"}', "llm-ttft-anomalous", "warn"),
    ('{"pipeline_stage": "tokenizer", "outcome": "failure", "meta": {"raw_message": "bad Vocab #"}}', "llm-tokenizer-error", "error"),
    ('{"pipeline_stage": "quant", "outcome": "failure", "message": "incompatible kernel #"}', "llm-quant-incompatible", "error"),
    ('{"pipeline_stage": "rag_embed", "outcome": "failure", "duration_ms": 1000}', "llm-rag-timeout", "error"),
    ('{"pipeline_stage": "s#"}', "llm-general-pipeline", "info"),
    ('{"step_kind": "plan", "tool_name": "planner", "duration_ms": 60000}', "agentic-planner-long-running", "info"),
    ('{"step_kind": "x", "guardrails_triggered": ["#"]}', "agentic-guardrail-triggered", "critical"),
    ('{"step_kind": "x", "cost_tracking": {"total_cost_usd": 100.#}}', "agentic-cost-anomaly", "warn"),
    ('{"step_kind": "x", "status": "failed"}', "agentic-missing-error-context", "warn"),
    ('{"step_kind": "x", "status": "failed", "error": {"message": "ImportError: #"}}', "agentic-tool-dependency-error", "error"),
    ('{"step_kind": "tool_call", "status": "failed", "error": {"message": "#"}}', "agentic-tool-failure", "error"),
    ('{"step_kind": "x", "tool_name": "web_search", "status": "success", "duration_ms": 1600}', "agentic-search-slow", "warn"),
    ('{"step_kind": "x", "status": "retry", "duration_ms": 5000}', "agentic-tool-slow", "warn"),
    ('{"step_kind": "s#"}', "agentic-general-step", "info"),
    ('{"phase": "inference", "outcome": "failure", "error": {"message": "CUDA out of memory #"}}', "cv-gpu-oom", "error"),
    ('{"phase": "training", "metrics": {"loss": 5.5}}', "cv-training-loss-spike", "warn"),
    ('{"phase": "eval", "metrics": {"mAP": 0.2}}', "cv-inference-map-low", "error"),
    ('{"phase": "ingest", "meta": {"raw_message": "Processed 3,276 images of #"}}', "cv-throughput-high", "info"),
    ('{"phase": "inference", "batch_size": 32, "metrics": {"fps": 19}}', "cv-batch-slow", "warn"),
    ('{"phase": "pose"}', "cv-general-phase", "info"),
    ('{"endpoint": "/#", "status": "failed"}', "all-failure-high", "error"),
    ('{"endpoint": "/#", "latency_ms": 2000, "outcome": "running"}', "all-latency-anomalous", "warn"),
    ('{"endpoint": "/#", "latency_ms": 1999}', "missing-trace-identifier", "info"),
    ('{"endpoint": "/#", "trace_id": "#"}', "default", "info"),
)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id")


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.classify(_templates(spark, sf_dir, RULE_CASES))
    return rows.select("event_id", F.get_json_object(field(F.col("record"), "provenance"), "$.parser_rule_id").alias("rule_id"), text_of(field(F.col("record"), "level")).alias("level"))


#: The record that conditions are held against, # being n, and conditions with what they come to.
SUBJECT = '{"num": #, "text": "job # took # s, #% done", "list": ["a", "#"], "none": null, "deep": {"a": {"b": #}}, "duration_ms": 1#00, "flag": true}'
CONDITIONS: dict[str, tuple[dict, str]] = {
    "gt": ({"field": "num", "op": "gt", "value": 5}, "n > 5"),
    "gte": ({"field": "num", "op": "gte", "value": 5}, "n >= 5"),
    "lt": ({"field": "num", "op": "lt", "value": 5}, "n < 5"),
    "lte": ({"field": "deep.a.b", "op": "lte", "value": 5}, "n <= 5"),
    "eq": ({"field": "num", "op": "eq", "value": 3.0}, "n = 3"),
    "eq_flag": ({"field": "flag", "op": "eq", "value": True}, "true"),
    "neq": ({"field": "num", "op": "neq", "value": 3}, "n <> 3"),
    "neq_missing": ({"field": "gone", "op": "neq", "value": 3}, "false"),
    "in": ({"field": "num", "op": "in", "value": [1, 3, 5]}, "n in (1, 3, 5)"),
    "nin": ({"field": "num", "op": "nin", "value": [1, 3, 5]}, "n not in (1, 3, 5)"),
    "regex": ({"field": "text", "op": "regex", "value": "^job [2-4]"}, "n between 2 and 4"),
    "contains_text": ({"field": "text", "op": "contains", "value": "job 7"}, "n = 7"),
    "contains_list": ({"field": "list", "op": "contains", "value": "7"}, "n = 7"),
    "starts_with": ({"field": "text", "op": "starts_with", "value": "job 3"}, "n = 3"),
    "ends_with": ({"field": "text", "op": "ends_with", "value": "3% done"}, "n = 3"),
    "exists": ({"field": "deep.a.b", "op": "exists"}, "true"),
    "exists_null": ({"field": "none", "op": "exists"}, "false"),
    "exists_not": ({"field": "gone", "op": "exists", "value": False}, "true"),
    "extract_number": ({"field": "text", "op": "extract_number", "pattern": r"job (\d+)", "gte": 4}, "n >= 4"),
    "extract_ms": ({"field": "text", "op": "extract_ms", "pattern": r"took (\d+) s", "gt": 3000}, "n > 3"),
    "extract_percent": ({"field": "text", "op": "extract_percent", "pattern": r"(\d+)%", "lt": 6}, "n < 6"),
    "all": ({"all": [{"field": "num", "op": "gt", "value": 2}, {"field": "num", "op": "lt", "value": 6}]}, "n > 2 and n < 6"),
    "any": ({"any": [{"field": "num", "op": "lt", "value": 2}, {"field": "num", "op": "gt", "value": 6}]}, "n < 2 or n > 6"),
    "not": ({"not": {"field": "num", "op": "lt", "value": 2}}, "n >= 2"),
    "field_any": ({"field_any": ["gone", "deep.a.b"], "op": "eq", "value": 4}, "n = 4"),
    "alias": ({"field": "@latency", "op": "gte", "value": 1400}, "n >= 4"),
}


def rule_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator of conditions, held against records with the digit n."""
    rows = _numbered(spark, sf_dir).select((F.col("event_id") % 10).alias("n")).withColumn("record", parsed(F.replace(F.lit(SUBJECT), F.lit("#"), F.col("n").cast("string"))))
    paths = rules.paths_of([{"when": x} for x, _ in CONDITIONS.values()])
    read = rows.select("n", *(rules.value_at(F.col("record"), p).alias(f"p{i}") for i, p in enumerate(paths)))
    values = {p: F.col(f"p{i}") for i, p in enumerate(paths)}
    met = F.array(*(F.struct(F.lit(k).alias("condition"), rules.condition(values, x).alias("met")) for k, (x, _) in CONDITIONS.items()))
    each = read.select("n", F.explode(met).alias("x")).select("n", "x.*")
    return each.groupBy("n", "condition").agg(F.count("*").alias("rows"), F.count_if("met").alias("met"))


def records_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that come as JSON: normalised ones pass, raw ones are parsed, others become envelopes."""
    n, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    value = (
        F.when(kind == 0, F.concat(F.lit('{"timestamp": "t", "meta": {"parse": {"pattern_id": "p'), n, F.lit('"}}, "event_type": "startup", "outcome": "success"}')))
        .when(kind == 1, F.concat(F.lit('{"@timestamp": "t", "@message": "GET /'), n, F.lit(' 200 5ms"}')))
        .when(kind == 2, F.concat(F.lit('{"@message": "GET /'), n, F.lit(' 200"}')))
        .otherwise(F.concat(F.lit('{"other": '), n, F.lit("}")))
    )
    done = classify_records(_numbered(spark, sf_dir).select("event_id", value.alias("value")), Options())
    rec = F.col("record")
    rule = lambda c: F.get_json_object(field(c, "provenance"), "$.parser_rule_id")
    return done.select("event_id", text_of(field(rec, "event_type")).alias("event_type"), text_of(field(rec, "endpoint")).alias("endpoint"), text_of(field(rec, "unparsed_reason")).alias("reason"), rule(rec).alias("rule_id"), rule(with_provenance(rec)).alias("parsed_by"), field(unclassified(rec), "provenance").isNull().alias("bare"))


def record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: known fields in their order, others after them by name."""
    n = F.col("event_id").cast("string")
    rec = parsed(F.concat(F.lit('{"zeta": '), n, F.lit(', "meta": {"a": "x"}, "outcome": null, "alpha": ["'), n, F.lit('"], "level": "info", "timestamp": "t"}')))
    return _numbered(spark, sf_dir).select("event_id", canonical_json(rec).alias("json"))


#: Records, the domains that the chain, the contract check and the statistics tell them to be of.
DOMAIN_CASES = (
    ('{"meta": {"parse": {"domain": "cv"}}, "event_type": "x"}', "cv", "core_api", "core_api"),
    ('{"service": "s#"}', "core_api", "", ""),
    ('{"request_id": "#", "category": "agentic"}', "llm", "agentic", "agentic"),
    ('{"workflow_id": "#"}', "agentic", "", ""),
    ('{"phase": "inference", "category": "none"}', "cv", "cv", "cv"),
    ('{"phase": "ingest", "event_type": "x"}', "core_api", "core_api", "core_api"),
    ('{"step_kind": "x", "pipeline_stage": "y"}', "llm", "agentic", "llm"),
    ('{"meta": {"parse": {"pattern_id": "Agent_x"}, "raw_message": "[Planner] step #"}}', "agentic", "", "agentic"),
    ('{"meta": {"parse": {"pattern_id": "kv_cache_x"}, "raw_message": "[Tokenizer] #"}}', "llm", "", "llm"),
    ('{"meta": {"parse": {"pattern_id": "apprunner_event"}, "raw_message": "nothing #"}}', "core_api", "", "core_api"),
    ('{"meta": {"parse": {"pattern_id": "batch"}}}', "cv", "", ""),
    ('{"other": "#"}', "", "", ""),
)


def _templates(spark: SparkSession, sf_dir: str, cases) -> DataFrame:
    templates = F.from_json(F.lit(json.dumps([x[0] for x in cases])), "array<string>")
    made = F.replace(F.element_at(templates, (F.col("event_id") % len(cases) + 1).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    return _numbered(spark, sf_dir).withColumn("record", parsed(made))


def domain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = F.col("record")
    return _templates(spark, sf_dir, DOMAIN_CASES).select("event_id", inference.by_parse(rec).alias("by_parse"), inference.by_contract(rec).alias("by_contract"), inference.by_shape(rec).alias("by_shape"))


def parse_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a record without the fields that classifying gives."""
    rec = parsed(F.concat(F.lit("{"), F.lit(", ".join(f'"{x}": 1' for x in CLASSIFIED)), F.lit(', "timestamp": "t", "message": "m'), F.col("event_id").cast("string"), F.lit('"}')))
    return _numbered(spark, sf_dir).select("event_id", canonical_json(unclassified(rec)).alias("json"))


#: Records with units, at the top, in objects and in lists of objects, and their normalised form.
UNIT_CASES = (
    ('{"latency_ms": "7#s"}', '{"latency_ms": 7#000.0}'),
    ('{"status_code": "1,0#", "note": "5s"}', '{"note": "5s", "status_code": 10#}'),
    ('{"metrics": {"duration": "2m", "deep": {"tokens": "1_00#"}}}', '{"metrics": {"deep": {"tokens": 100#}, "duration": 120000.0}}'),
    ('{"list": [{"ttft": "1h"}, 5, "10s"]}', '{"list": [{"ttft": 3600000.0}, 5, "10s"]}'),
    ('{"duration": "x#", "size": "y"}', '{"duration": "x#", "size": "y"}'),
)


def unit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir, UNIT_CASES).select("event_id", canonical_json(units(F.col("record"))).alias("json"))


def overall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overall(stats.domain_stats(parse(_lines(spark, sf_dir), Options())))


def domain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.domain_metrics(validate(normalise(_lines(spark, sf_dir), Options())))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import events

    return events(spark, sf_dir)


QUERIES = {
    "domain_inference": domain_inference, "parse_surface": parse_surface, "unit_fields": unit_fields, "overall_rate": overall_rate, "domain_metrics": domain_metrics,
    "rule_cases": rule_cases, "rule_operators": rule_operators, "records_in": records_in, "record_order": record_order,
}


def _cases(i: int, cases=RULE_CASES) -> str:
    return f"case event_id % {len(cases)} " + " ".join(f"when {k} then nullif(replace('{x[i]}', '#', cast(event_id as varchar)), '')" for k, x in enumerate(cases)) + " end"


#: What kind of line LINES makes of an event.
KINDS = """k as (select event_id, event_type, case event_type when 'click' then 'http' when 'view' then if(event_id % 2 = 0, 'tokenizer', 'prompt') when 'purchase' then if(event_id % 2 = 0, 'tool', 'planner')
  when 'signup' then if(event_id % 2 = 0, 'data', 'infer') else case event_id % 6 when 0 then 'error' when 1 then 'trace' when 2 then if(event_id % 4 = 0, 'broken build', 'build') when 3 then 'deployment' when 4 then if(event_id % 4 = 0, 'ill', 'well') else 'unknown' end end as kind from events),
 d as (select *, case when kind in ('tokenizer', 'prompt') then 'llm' when kind in ('tool', 'planner') then 'agentic' when kind in ('data', 'infer') then 'cv' else 'core_api' end as domain,
   kind in ('prompt', 'data', 'error', 'trace', 'broken build', 'deployment', 'ill', 'unknown') or kind in ('tokenizer', 'tool') and event_id % 5 = 0 as bad from k)"""
ORACLE_SQL = {
    "domain_inference": f"select event_id, {_cases(1, DOMAIN_CASES)} as by_parse, {_cases(2, DOMAIN_CASES)} as by_contract, {_cases(3, DOMAIN_CASES)} as by_shape from events",
    "parse_surface": """select event_id, '{"timestamp": "t", "message": "m' || event_id || '"}' as json from events""",
    "unit_fields": f"select event_id, {_cases(1, UNIT_CASES)} as json from events",
    "overall_rate": "select count(*) as total, count(*) - count(*) filter (where event_type = 'error' and event_id % 6 = 5) as parsed, 100.0::double * (count(*) - count(*) filter (where event_type = 'error' and event_id % 6 = 5)) / count(*) as rate from events",
    "domain_metrics": f"""with {KINDS}, s as (select domain, kind <> 'unknown' as ok, kind in ('http', 'error', 'trace', 'build', 'well', 'data') as kept from d)
      select domain, count(*) as total, count(*) filter (where ok) as parse_ok, count(*) filter (where not ok) as parse_error, count(*) filter (where ok and not kept) as schema_violation, count(*) as raw_total, count(*) filter (where ok) as raw_ok,
        100.0::double * count(*) filter (where ok) / count(*) as parse_rate, 100.0::double * count(*) filter (where ok) / count(*) as overall_parse_rate from s group by domain""",
    "rule_cases": f"select event_id, {_cases(1)} as rule_id, {_cases(2)} as level from events",
    "rule_operators": " union all ".join(f"select n, '{k}' as condition, count(*) as rows, count(*) filter (where {met}) as met from (select event_id % 10 as n from events) group by n" for k, (_, met) in CONDITIONS.items()),
    "records_in": """select event_id, case event_id % 4 when 0 then 'startup' when 1 then 'http_request' else 'exception' end as event_type, case when event_id % 4 = 1 then '/' || event_id end as endpoint,
      case event_id % 4 when 2 then 'missing_required_fields' when 3 then 'invalid_normalized_record' end as reason,
      case event_id % 4 when 0 then 'api-startup-guard' when 1 then 'core-api-http-2xx-success' else 'core-api-general-event' end as rule_id,
      case event_id % 4 when 0 then 'p' || event_id when 1 then 'http_request_simplified' when 2 then 'core-api-general-event' else 'core-api-general-event' end as parsed_by, true as bare from events""",
    "record_order": """select event_id, '{"timestamp": "t", "level": "info", "outcome": null, "meta": {"a":"x"}, "alpha": ["' || event_id || '"], "zeta": ' || event_id || '}' as json from events""",
    "level_outcome": f"""with {KINDS} select domain, if(bad, 'error', 'info') as level, case when domain = 'llm' then 'running' when bad then 'failure' else 'success' end as outcome,
      case kind when 'http' then 'network' when 'build' then 'build' when 'tokenizer' then 'model_load' when 'prompt' then 'inference' when 'data' then 'data_io' when 'infer' then 'inference' end as sub_category, count(*) as n from d group by all""",
    "rule_first_match": f"""with {KINDS} select case domain when 'llm' then 'llm-general-pipeline' when 'agentic' then 'agentic-general-step' when 'cv' then 'cv-general-phase' else case kind
      when 'http' then case when event_id % 11 = 0 then 'api-5xx-critical' when event_id % 7 = 0 then 'api-4xx-client-error' when event_id % 13 = 0 then 'api-unauthorized' else 'core-api-http-2xx-success' end
      when 'trace' then 'api-python-stacktrace' when 'build' then 'api-build-guard' when 'ill' then 'api-health-check-guard' when 'well' then 'api-health-check-guard' else 'core-api-general-event' end end as rule_id, count(*) as n from d group by all""",
    "contract_check": f"""with {KINDS}, f as (select domain, unnest(case kind when 'tool' then ['|additionalProperties', '/step_kind|enum'] when 'planner' then ['|additionalProperties', '/step_kind|enum'] when 'tokenizer' then ['|additionalProperties']
      when 'prompt' then ['|additionalProperties'] when 'infer' then ['|additionalProperties'] when 'broken build' then ['/event_type|enum', '|then'] when 'deployment' then ['|then'] when 'ill' then ['|then'] when 'unknown' then ['|additionalProperties', '|then'] else [null] end) as x from d)
      select domain, split_part(x, '|', 1) as path, split_part(x, '|', 2) as keyword, count(*) as n from f group by all""",
    "processing_stats": f"""with {KINDS}, s as (select kind <> 'unknown' as ok, kind in ('http', 'error', 'trace', 'build', 'well', 'data') as kept from d)
      select count(*) as total, count(*) filter (where ok) as parsed, count(*) filter (where not ok) as failed, 100.0::double * count(*) filter (where ok) / count(*) as parse_rate,
        count(*) filter (where ok and kept) as validated, count(*) filter (where ok and not kept) as validation_failed, count(*) filter (where not ok) as validation_skipped, 0::bigint as classified,
        case when count(*) filter (where not ok) > 0 then 'no_pattern_match=' || count(*) filter (where not ok) else '' end as failure_reasons from s""",
}


