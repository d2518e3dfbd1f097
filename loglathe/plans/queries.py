"""Registered queries of the log engine, with their SQL.

No table holds log lines, so LINES makes them of ``events``, alike in Spark and in DuckDB.  SQL of
patterns is written out or put together from the same fixed regular expressions as the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..functions.literals import field, text_of
from ..functions.pairs import FORMS, pairs, pattern
from ..operators import comparing, joining, parsing, routing, stats
from ..operators.contracts import check
from ..operators.records import canonical_json
from ..sources.lines import hint_of_name, spread
from . import file_queries, pattern_queries, record_queries, redaction_queries
from .pipeline import Options, classify_lines, normalise, parse, unparsed, validate

LINES = """
select event_id, user_id, event_type, case
  when event_type = 'click' then 'INFO:     10.0.' || cast(user_id % 100 as string) || '.' || cast(event_id % 200 as string) || ':' || cast(30000 + event_id % 1000 as string)
    || ' - "' || case when event_id % 3 = 0 then 'POST' else 'GET' end || ' /items/' || cast(event_id % 50 as string) || ' HTTP/1.1" '
    || case when event_id % 11 = 0 then '503 Service Unavailable' when event_id % 7 = 0 then '404 Not Found' when event_id % 13 = 0 then '401 Unauthorized' else '200 OK' end
  when event_type = 'view' and event_id % 2 = 0 then '[Tokenizer][' || case when event_id % 5 = 0 then 'ERROR' else 'INFO' end || '] vocab size=' || cast(event_id % 5000 as string) || ' latency=' || cast(event_id % 90 as string) || 'ms mode=fast, rank=0.5;'
  when event_type = 'view' then '[Prompt] cache warm prompt_tokens=' || cast(event_id % 4000 as string) || ' ttft=' || cast(event_id % 70 as string) || 's (failed=' || cast(event_id % 2 as string) || ')'
  when event_type = 'purchase' and event_id % 2 = 0 then '[Tool]' || case when event_id % 5 = 0 then '[ERROR]' else '' end || ' web_search k=' || cast(event_id % 9 as string) || ' query=''python logging'' latency=' || cast(event_id % 3000 as string) || 'ms'
  when event_type = 'purchase' then '[Planner] plan_created plan_id=pln-' || cast(event_id % 100 as string) || ' steps=' || cast(event_id % 12 as string) || ' k=1 k=2'
  when event_type = 'signup' and event_id % 2 = 0 then '[Data] Could not open stream fps=' || cast(event_id % 60 as string)
  when event_type = 'signup' then '[Infer] batch done fps=' || cast(event_id % 60 as string) || ' latency=' || cast(event_id % 800 as string) || 'ms'
  when event_id % 6 = 0 then 'ERROR: No matching distribution found for package' || cast(event_id % 30 as string)
  when event_id % 6 = 1 then 'Traceback (most recent call last):'
  when event_id % 6 = 2 then '[Build] ' || case when event_id % 4 = 0 then 'ERROR pip check failed' else 'Downloading uvicorn-0.' || cast(event_id % 30 as string) || '.2-py3-none-any.whl (59 kB)' end
  when event_id % 6 = 3 then '[AppRunner] Service stopped or failed to start, exit code: ' || cast(event_id % 5 as string)
  when event_id % 6 = 4 then 'Health check ' || case when event_id % 4 = 0 then 'failed' else 'is successful' end || ' [Port: ' || cast(3000 + event_id % 100 as string) || ']'
  else 'nothing known here ' || cast(event_id % 10 as string) end as line
from {events}"""
_SQL = LINES.format(events="events").replace("as string)", "as varchar)")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, events=spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as raw events."""
    return lines(spark, sf_dir).select(F.col("event_id").alias("_seq"), "event_type", F.lit("2025-01-01T00:00:00Z").alias("@timestamp"), F.col("line").alias("@message"))


def _q(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _match(text: str, regex: str) -> str:
    return f"regexp_matches({text}, {_q(regex)})"


def _in(text: str, words) -> str:
    return f"{text} in ({', '.join(_q(w) for w in words)})"


def _route_sql() -> str:
    r = routing
    any_of = lambda regexes: "(" + " or ".join(_match("m", x) for x in regexes) + ")"
    look = f"""select *, regexp_extract(m, {_q(r.BRACKET)}, 1) as c, {any_of(r.CORE)} as core, {any_of((r.IMAGE_ENDPOINT, r.CV_WORDS))} as cv,
      {any_of((r.CHAIN_ENTER, r.CHAIN_LINE, r.AGENTIC_WORDS))} as agentic,
      {_match('m', r.MODEL_ENDPOINT)} or case when {_match('m', r.LLM_WORDS)} then not (({_match('m', '(?i)embeddings')} or contains(m, 'tokens_in') or contains(m, 'tokens_out')) and {_match('m', r.CV_WORDS)})
        else {_match('m', '[[](gRPC|Serve|HTTP)]')} and {_match('m', 'LLM|Inference service READY|model=llm|chat/completions')} end as llm from (select *, trim(line) as m from l)"""
    general = "case when core then 'core_api' when agentic then 'agentic' when cv then 'cv' when llm then 'llm' else 'core_api' end"
    close = f"case when cv then 'cv' when {any_of((r.MODEL_ENDPOINT, r.MODEL_SIGNAL))} then 'llm' when core then 'core_api' when llm then 'llm' when agentic then 'agentic' else 'llm' end"
    clear = " ".join(f"when {_in('c', sorted(set(r.COMPONENTS[d]) - set(r.AMBIGUOUS)))} then '{d}'" for d in ("agentic", "cv", "llm"))
    return f"""with l as ({_SQL}), k as ({look}), d as (select event_id, event_type, line, case when m = '' then 'core_api' when {any_of((r.CHAIN_ENTER, r.CHAIN_LINE))} then 'agentic'
      when c = '' then {general} {clear} when {_in('c', r.AMBIGUOUS)} then {close} else {general} end as domain from k)"""


_ROUTED = _route_sql()


def _pattern_sql() -> str:
    p = parsing
    level = lambda name: rf"(?i)\[{name}\](?:\[({p.LEVELS})\])?\s+(.+)"
    own = {
        "core_api": (
            ("http_request_uvicorn", _match("line", p.HTTP_LINE)), ("health_check", _match("line", p.HEALTH)), ("apprunner_event", _match("line", p.DEPLOYMENT)), ("build_event", _match("line", p.BUILD)),
            ("uvicorn_running_simple", _match("line", p.SERVER_RUNNING)), ("uvicorn_info", _match("line", p.SERVER_INFO)),
            ("cli_usage", f"not starts_with(line, 'ERROR:') and ({_match('line', p.USAGE)} or {_match('line', p.TRY)} or {_match('line', p.CLI_ERROR)})"),
            ("http_request_simplified", _match("line", p.HTTP_SHORT)), ("stacktrace_header", _match("line", p.TRACE_HEAD)), ("python_error", _match("line", p.INTERPRETER)),
            ("stacktrace_line", _match("line", p.TRACE_LINE)), ("generic_error", _match("line", p.ERROR)),
        ),
        "llm": (("component_log_with_level", _match("line", p.COMPONENT_LEVEL)), ("component_log_no_level", _match("line", p.COMPONENT))),
        "agentic": (
            ("agent_session_event", _match("line", p.SESSION)), ("graph_state_transition", _match("line", p.TRANSITION)), ("tool_call_event", _match("line", p.TOOL)),
            ("langchain_agent_log", f"{_match('line', p.CHAIN)} or {_match('line', p.CHAIN_STEP)}"), ("agentic_component_log", _match("line", p.AGENT_COMPONENT)),
        ),
        "cv": (("cv_data_load", _match("line", level("Data"))), ("cv_preproc", _match("line", level("Preproc"))), ("cv_model", _match("line", level("Model"))), ("cv_component_log", _match("line", p.VISION))),
    }
    arms = " ".join(f"when domain = '{d}' then case {' '.join(f'when {c} then {_q(n)}' for n, c in ps)} end" for d, ps in own.items())
    return f"{_ROUTED}, p as (select *, case {arms} end as pattern from d)"


_PARSED = _pattern_sql()


def route_domain(spark, sf_dir):
    return routing.route(lines(spark, sf_dir), F.col("line")).groupBy("event_type", "domain").agg(F.count("*").alias("n"))


def best_pattern(spark, sf_dir):
    rows = routing.route(lines(spark, sf_dir), F.col("line")).withColumn("pattern", parsing.pattern_of(F.col("line"), F.col("domain")))
    return rows.groupBy("domain", "pattern").agg(F.count("*").alias("n"), F.max(parsing.confidence_of(F.col("pattern"))).alias("confidence"))


def _fields(spark, sf_dir, domain: str, pattern_id: str, *names: str) -> DataFrame:
    """Fields of the lines that one pattern parses, as text."""
    rows = lines(spark, sf_dir).where(parsing.pattern_of(F.col("line"), F.lit(domain)) == pattern_id).withColumn("f", parsing.fields_of(F.col("line"), F.lit(pattern_id)))
    return rows.select("event_id", *(text_of(field(F.col("f"), n)).alias(n) for n in names))


def _parse_query(domain: str, pattern_id: str, *names: str) -> Callable:
    return lambda spark, sf_dir: _fields(spark, sf_dir, domain, pattern_id, *names)


def _group_sql(regex: str, where: str, **columns: str) -> str:
    inner = ", ".join(f"{v.replace('$', 'regexp_extract(line, ' + _q(regex) + ', ')} as {k}" for k, v in columns.items())
    return f"with l as ({_SQL}) select event_id, {inner} from l where {where}"


def kv_extract(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select("event_id", F.explode(pairs(F.col("line"), "agentic")).alias("key", "literal"))


def _kv_sql() -> str:
    regex = pattern("agentic")
    values = ", ".join(f"regexp_extract_all(line, {_q(regex)}, {i + 2}) as v{i}" for i in range(len(FORMS["agentic"])))
    value = "coalesce(" + ", ".join(f"nullif(v{i}[i], '')" for i in range(len(FORMS["agentic"]))) + ", '')"
    typed = """case when regexp_matches(trim(v), '^[+-]?[0-9](_?[0-9])*$') then cast(cast(replace(v, '_', '') as hugeint) as varchar)
      when regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') then cast(cast(v as double) as varchar) else '"' || replace(replace(v, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' end"""
    return f"""with l as ({_SQL}), a as (select event_id, regexp_extract_all(line, {_q(regex)}, 1) as ks, {values} from l),
      b as (select *, unnest(generate_series(1, len(ks))) as i from a), c as (select event_id, ks[i] as key, i, {value} as v from b),
      e as (select event_id, key, v from c qualify row_number() over (partition by event_id, key order by i desc) = 1)
      select event_id, key, {typed} as literal from e"""


def duration_to_ms(spark, sf_dir):
    found = F.regexp_extract("line", r"(?:latency|ttft)=([^\s,;)]+)", 1)
    return lines(spark, sf_dir).select("event_id", found.alias("text"), units.duration_ms(found).alias("ms")).where("text <> ''")


def clean_numeric(spark, sf_dir):
    text = F.concat(F.floor(F.col("event_id") / 1000).cast("string"), F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.when(F.col("event_id") % 2 == 0, ".5").otherwise(""))
    return lines(spark, sf_dir).select("event_id", text.alias("text"), units.clean_numeric(text).cast("double").alias("number"))


def _normalised(spark, sf_dir) -> DataFrame:
    return normalise(events(spark, sf_dir), Options())


def level_outcome(spark, sf_dir):
    rows = _normalised(spark, sf_dir)
    get = lambda n: text_of(field(F.col("record"), n)).alias(n)
    return rows.select("domain", get("level"), get("outcome"), get("sub_category")).groupBy("domain", "level", "outcome", "sub_category").agg(F.count("*").alias("n"))


def rule_first_match(spark, sf_dir):
    return stats.rule_histogram(classify_lines(events(spark, sf_dir), Options()))


def classify_http(spark, sf_dir):
    """Labels of HTTP lines by status."""
    rows = classify_lines(events(spark, sf_dir).where("event_type = 'click'"), Options())
    get = lambda n: text_of(field(F.col("record"), n)).alias(n)
    rule = F.get_json_object(field(F.col("record"), "provenance"), "$.parser_rule_id").alias("rule_id")
    return rows.select(get("http_status"), get("level"), get("outcome"), rule).groupBy("http_status", "level", "outcome", "rule_id").agg(F.count("*").alias("n"))


def domain_stats(spark, sf_dir):
    return stats.domain_stats(parse(events(spark, sf_dir), Options()))


def top_errors(spark, sf_dir):
    rows = lines(spark, sf_dir).where(F.col("event_type") == "error").withColumn("reason", F.regexp_extract("line", r"^(\[?\w+)", 1))
    return stats.top_reasons(rows, "reason", "event_id", "event_type")


def processing_stats(spark, sf_dir):
    found = stats.processing_stats(validate(_normalised(spark, sf_dir), Options()))
    reasons = F.transform(F.sort_array(F.map_entries("failure_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.withColumn("failure_reasons", F.array_join(reasons, "; "))


def unparsed_lines(spark, sf_dir):
    rows = unparsed(events(spark, sf_dir))
    get = lambda n: text_of(field(F.col("record"), n)).alias(n)
    return rows.select(F.col("_seq").alias("event_id"), get("category"), get("unparsed_reason"), get("event_type"), get("outcome"))


def joiner(spark, sf_dir):
    """Turns of conversations as lines of a stream; the assistant's continue the line before them."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.concat(F.when(F.col("role") == "assistant", F.lit(" ")).otherwise(F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    made = rows.select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("_seq"), F.lit("t").alias("@timestamp"), text.alias("@message"))
    return joining.join_lines(made).select("stream", "place", "final", F.md5("message").alias("digest"))


def label_alignment(spark, sf_dir):
    return comparing.unaligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


def filename_hint(spark, sf_dir):
    name = F.concat(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), F.when(F.col("page_id") % 5 == 0, "_agentic.jsonl").when(F.col("page_id") % 5 == 1, "-LLM.log").when(F.col("page_id") % 5 == 2, ".cv.txt").when(F.col("page_id") % 5 == 3, "_api"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", hint_of_name(F.coalesce(name, F.lit(""))).alias("domain"))


def json_props_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def contract_check(spark, sf_dir):
    rows = check(_normalised(spark, sf_dir), "record", F.col("domain"))
    return rows.select("domain", F.explode_outer("failures").alias("x")).groupBy("domain", "x.path", "x.keyword").agg(F.count("*").alias("n"))


def classified_json(spark, sf_dir):
    return classify_lines(events(spark, sf_dir), Options()).select(F.col("_seq").alias("event_id"), canonical_json(F.col("record")).alias("json"))


def run_digest(spark, sf_dir):
    return comparing.digest(classify_lines(events(spark, sf_dir), Options()))


_HTTP_WHERE = "event_type = 'click'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "route_domain": route_domain,
    "best_pattern": best_pattern,
    "parse_http_access": _parse_query("core_api", "http_request_uvicorn", "level", "client_ip", "client_port", "action", "endpoint", "http_version", "http_status", "status_text"),
    "parse_health": _parse_query("core_api", "health_check", "message", "level", "outcome", "port"),
    "parse_build": _parse_query("core_api", "build_event", "message", "level", "event_type", "package_name"),
    "parse_apprunner": _parse_query("core_api", "apprunner_event", "message", "level", "event_type", "exit_code"),
    "parse_generic_error": _parse_query("core_api", "generic_error", "message", "level", "event_type"),
    "parse_llm_component": _parse_query("llm", "component_log_with_level", "component", "level", "message", "pipeline_stage"),
    "parse_agentic_tool": _parse_query("agentic", "tool_call_event", "level", "tool_name", "message", "step_kind"),
    "parse_cv_data": _parse_query("cv", "cv_data_load", "level", "message", "phase", "outcome"),
    "kv_extract": kv_extract,
    "duration_to_ms": duration_to_ms,
    "clean_numeric": clean_numeric,
    "level_outcome": level_outcome,
    "rule_first_match": rule_first_match,
    "classify_http": classify_http,
    "domain_stats": domain_stats,
    "top_errors": top_errors,
    "processing_stats": processing_stats,
    "unparsed_lines": unparsed_lines,
    "joiner": joiner,
    "label_alignment": label_alignment,
    "filename_hint": filename_hint,
    "json_props_scan": json_props_scan,
    "contract_check": contract_check,
    "classified_json": classified_json,
    "run_digest": run_digest,
    **file_queries.QUERIES,
    **pattern_queries.QUERIES,
    **record_queries.QUERIES,
    **redaction_queries.QUERIES,
}

_STATUS = f"regexp_extract(line, {_q(parsing.HTTP_LINE)}, 7)"
ORACLE_SQL: dict[str, str] = {
    **file_queries.ORACLE_SQL,
    **pattern_queries.ORACLE_SQL,
    **record_queries.ORACLE_SQL,
    **redaction_queries.ORACLE_SQL,
    "route_domain": f"{_ROUTED} select event_type, domain, count(*) as n from d group by all",
    "best_pattern": f"""{_PARSED} select domain, pattern, count(*) as n, max(case pattern {' '.join(f"when '{x['pattern_id']}' then {x['confidence']}::double" for x in parsing.registry())} end) as confidence from p group by domain, pattern""",
    "parse_http_access": _group_sql(parsing.HTTP_LINE, _HTTP_WHERE, level="lower($1))", client_ip="$2)", client_port="$3)", action="$4)", endpoint="$5)", http_version="$6)", http_status="$7)", status_text="$8)"),
    "parse_health": _group_sql(parsing.HEALTH, _match("line", parsing.HEALTH), message="$1)", level="case when contains(line, 'failed') then 'error' else 'info' end", outcome="case when contains(line, 'failed') then 'failure' else 'success' end", port="regexp_extract(line, 'Port: ([0-9]+)', 1)"),
    "parse_build": _group_sql(parsing.BUILD, _match("line", parsing.BUILD), message="$1)", level="case when contains(line, 'ERROR') then 'error' else 'info' end", event_type="case when contains(line, 'ERROR') then 'build_error' else 'dependency_download' end", package_name="case when contains(line, 'Downloading') then 'uvicorn' end"),
    "parse_apprunner": _group_sql(parsing.DEPLOYMENT, _match("line", parsing.DEPLOYMENT), message="$1)", level="'error'", event_type="'service_failure'", exit_code="regexp_extract(line, 'exit code: ([0-9]+)', 1)"),
    "parse_generic_error": f"with l as ({_SQL}) select event_id, line as message, 'error' as level, 'error' as event_type from l where {_match('line', parsing.ERROR)} and not {_match('line', parsing.HTTP_LINE)} and not {_match('line', parsing.HEALTH)} and not {_match('line', parsing.DEPLOYMENT)} and not {_match('line', parsing.BUILD)}",
    "parse_llm_component": _group_sql(parsing.COMPONENT_LEVEL, _match("line", parsing.COMPONENT_LEVEL), component="$1)", level="lower($2))", message="$3)", pipeline_stage="case lower($1)) when 'tokenizer' then 'load' else 'inference' end"),
    "parse_agentic_tool": _group_sql(parsing.TOOL, _match("line", parsing.TOOL), level="case when $1) <> '' then lower($1)) else 'info' end", tool_name="$3)", message="$4)", step_kind="'tool_call'"),
    "parse_cv_data": _group_sql(r"(?i)\[Data\]\s+(.+)", "starts_with(line, '[Data]')", level="'error'", message="$1)", phase="'ingest'", outcome="'failure'"),
    "kv_extract": _kv_sql(),
    "duration_to_ms": f"""with l as ({_SQL}), t as (select event_id, regexp_extract(line, '(?:latency|ttft)=([^\\s,;)]+)', 1) as text from l)
      select event_id, text, cast(regexp_extract(text, '^([0-9.]+)', 1) as double) * case regexp_extract(text, '([a-z]+)$', 1) when 'ms' then 1.0 when 's' then 1000.0 end as ms from t where text <> ''""",
    "clean_numeric": f"""with l as ({_SQL}), t as (select event_id, cast(event_id // 1000 as varchar) || ',' || lpad(cast(event_id % 1000 as varchar), 3, '0') || case when event_id % 2 = 0 then '.5' else '' end as text from l)
      select event_id, text, cast(replace(text, ',', '') as double) as number from t""",
    "classify_http": f"""with l as ({_SQL}), s as (select {_STATUS} as http_status from l where {_HTTP_WHERE})
      select http_status, case http_status when '503' then 'critical' when '200' then 'info' else 'warn' end as level, case http_status when '200' then 'success' else 'failure' end as outcome,
        case http_status when '503' then 'api-5xx-critical' when '401' then 'api-unauthorized' when '200' then 'core-api-http-2xx-success' else 'api-4xx-client-error' end as rule_id, count(*) as n from s group by all""",
    "domain_stats": f"""{_PARSED}, g as (select domain, count(*) as total, count(pattern) as parsed from p group by domain), e as (select unnest(['core_api', 'llm', 'agentic', 'cv']) as domain, unnest([70.0, 95.0, 95.0, 80.0]) as threshold)
      select e.domain, coalesce(total, 0) as total, coalesce(parsed, 0) as parsed, coalesce(total - parsed, 0) as failed, coalesce(100.0::double * parsed / total, 0)::double as rate, threshold::double as threshold, coalesce(100.0::double * parsed / total >= threshold, true) as met from e left join g using (domain)""",
    "top_errors": f"""with l as ({_SQL}), t as (select event_type, regexp_extract(line, '^(\\[?\\w+)', 1) as reason, event_id from l where event_type = 'error'), g as (select event_type, reason, count(*) as n, min(event_id) as f from t group by all)
      select event_type, reason, n, row_number() over (partition by event_type order by n desc, f) as rank from g qualify rank <= 3""",
    "unparsed_lines": f"{_PARSED} select event_id, domain as category, 'no_pattern_match' as unparsed_reason, 'exception' as event_type, 'failure' as outcome from p where pattern is null",
    "joiner": """with m as (select cast(conv_id as varchar) as stream, turn as "at", case when role = 'assistant' then ' ' else '' end || coalesce(text, '') as message from conversations),
      a as (select *, regexp_matches(message, '^[ \t]') as more from m), w as (select *, coalesce(lag(more) over s, true) as earlier, lead(more) over s as later, lead("at") over s as nxt, lead(message) over s as following from a window s as (partition by stream order by "at"))
      select stream, coalesce(case when more then "at" else nxt end, 0) as place, case when more then "at" else nxt end is null as final, md5(case when not more and coalesce(later, false) then message || chr(10) || following else message end) as digest from w where not more or earlier""",
    "label_alignment": "select doc_id, 'left' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'right' from (select doc_id from labels except select doc_id from documents)",
    "filename_hint": """with n as (select page_id, lower(coalesce(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) || case page_id % 5 when 0 then '_agentic.jsonl' when 1 then '-LLM.log' when 2 then '.cv.txt' when 3 then '_api' end, '')) as name from pages)
      select page_id, case when contains(name, 'agentic') then 'agentic' when contains(name, 'core_api') then 'core_api' when contains(name, 'computer_vision') then 'cv' when contains(name, 'cv') then 'cv' when contains(name, 'llm') then 'llm' when contains(name, 'api') then 'core_api' end as domain from n""",
    "json_props_scan": "select event_type, count(k) as n, sum(k)::bigint as total from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by event_type",
}
