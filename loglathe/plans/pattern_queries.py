"""A query for each pattern that LINES of the other queries don't reach.

Lines are made of ``events`` by number, so that the SQL can tell every field from the number alone,
without any of the engine's regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import field, text_of
from ..sources.lines import spread
from .pipeline import Options, parse


@dataclass(frozen=True)
class Case:
    """A line, as an SQL expression over event_id (n is its text), the pattern that should parse it and
    the fields that it should give."""

    domain: str
    pattern: str
    line: str
    fields: dict[str, str]


CASES = (
    Case("core_api", "http_request_simplified", "'GET /api/items/' || n || ' 200 ' || n || 'ms'", {"action": "'GET'", "endpoint": "'/api/items/' || n", "http_status": "'200'", "response_time": "n", "level": "'info'", "event_type": "'http_request'"}),
    Case("core_api", "uvicorn_running_simple", "'Uvicorn running on http://host' || n || ':8000 (Press CTRL+C to quit)'", {"host": "'host' || n", "port": "'8000'", "service": "'uvicorn'", "event_type": "'server_running'"}),
    Case("core_api", "uvicorn_info", "'WARNING:  Detected file change in ''app' || n || '.py''. Reloading...'", {"level": "'warning'", "event_type": "'file_change'", "file": "'app' || n || '.py'", "message": "'Detected file change in ''app' || n || '.py''. Reloading...'"}),
    Case("core_api", "cli_usage", "'Usage: app' || n || ' [OPTIONS] NAME'", {"command": "'app' || n", "event_type": "'usage'", "level": "'info'", "category": "'cli'"}),
    Case("core_api", "stacktrace_header", "'Traceback (most recent call last):'", {"message": "'Traceback (most recent call last):'", "level": "'error'", "event_type": "'stacktrace'"}),
    Case("core_api", "python_error", "'/usr/bin/python3: No module named mod' || n", {"python_path": "'/usr/bin/python3'", "error": "'{\"message\":\"No module named mod' || n || '\",\"type\":\"python_error\"}'", "event_type": "'python_error'"}),
    Case("core_api", "stacktrace_line", "'  File \"/srv/app.py\", line ' || n || ', in handler'", {"message": "'File \"/srv/app.py\", line ' || n || ', in handler'", "event_type": "'stacktrace'", "category": "'error'"}),
    Case("llm", "component_log_no_level", "'[Loader] failed shard=' || n || ' ratio=0.5)'", {"component": "'Loader'", "level": "'error'", "pipeline_stage": "'load'", "shard": "n", "ratio": "'0.5'", "message": "'failed shard=' || n || ' ratio=0.5)'"}),
    Case("agentic", "agent_session_event", "'[Agent] session_start id=''s ' || n || ''' locale=en'", {"step_kind": "'session_start'", "id": "'s ' || n", "locale": "'en'", "level": "'info'", "category": "'workflow'"}),
    Case("agentic", "graph_state_transition", "'[Graph] state=PLAN -> ACT reason=\"r ' || n || '\" turn=' || n", {"from_state": "'PLAN'", "to_state": "'ACT'", "reason": "'r ' || n", "turn": "n", "step_kind": "'state_transition'"}),
    Case("agentic", "langchain_agent_log", "'> Entering new Exec' || n || ' chain...'", {"step_kind": "'chain_start'", "chain_name": "'Exec' || n", "message": "'Entering new Exec' || n || ' chain...'"}),
    Case("agentic", "agentic_component_log", "'[Verifier][WARNING] weak args={a: ' || n || '} tags=[x, y] score=0.25;'", {"component": "'Verifier'", "level": "'warning'", "step_kind": "'verification'", "args": "'{a: ' || n || '}'", "tags": "'[x, y]'", "score": "'0.25'"}),
    Case("agentic", "tool_call_event", "'[Tool] call search' || n || ' opts={k: 1} failed=yes'", {"action": "'call'", "tool_name": "'search' || n", "level": "'error'", "outcome": "'failure'", "opts": "'{k: 1}'", "failed": "'yes'"}),
    Case("cv", "cv_preproc", "'[Preproc] invalid resize width=' || n || ', height=4'", {"level": "'error'", "phase": "'preprocess'", "outcome": "'failure'", "width": "n", "height": "'4'"}),
    Case("cv", "cv_model", "'[Model][INFO] loaded name=\"net ' || n || '\" shape=[1, 3] mem=7'", {"level": "'info'", "phase": "'serve'", "outcome": "'success'", "name": "'net ' || n", "shape": "'[1, 3]'", "mem": "'7'"}),
    Case("cv", "cv_component_log", "'[Track][Batch][WARNING] slow fps=' || n || ' roi={x: 1}'", {"component": "'Track'", "subcomponent": "'Batch'", "level": "'warning'", "phase": "'track'", "outcome": "'success'", "fps": "n", "roi": "'{x: 1}'"}),
)


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").select("event_id", F.expr("cast(event_id as string)").alias("n"))
        lines = made.select("event_id", F.lit("t").alias("@timestamp"), F.expr(case.line).alias("@message"))
        done = parse(lines, Options(domain=case.domain))
        return done.select("event_id", "pattern", *(text_of(field(F.col("fields"), x)).alias(f"f_{x}") for x in case.fields))

    return run


QUERIES = {f"pattern_{x.pattern}": _query(x) for x in CASES}
ORACLE_SQL = {
    f"pattern_{x.pattern}": f"with e as (select event_id, cast(event_id as varchar) as n from events) select event_id, '{x.pattern}' as pattern, " + ", ".join(f"{v} as f_{k}" for k, v in x.fields.items()) + " from e"
    for x in CASES
}
