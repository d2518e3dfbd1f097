"""Parsing: the first pattern of a domain that a line matches, in the order of their confidence,
gives the line's fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.literals import compiled, looked_up, null, field, obj, overlay, quoted, record, strip, text_of, word
from ..functions.pairs import has_empty_value, pairs

LEVELS = "INFO|WARNING|ERROR|DEBUG|WARN"


@dataclass(frozen=True)
class Pattern:
    name: str
    confidence: float
    matches: Callable[[Column], Column]
    fields: Callable[[Column], Column]
    pairs: str | None = None


def _group(line: Column, regex: str, i: int) -> Column:
    """A group's text; SQL NULL where it took no part (or no characters)."""
    return F.nullif(F.regexp_extract(line, regex, i), F.lit(""))


def _integer(text: Column) -> Column:
    return text.cast("decimal(38,0)").cast("string")


def _has(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for x in words:
        found = found | text.contains(x)
    return found


def _level(message: Column, errors: tuple[str, ...], warnings: tuple[str, ...] = ("warning", "warn")) -> Column:
    low = F.lower(message)
    return F.when(_has(low, *errors), word("error")).when(_has(low, *warnings), word("warning")).otherwise(word("info"))


def _choice(text: Column, table: dict[str, str], other: Column) -> Column:
    """The value of the first of a table's lists of names that holds the text."""
    own = table.get("=", "").split()
    value = looked_up(text, {name: f'"{value}"' for value, names in table.items() if value != "=" for name in names.split()})
    return F.coalesce(value, F.when(text.isin(own), quoted(text)) if own else value, other)


# --- patterns of the core domain (regular expressions are fixed values) ---

HTTP_LINE = r"(?:(INFO|WARNING|ERROR|DEBUG):\s+)?([\d.]+):(\d+)\s+-\s+\"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+([^\s]+)\s+HTTP/([\d.]+)\"\s+(\d{3})\s*(.*)?"
HTTP_SHORT = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/[^\s]*)\s+(\d{3})(?:\s+(\d+)ms)?$"
SERVER_INFO = r"^(INFO|WARNING|DEBUG):\s+(.+)$"
SERVER_RUNNING = r"(?i)^Uvicorn running on http://([^:]+):(\d+)\b.*"
HEALTH = r"(?i)^((?:Health|Readiness|Liveness) check.*|Performing health check.*)$"
DEPLOYMENT, BUILD = r"\[AppRunner\]\s+(.+)", r"\[Build\]\s+(.+)"
USAGE, TRY, CLI_ERROR = r"(?i)^Usage:\s+(\S[^\s]*)", r"(?i)^Try\s+'([^']+)'\s+for help\.", r"^Error:\s+(.+)$"
TRACE_HEAD = r"^Traceback\s+\(most recent call last\):$"
TRACE_LINE = r"^\s*File\s+\"([^\"]+)\",\s+line\s+(\d+),\s+in\s+(.+)$"
INTERPRETER = r"^(/[^:]+python[0-9.]*)\s*:\s*(.+)$"
ERROR = r"(?i)(?:(\w+Error|ERROR|Exception):\s*(.+)|(.+(?:error|failed|exception).+))"


def _http(line: Column) -> Column:
    g = lambda i: _group(line, HTTP_LINE, i)
    return record(
        level=F.coalesce(quoted(F.lower(g(1))), word("info")), client_ip=quoted(g(2)), client_port=_integer(g(3)), action=quoted(g(4)), endpoint=quoted(g(5)),
        http_version=quoted(g(6)), http_status=_integer(g(7)), status_text=quoted(F.regexp_extract(line, HTTP_LINE, 8)), category=word("http"), event_type=word("http_request"), message=quoted(line),
    )


def _http_short(line: Column) -> Column:
    g = lambda i: _group(line, HTTP_SHORT, i)
    return record(action=quoted(g(1)), endpoint=quoted(g(2)), http_status=_integer(g(3)), response_time=F.coalesce(_integer(g(4)), null()), category=word("http"), event_type=word("http_request"), level=word("info"), message=quoted(line))


def _health(line: Column) -> Column:
    low = F.lower(line)
    bad, good = _has(low, "failed", "unhealthy"), _has(low, "successful", "passed", "routing traffic")
    return record(
        message=quoted(_group(line, HEALTH, 1)), category=word("service"), event_type=word("health_check"), level=F.when(bad, word("error")).otherwise(word("info")),
        outcome=F.when(bad, word("failure")).when(good, word("success")), port=_integer(_group(line, r"[Pp]ort[:\s]+(\d+)", 1)),
    )


def _deployment(line: Column) -> Column:
    message = _group(line, DEPLOYMENT, 1)
    failed = message.contains("stopped or failed to start")
    kind = F.when(message.contains("Deployment Artifact"), "deployment_artifact").when(_has(message, "Pulling source code", "Successfully pulled"), "source_pull")
    kind = kind.when(message.contains("deletion started"), "service_deletion").when(failed, "service_failure").when(F.lower(message).contains("pipeline"), "pipeline_event").otherwise("apprunner_event")
    return record(
        message=quoted(message), service=word("AppRunner"), category=word("service"), event_type=quoted(kind),
        exit_code=F.when(kind == "service_failure", _integer(_group(message, r"exit code:\s*(\d+)", 1))), level=_level(message, ("failed", "error"), ("warning",)),
    )


def _build(line: Column) -> Column:
    message = _group(line, BUILD, 1)
    bad, odd = message.contains("ERROR"), message.contains("WARNING")
    loads = ~bad & ~odd & message.contains("Downloading")
    kind = F.when(bad, "build_error").when(odd, "build_warning").when(loads, "dependency_download").when(message.contains("Installing"), "dependency_install").otherwise("build_event")
    return record(
        message=quoted(message), service=word("Build"), category=word("build"), level=F.when(bad, word("error")).when(odd, word("warning")).otherwise(word("info")), event_type=quoted(kind),
        package_name=F.when(loads, quoted(_group(message, r"Downloading\s+([\w\-]+?)(?:-\d|\s)", 1))),
    )


#: Events of a server's lines by what they hold, in order (fixed values).
SERVER_EVENTS = (
    ("Uvicorn running on http://", "server_running"),
    ("Started server process", "server_start"),
    ("Finished server process", "server_stop"),
    ("Waiting for application startup", "startup"),
    ("Application startup complete", "startup"),
    ("Waiting for application shutdown", "shutdown"),
    ("Application shutdown complete", "shutdown"),
    ("Detected file change in", "file_change"),
    ("Received signal", "signal_received"),
)


def _server(line: Column) -> Column:
    message = _group(line, SERVER_INFO, 2)
    kind = F
    for text, name in SERVER_EVENTS:
        kind = kind.when(message.contains(text), name)
    kind = kind.otherwise("service_event")
    address = r"http://([^:]+):(\d+)"
    only = lambda name, value: F.when(kind == name, value)
    return record(
        level=quoted(F.lower(_group(line, SERVER_INFO, 1))), message=quoted(message), service=word("uvicorn"), category=word("service"), event_type=quoted(kind),
        host=only("server_running", quoted(_group(message, address, 1))), port=only("server_running", _integer(_group(message, address, 2))),
        file=only("file_change", quoted(_group(message, r"Detected file change in '([^']+)'", 1))), signal=only("signal_received", quoted(_group(message, r"Received signal ([A-Z0-9_-]+)", 1))),
    )


def _running(line: Column) -> Column:
    return record(host=quoted(_group(line, SERVER_RUNNING, 1)), port=_integer(_group(line, SERVER_RUNNING, 2)), service=word("uvicorn"), category=word("service"), event_type=word("server_running"), level=word("info"), message=quoted(line))


def _usage(line: Column) -> Column:
    command = F.coalesce(_group(line, USAGE, 1), _group(line, TRY, 1))
    asks = line.rlike(USAGE) | line.rlike(TRY)
    return record(
        category=word("cli"), level=F.when(asks, word("info")).otherwise(word("error")), event_type=F.when(asks, word("usage")).otherwise(word("error")),
        command=quoted(command), message=F.when(asks, quoted(line)).otherwise(quoted(_group(line, CLI_ERROR, 1))),
    )


def _failure(kind: str, message: Column, error: Column, **more: Column) -> Column:
    return record(level=word("error"), category=word("error"), event_type=word(kind), message=message, error=error, **more)


def _trace_line(line: Column) -> Column:
    g = lambda i: _group(line, TRACE_LINE, i)
    return _failure("stacktrace", quoted(strip(line)), obj(file=quoted(g(1)), line=_integer(g(2)), function=quoted(g(3)), type=word("stacktrace"), message=quoted(line)))


def _interpreter(line: Column) -> Column:
    return _failure("python_error", quoted(line), obj(message=quoted(_group(line, INTERPRETER, 2)), type=word("python_error")), python_path=quoted(_group(line, INTERPRETER, 1)))


def _error(line: Column) -> Column:
    # the plain form's group is read last and is empty where the other form matched: the whole line stands in
    plain = F.coalesce(_group(line, ERROR, 3), line)
    return _failure("error", quoted(line), obj(type=quoted(F.coalesce(_group(line, ERROR, 1), F.lit("generic_error"))), message=quoted(plain)))


CORE_PATTERNS = (
    Pattern("http_request_uvicorn", 0.95, lambda x: x.rlike(HTTP_LINE), _http),
    Pattern("health_check", 0.90, lambda x: x.rlike(HEALTH), _health),
    Pattern("apprunner_event", 0.90, lambda x: x.rlike(DEPLOYMENT), _deployment),
    Pattern("build_event", 0.90, lambda x: x.rlike(BUILD), _build),
    Pattern("uvicorn_running_simple", 0.90, lambda x: x.rlike(SERVER_RUNNING), _running),
    Pattern("uvicorn_info", 0.85, lambda x: x.rlike(SERVER_INFO), _server),
    Pattern("cli_usage", 0.85, lambda x: ~x.startswith("ERROR:") & (x.rlike(USAGE) | x.rlike(TRY) | x.rlike(CLI_ERROR)), _usage),
    Pattern("http_request_simplified", 0.85, lambda x: x.rlike(HTTP_SHORT), _http_short),
    Pattern("stacktrace_header", 0.80, lambda x: x.rlike(TRACE_HEAD), lambda x: _failure("stacktrace", quoted(strip(x)), obj(type=word("stacktrace"), message=quoted(strip(x))))),
    Pattern("python_error", 0.80, lambda x: x.rlike(INTERPRETER), _interpreter),
    Pattern("stacktrace_line", 0.75, lambda x: x.rlike(TRACE_LINE), _trace_line),
    Pattern("generic_error", 0.70, lambda x: x.rlike(ERROR), _error),
)

# --- language models ---

COMPONENT_LEVEL = r"(?i)\[([^\]]+)\]\[(INFO|WARNING|ERROR|DEBUG)\]\s+(.+)"
COMPONENT = r"\[([^\]]+)\]\s+(.+)"
#: Stages by component (fixed values); ``=`` stands for the component's own name.
STAGES_LEVEL = {
    "load": "tokenizer model loader quant kvcache",
    "generate": "sampler config context",
    "=": "rag embeddings",
    "safety_check": "safety pii guardrails policies",
    "cache": "cache",
    "train": "train trainer lora qlora optimizer checkpoint eval merge export",
    "serve": "http stream sse grpc",
}
STAGES_PLAIN = STAGES_LEVEL | {
    "generate": "sampler config context metrics monitor",
    "serve": "http stream sse grpc serve",
    "system": "hw distributed mps",
    "routing": "router auth ratelimit planner",
}


def _model_level(line: Column) -> Column:
    g = lambda i: _group(line, COMPONENT_LEVEL, i)
    return record(component=quoted(g(1)), level=quoted(F.lower(g(2))), message=quoted(g(3)), category=word("llm"), pipeline_stage=_choice(F.lower(g(1)), STAGES_LEVEL, word("inference")))


def _model_plain(line: Column) -> Column:
    name, message = _group(line, COMPONENT, 1), _group(line, COMPONENT, 2)
    return record(component=quoted(name), message=quoted(message), level=_level(message, ("error", "failed", "exception")), category=word("llm"), pipeline_stage=_choice(F.lower(name), STAGES_PLAIN, word("inference")))


LLM_PATTERNS = (
    Pattern("component_log_with_level", 0.95, lambda x: x.rlike(COMPONENT_LEVEL), _model_level, "llm_level"),
    Pattern("component_log_no_level", 0.85, lambda x: x.rlike(COMPONENT), _model_plain, "llm_plain"),
)

# --- agents ---

SESSION = r"(?i)\[Agent\]\s+(session_start|session_end)\s+(.+)"
TRANSITION = r"(?i)\[Graph\]\s+state=(\w+)\s*->\s*(\w+)\s+(.*)"
TOOL = rf"(?i)\[Tool\](?:\[({LEVELS})\])?\s+(call)?\s*(\w+)\s+(.*)"
CHAIN, CHAIN_STEP = r"^>\s+(.+)$", r"^(Action Input|Action|Observation|Thought|Final Answer):\s*(.*)$"
AGENT_COMPONENT = rf"(?i)\[([^\]]+)\](?:\[({LEVELS})\])?\s+(.+)"
#: Kinds of step by the word that a line starts with, and by component (fixed values).
CHAIN_STEPS = {"Thought": "reasoning", "Action": "tool_selection", "Action Input": "tool_input", "Observation": "tool_output", "Final Answer": "final_answer"}
STEPS = {
    "plan": "planner plan",
    "tool_selection": "selector ranker arbiter",
    "memory_access": "memory cache",
    "safety_check": "guard guardrails safety policies",
    "retrieval": "rag retrieval embeddings",
    "verification": "verifier validator checker",
    "code_gen": "coder codegen",
    "code_review": "reviewer review",
    "error_recovery": "selfheal repair",
    "handoff": "handoff delegation",
    "approval_request": "humangate approval",
    "cost_tracking": "cost billing",
    "metrics": "metrics monitor diagnostics",
    "stream_event": "events sse stream",
    "rate_limit": "ratelimit throttle",
    "auth": "auth authentication",
    "retry": "retry backoff",
    "circuit_breaker": "circuitbreaker breaker",
    "orchestration": "orchestrator coordinator",
    "research": "researcher research",
    "timeout": "timeout deadline",
    "cancel": "cancel cancellation",
    "route": "router routing",
    "sampling": "sampler sampling",
    "format": "json parser formatter",
    "sanitization": "security sanitizer",
    "audit": "compliance audit",
    "output": "output deliver delivery",
    "shutdown": "shutdown cleanup",
    "input_processing": "input extractor observe observer aggregator",
    "config": "registry capabilities",
    "fallback": "fallback",
    "structured_output": "structured",
}


def _session(line: Column) -> Column:
    return record(step_kind=quoted(_group(line, SESSION, 1)), message=quoted(_group(line, SESSION, 2)), category=word("workflow"), level=word("info"))


def _transition(line: Column) -> Column:
    g = lambda i: _group(line, TRANSITION, i)
    return record(from_state=quoted(g(1)), to_state=quoted(g(2)), message=quoted(F.regexp_extract(line, TRANSITION, 3)), category=word("workflow"), step_kind=word("state_transition"), level=word("info"))


def _tool(line: Column) -> Column:
    g = lambda i: _group(line, TOOL, i)
    message = F.regexp_extract(line, TOOL, 4)
    level = F.coalesce(quoted(F.lower(g(1))), _level(message, ("error", "failed")))
    return record(level=level, action=F.coalesce(quoted(g(2)), null()), tool_name=quoted(g(3)), message=quoted(message), category=word("tool"), step_kind=word("tool_call"))


def _chain(line: Column) -> Column:
    inner, starts = _group(line, CHAIN, 1), line.rlike(CHAIN)
    kind = F.when(inner.contains("Entering new"), "chain_start").when(inner.contains("Finished") & inner.contains("chain"), "chain_end").otherwise("step")
    step = looked_up(_group(line, CHAIN_STEP, 1), CHAIN_STEPS)
    return record(
        category=word("workflow"), level=word("info"), message=F.when(starts, quoted(inner)).otherwise(quoted(F.regexp_extract(line, CHAIN_STEP, 2))), step_kind=quoted(F.when(starts, kind).otherwise(step)),
        chain_name=F.when(starts & (kind == "chain_start"), quoted(_group(inner, r"Entering new\s+([A-Za-z0-9_]+)\s+chain", 1))),
    )


def _agent(line: Column) -> Column:
    g = lambda i: _group(line, AGENT_COMPONENT, i)
    level = F.coalesce(quoted(F.lower(g(2))), _level(g(3), ("error", "failed")))
    return record(component=quoted(g(1)), level=level, message=quoted(g(3)), category=word("workflow"), step_kind=_choice(F.lower(g(1)), STEPS, word("step")))


AGENTIC_PATTERNS = (
    Pattern("agent_session_event", 0.98, lambda x: x.rlike(SESSION), _session, "session"),
    Pattern("graph_state_transition", 0.98, lambda x: x.rlike(TRANSITION), _transition, "session"),
    Pattern("tool_call_event", 0.95, lambda x: x.rlike(TOOL), _tool, "tool"),
    Pattern("langchain_agent_log", 0.90, lambda x: x.rlike(CHAIN) | x.rlike(CHAIN_STEP), _chain),
    Pattern("agentic_component_log", 0.85, lambda x: x.rlike(AGENT_COMPONENT), _agent, "agentic"),
)

# --- computer vision ---

VISION = r"(?i)\[([^\]]+)\](?:\[([^\]]+)\])?(?:\[(" + LEVELS + r")\])?\s+(.+)"
#: Phases by component (fixed values); other components leave the phase open.
PHASES = {"inference": "infer inference", "postprocess": "post postproc postprocess", "track": "track tracking", "eval": "eval evaluation metrics", "serve": "serve server grpc", "pose": "pose"}


def _stage(name: str, phase: str, errors: tuple[str, ...], warnings: tuple[str, ...] = ("warning", "warn"), form: str = "cv", failed: bool = False) -> Pattern:
    regex = rf"(?i)\[{name}\](?:\[({LEVELS})\])?\s+(.+)"

    def fields(line: Column) -> Column:
        message = _group(line, regex, 2)
        level = F.coalesce(quoted(F.lower(_group(line, regex, 1))), _level(message, errors, warnings))
        bad = (level == '"error"') | (F.lower(message).contains("failed") if failed else F.lit(False))
        return record(level=level, message=quoted(message), category=word("cv"), phase=word(phase), outcome=F.when(bad, word("failure")).otherwise(word("success")))

    return Pattern({"Data": "cv_data_load", "Preproc": "cv_preproc", "Model": "cv_model"}[name], 0.95, lambda x: x.rlike(regex), fields, form)


def _vision(line: Column) -> Column:
    g = lambda i: _group(line, VISION, i)
    second = F.upper(g(2)).isin(LEVELS.split("|"))
    level = F.coalesce(quoted(F.lower(F.coalesce(g(3), F.when(second, g(2))))), _level(g(4), ("error", "failed")))
    outcome = F.when(level == '"error"', word("failure")).otherwise(word("success"))
    part = F.when(~F.coalesce(second, F.lit(False)), F.coalesce(quoted(g(2)), null()))
    return record(component=quoted(g(1)), subcomponent=part, level=level, message=quoted(g(4)), category=word("cv"), phase=_choice(F.lower(g(1)), PHASES, F.lit(None).cast("string")), outcome=outcome)


CV_PATTERNS = (
    _stage("Data", "ingest", ("error", "failed", "could not"), failed=True),
    _stage("Preproc", "preprocess", ("error", "invalid")),
    _stage("Model", "serve", ("error", "failed"), ("warning", "warn", "missing"), "cv_model"),
    Pattern("cv_component_log", 0.85, lambda x: x.rlike(VISION), _vision, "cv_component"),
)

PATTERNS = {"core_api": CORE_PATTERNS, "llm": LLM_PATTERNS, "agentic": AGENTIC_PATTERNS, "cv": CV_PATTERNS}
VERSION = "1.0.0"


@dataclass(frozen=True)
class Registry:
    """The patterns of each domain, in the order in which they are tried."""

    domains: tuple[tuple[str, tuple[Pattern, ...]], ...]

    def __iter__(self):
        return (p for _, patterns in self.domains for p in patterns)


BUILT_IN = Registry(tuple(PATTERNS.items()))


def registry(patterns: Registry = BUILT_IN) -> list[dict]:
    """What patterns there are, in the order in which they are tried."""
    return [{"domain": d, "pattern_id": p.name, "confidence": p.confidence, "parser_name": f"{d}_parser", "parser_version": VERSION} for d, ps in patterns.domains for p in ps]


@compiled
def pattern_of(line: Column, domain: Column, patterns: Registry = BUILT_IN) -> Column:
    """The name of the pattern that a line of a domain matches, or SQL NULL."""
    chain = F
    for name, own in patterns.domains:
        inner = F
        for p in own:
            inner = inner.when(p.matches(line), p.name)
        if own:
            chain = chain.when(domain == name, inner)
    return chain


def confidence_of(pattern: Column, patterns: Registry = BUILT_IN) -> Column:
    return looked_up(pattern, {p.name: str(p.confidence) for p in patterns}).cast("double")


@compiled
def fields_of(line: Column, pattern: Column, patterns: Registry = BUILT_IN) -> Column:
    """The fields that a line's pattern reads, without the message's pairs."""
    chain = F
    for p in patterns:
        chain = chain.when(pattern == p.name, p.fields(line))
    return chain


@compiled
def pairs_of(message: Column, pattern: Column, patterns: Registry = BUILT_IN) -> Column:
    """The pairs of a message, in the form of its pattern; SQL NULL where the pattern has none."""
    by: dict[str, list[str]] = {}
    for p in patterns:
        if p.pairs:
            by.setdefault(p.pairs, []).append(p.name)
    chain = F
    for form, names in by.items():
        chain = chain.when(pattern.isin(names), pairs(message, form))
    return chain


@compiled
def with_pairs(fields: Column, found: Column, pattern: Column) -> Column:
    """fields with a message's pairs, which may overwrite any of them; a tool's outcome is judged by
    the level that the pairs may have set."""
    level = F.coalesce(field(found, "level"), field(fields, "level"))
    outcome = F.when(level == '"error"', word("failure")).otherwise(word("success"))
    return F.when(found.isNull(), fields).when(pattern == "tool_call_event", overlay(fields, F.map_concat(F.map_filter(found, lambda k, _: k != "outcome"), record(outcome=outcome)))).otherwise(overlay(fields, found))


def breaks_compatibly(line: Column, pattern: Column, fields: Column, patterns: Registry = BUILT_IN) -> Column:
    """Whether an empty quoted value fails the record in the compatible mode."""
    forms = {p.name: p.pairs for p in patterns if p.pairs}
    bad = F.lit(False)
    for name, form in forms.items():
        bad = bad | ((pattern == name) & has_empty_value(line, form))
    return F.coalesce(bad & fields.isNotNull(), F.lit(False))
