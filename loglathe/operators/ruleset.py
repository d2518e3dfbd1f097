"""The rules, in order: guards, each domain's critical ones, warnings and information, each domain's
backstop, then the global ones.  Thresholds without a published value are ours."""

from __future__ import annotations

RULES_VERSION = "v1.0.0"
#: Fields that an alias looks in, in order (fixed values).
ALIASES = {
    "@status": ["outcome", "status", "result", "response.status"],
    "@latency": ["latency_ms", "duration_ms", "ttft_ms"],
    "@errorCode": ["http_status", "error.code", "response.status_code"],
    "@model": ["model", "model_name"],
    "@failed": ["failed", "failure"],
}


def _at(field: str, op: str, value=None, **more) -> dict:
    return {"field": field, "op": op} | ({} if value is None else {"value": value}) | more


def _all(*conditions: dict) -> dict:
    return {"all": list(conditions)}


def _any(*conditions: dict) -> dict:
    return {"any": list(conditions)}


def _range(field: str, low: float, high: float) -> dict:
    return _all(_at(field, "gte", low), _at(field, "lt", high))


def _missing(field: str) -> dict:
    return {"not": _at(field, "exists")}


def _rule(name: str, domain: str | None, when: dict, level: str, sub: str | None, outcome: str | None, tags: str, title: str | None = None, category: str | None = None) -> dict:
    category = category or {"computer_vision": "cv", None: "core_api"}.get(domain, domain)
    action = {"level": level, "category": category, "sub_category": sub, "outcome": outcome, "tags": tags.split(",")}
    return {"id": name, "version": "1.0.0", "name": title or name.replace("-", " ").capitalize(), "applies_to": [domain] if domain else [], "when": when, "action": {k: v for k, v in action.items() if v is not None}}


_CORE, _LLM, _AGENT, _CV = "core_api", "llm", "agentic", "computer_vision"
_FAILED, _SUCCEEDED = _at("outcome", "eq", "failure"), _at("outcome", "eq", "success")

RULES = [
    _rule("api-startup-guard", _CORE, _at("event_type", "eq", "startup"), "info", None, None, "startup,guard"),
    _rule("api-build-guard", _CORE, _at("event_type", "in", ["build", "dependency_install"]), "info", "build", None, "core_api,build,guard", "Filter build events (noise guard)"),
    _rule("api-health-check-guard", _CORE, _at("event_type", "eq", "health_check"), "info", None, None, "health"),
    _rule("api-5xx-critical", _CORE, _range("http_status", 500, 600), "critical", "service", "failure", "core_api,5xx"),
    _rule("api-unauthorized", _CORE, _at("http_status", "in", [401, 403]), "warn", "auth", "failure", "core_api,auth"),
    _rule("api-conflict-error", _CORE, _at("@errorCode", "eq", 409), "warn", "data", "failure", "core_api,conflict"),
    _rule("api-4xx-client-error", _CORE, _range("http_status", 400, 500), "warn", None, "failure", "4xx"),
    _rule("api-high-latency", _CORE, _all(_at("latency_ms", "gte", 2000), _SUCCEEDED), "warn", None, None, "latency"),
    _rule("core-api-error-rate-high", _CORE, _at("meta.raw_message", "extract_percent", pattern=r"(?i)error[_ ]?rate\D{0,12}([\d.]+)\s*%", gte=10), "warn", "metrics", "failure", "core_api,error_rate"),
    _rule("api-python-stacktrace", _CORE, _at("error.type", "eq", "stacktrace"), "error", "service", "failure", "core_api,stacktrace", "Python stacktrace"),
    _rule("core-api-http-2xx-success", _CORE, _range("http_status", 200, 300), "info", "service", "success", "core_api,http_success", "HTTP 2xx successful responses"),
    _rule("llm-safety-flag-critical", _LLM, _any(_at("safety_flags", "contains", "policy_violation"), _at("result.safety_flags", "contains", "policy_violation")), "critical", "safety", "failure", "llm,safety"),
    _rule("llm-token-budget-exceeded", _LLM, _any(_at("usage.prompt_tokens", "gte", 8000), _at("usage.total_tokens", "gte", 10000)), "warn", "rate_limit", "failure", "llm,token_budget"),
    _rule("llm-rate-limited", _LLM, {"field_any": ["http_status", "error.code"], "op": "eq", "value": 429}, "error", "rate_limit", "failure", "llm,rate_limited"),
    _rule("llm-kv-cache-anomaly", _LLM, {"field_any": ["kv_cache_usage_percent", "metrics.kv_cache_usage_percent"], "op": "gte", "value": 90}, "warn", "kv_cache", "failure", "llm,kv_cache"),
    _rule("llm-ttft-anomalous", _LLM, _all(_at("ttft_ms", "gte", 1500), _SUCCEEDED), "warn", "metrics", "success", "llm,latency,ttft"),
    _rule("llm-tokenizer-error", _LLM, _all(_at("pipeline_stage", "eq", "tokenizer"), _FAILED, _at("meta.raw_message", "regex", r"(?i)tokenizer|vocab|merges")), "error", "tokenizer", "failure", "llm,tokenizer"),
    _rule("llm-quant-incompatible", _LLM, _all(_at("pipeline_stage", "eq", "quant"), _FAILED, {"field_any": ["meta.raw_message", "error.message", "message"], "op": "contains", "value": "incompatible"}), "error", "quantization", "failure", "llm,quant"),
    _rule("llm-rag-timeout", _LLM, _all(_at("pipeline_stage", "in", ["rag_retrieve", "rag_embed"]), _at("@latency", "gte", 1000), _FAILED), "error", "rag_timeout", "timeout", "llm,rag"),
    _rule("agentic-planner-long-running", _AGENT, _all(_at("tool_name", "eq", "planner"), _at("duration_ms", "gte", 60000)), "info", "planner", "running", "agentic,planner"),
    _rule("agentic-guardrail-triggered", _AGENT, _at("guardrails_triggered", "exists"), "critical", "security", None, "guardrail"),
    _rule("agentic-cost-anomaly", _AGENT, _at("cost_tracking.total_cost_usd", "gte", 100), "warn", None, None, "cost"),
    _rule("agentic-missing-error-context", _AGENT, _all(_at("status", "eq", "failed"), _missing("error")), "warn", "tracking", "failure", "agentic,missing_context"),
    _rule("agentic-tool-dependency-error", _AGENT, _all(_at("status", "eq", "failed"), _at("error.message", "regex", "ModuleNotFound|ImportError")), "error", "dependency", "failure", "agentic,dependency"),
    _rule("agentic-tool-failure", _AGENT, _all(_at("step_kind", "eq", "tool_call"), _at("status", "eq", "failed")), "error", None, "failure", "tool_failure"),
    _rule("agentic-search-slow", _AGENT, _all(_at("tool_name", "contains", "search"), _at("status", "eq", "success"), _at("duration_ms", "gte", 1500)), "warn", "tool_call", "success", "agentic,slow,search"),
    _rule("agentic-tool-slow", _AGENT, _all(_at("status", "in", ["success", "retry"]), _at("duration_ms", "gte", 5000)), "warn", "tool_call", "success", "agentic,slow"),
    _rule("cv-gpu-oom", _CV, _all(_FAILED, _at("error.message", "contains", "CUDA out of memory")), "error", None, None, "oom"),
    _rule("cv-training-loss-spike", _CV, _all(_at("phase", "eq", "training"), _at("metrics.loss", "gt", 5.0)), "warn", "model", "failure", "cv,loss_spike"),
    _rule("cv-inference-map-low", _CV, _any(_at("metrics.mAP", "lt", 0.30), _at("metrics.mAP_50_95", "lt", 0.20)), "error", "metrics", "running", "cv,map"),
    _rule("cv-throughput-high", _CV, _at("meta.raw_message", "extract_number", pattern=r"(?i)([\d,_]+)\s*images", gte=3000), "info", "metrics", "success", "cv,throughput"),
    _rule("cv-batch-slow", _CV, _all(_at("batch_size", "gte", 32), _at("metrics.fps", "lt", 20)), "warn", "inference", "success", "cv,slow_batch"),
    _rule("core-api-general-event", _CORE, _at("event_type", "exists"), "info", None, None, "core_api,general"),
    _rule("llm-general-pipeline", _LLM, _at("pipeline_stage", "exists"), "info", None, None, "llm,general"),
    _rule("agentic-general-step", _AGENT, _at("step_kind", "exists"), "info", None, None, "agentic,general"),
    _rule("cv-general-phase", _CV, _at("phase", "exists"), "info", None, None, "cv,general"),
    _rule("all-failure-high", None, _at("@status", "in", ["failure", "failed"]), "error", "service", "failure", "global,failure", category="core_api"),
    _rule("all-latency-anomalous", None, _at("@latency", "gte", 2000), "warn", "network", "success", "global,latency", category="core_api"),
    _rule("missing-trace-identifier", None, _missing("trace_id"), "info", "tracking", "success", "global,missing_trace", category="core_api"),
]
