"""Parse-rate reports over JSONL input of lines and records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import field
from ..operators import inference, stats
from ..operators.joining import join_lines
from ..operators.routing import DOMAINS
from ..sources.lines import raw_events
from ..sources.shared import stored
from .pipeline import Options, parse


def outcomes(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows (domain, ok, reason, order) of rows (_seq, given): lines (``@message`` and ``@timestamp``) are
    joined and parsed, each joined line counts once; records count as they say of themselves.  Lines whose
    message is no string and records of no known domain are left out.  order: when it was told."""
    raw = F.map_contains_key("given", F.lit("@message")) & F.map_contains_key("given", F.lit("@timestamp"))
    some = rows.where(raw & field(F.col("given"), "@message").startswith('"'))
    joined = join_lines(raw_events(some.select("_seq", "given"))).select(F.col("timestamp").alias("@timestamp"), F.col("message").alias("@message"), F.struct("final", "place", "stream").alias("order"))
    lines = parse(joined, options).select("domain", "ok", F.when(~F.col("ok"), "no_pattern_match").alias("reason"), "order")
    reason = stats.failure_reason(F.col("given"))
    records = rows.where(~raw).select(inference.by_shape(F.col("given")).alias("domain"), reason.isNull().alias("ok"), reason.alias("reason"), F.struct(F.lit(False).alias("final"), F.col("_seq").alias("place"), F.lit("").alias("stream")).alias("order"))
    return lines.unionByName(records.where(F.col("domain").isin(*DOMAINS)))


def report(rows: DataFrame, thresholds: dict[str, float] = stats.THRESHOLDS) -> dict[str, Any]:
    """What ``outcomes`` come to: each domain's numbers with its three most common reasons, the numbers over
    all, and whether all thresholds are met.  A few rows go to the driver."""
    told = stored(outcomes(rows), "outcomes")
    by_domain = stored(stats.domain_stats(told, thresholds=thresholds), "domains")
    domains = {r["domain"]: r.asDict() for r in by_domain.collect()}
    found = {
        d: {"total": x["total"], "parsed": x["parsed"], "failed": x["failed"], "parse_rate": x["rate"], "threshold": x["threshold"], "threshold_met": x["met"], "top_errors": []}
        for d, x in ((d, domains[d]) for d in DOMAINS)
    }
    for r in stats.top_reasons(told, order="order").orderBy("domain", "rank").collect():
        found[r["domain"]]["top_errors"].append([r["reason"], r["n"]])
    whole = stats.overall(by_domain).first()
    overall = {"total": whole["total"], "parsed": whole["parsed"], "failed": whole["total"] - whole["parsed"], "parse_rate": whole["rate"]}
    return {"domains": found, "overall": overall, "all_thresholds_met": stats.thresholds_met(by_domain)}


def table(found: dict[str, Any]) -> str:
    """A report as text."""
    out = [f"{'domain':<12}{'total':>10}{'parsed':>10}{'failed':>10}{'rate':>9}{'asked':>9}  met"]
    for d, x in found["domains"].items():
        out.append(f"{d:<12}{x['total']:>10}{x['parsed']:>10}{x['failed']:>10}{x['parse_rate']:>8.1f}%{x['threshold']:>8.1f}%  {'yes' if x['threshold_met'] else 'NO'}")
        out += [f"    {reason}: {n}" for reason, n in x["top_errors"]]
    x = found["overall"]
    return "\n".join([*out, f"{'all':<12}{x['total']:>10}{x['parsed']:>10}{x['failed']:>10}{x['parse_rate']:>8.1f}%"])
