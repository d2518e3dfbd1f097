"""Parse-rate statistics, thresholds and most common failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import field, text_of
from .records import parse_ok
from .routing import DOMAINS

#: Parse rates in percent that a domain should reach (fixed values).
THRESHOLDS = {"llm": 95.0, "agentic": 95.0, "cv": 80.0, "core_api": 70.0}


def failure_reason(fields: Column) -> Column:
    """Why a record counts as failed, or SQL NULL: its reason, else its parse's error."""
    parse = F.get_json_object(field(fields, "meta"), "$.parse.ok")
    error = F.get_json_object(field(fields, "meta"), "$.parse.error")
    return F.coalesce(text_of(field(fields, "unparsed_reason")), F.when(parse == "false", F.coalesce(error, F.lit("unknown_error"))))


def processing_stats(rows: DataFrame, name: str = "record") -> DataFrame:
    """One row: total, parsed, failed, parse_rate, validated, validation_failed, validation_skipped,
    classified, failure_reasons (a map from reasons to counts)."""
    rec = F.col(name)
    meta = field(rec, "meta")
    checked = F.get_json_object(meta, "$.validation.ok")
    told = rows.select(
        parse_ok(rec).alias("ok"), checked.alias("checked"), F.get_json_object(meta, "$.validation.skipped").alias("skipped"), field(rec, "provenance").isNotNull().alias("classified"),
        F.coalesce(text_of(field(rec, "unparsed_reason")), F.get_json_object(meta, "$.parse.error"), F.lit("parse_error")).alias("reason"),
    )
    # by reason first, so that one pass gives both the sums and the counts of reasons
    by = told.groupBy(F.when(~F.col("ok"), F.col("reason")).alias("reason")).agg(
        F.count("*").alias("total"), F.count_if("ok").alias("parsed"), F.count_if(F.col("checked") == "true").alias("validated"),
        F.count_if(F.col("checked") == "false").alias("validation_failed"), F.count_if(F.col("skipped") == "true").alias("validation_skipped"), F.count_if("classified").alias("classified"),
    )
    reasons = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", F.col("total").alias("n"))))
    sums = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "parsed", "validated", "validation_failed", "validation_skipped", "classified")), F.map_from_entries(reasons).alias("failure_reasons"))
    rate = F.when(F.col("total") > 0, 100.0 * F.col("parsed") / F.col("total")).otherwise(0.0)
    return sums.select("total", "parsed", (F.col("total") - F.col("parsed")).alias("failed"), "validated", "validation_failed", "validation_skipped", "classified", rate.alias("parse_rate"), "failure_reasons")


def domain_stats(rows: DataFrame, domain: str = "domain", ok: str = "ok", thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """A row for each of the four domains, also those without lines: total, parsed, failed, rate,
    threshold, met.  An empty domain meets its threshold."""
    counts = rows.groupBy(domain).agg(F.count("*").alias("total"), F.count_if(ok).alias("parsed"))
    every = rows.sparkSession.createDataFrame([(d, float(thresholds[d])) for d in DOMAINS], "domain string, threshold double")
    joined = every.join(counts.withColumnRenamed(domain, "domain"), "domain", "left")
    total, parsed = F.coalesce("total", F.lit(0)), F.coalesce("parsed", F.lit(0))
    rate = F.when(total > 0, 100.0 * parsed / total).otherwise(0.0)
    return joined.select("domain", total.alias("total"), parsed.alias("parsed"), (total - parsed).alias("failed"), rate.alias("rate"), "threshold", ((total == 0) | (rate >= F.col("threshold"))).alias("met"))


def overall(stats: DataFrame) -> DataFrame:
    """One row (total, parsed, rate) over the domains of domain_stats(); no lines have the rate 0."""
    sums = stats.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"))
    return sums.withColumn("rate", F.when(F.col("total") > 0, 100.0 * F.col("parsed") / F.col("total")).otherwise(0.0))


def domain_metrics(rows: DataFrame, name: str = "record", domain: str = "domain", raw: Column | None = None) -> DataFrame:
    """Rows (domain, total, parse_ok, parse_error, schema_violation, raw_total, raw_ok, parse_rate,
    overall_parse_rate) of validated records; raw: which of them came as lines (null: all)."""
    came = F.lit(True) if raw is None else raw
    ok, kept = parse_ok(F.col(name)), F.get_json_object(field(F.col(name), "meta"), "$.validation.ok")
    told = rows.select(F.col(domain).alias("domain"), ok.alias("ok"), came.alias("raw"), (kept == "false").alias("broken"))
    sums = told.groupBy("domain").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("parse_ok"), F.count_if(~F.col("ok")).alias("parse_error"), F.count_if(F.col("ok") & F.col("broken")).alias("schema_violation"),
        F.count_if("raw").alias("raw_total"), F.count_if(F.col("raw") & F.col("ok")).alias("raw_ok"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumn("parse_rate", share("raw_ok", "raw_total")).withColumn("overall_parse_rate", share("parse_ok", "total"))


def top_reasons(rows: DataFrame, reason: str = "reason", order: str = "_seq", domain: str = "domain", k: int = 3) -> DataFrame:
    """The k most common reasons of each domain; of equally common ones those seen first."""
    counts = rows.where(F.col(reason).isNotNull()).groupBy(domain, reason).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select(domain, reason, "n", "rank")


def thresholds_met(stats: DataFrame) -> bool:
    return not stats.where(~F.col("met")).head(1)


def parse_thresholds(text: str | None) -> dict[str, float]:
    """``llm=90,cv=75`` over the usual ones."""
    given = dict(x.split("=", 1) for x in (text or "").split(",") if x.strip())
    if unknown := set(k.strip() for k in given) - set(DOMAINS):
        raise ValueError(f"unknown domains {sorted(unknown)}")
    return THRESHOLDS | {k.strip(): float(v) for k, v in given.items()}


def rule_histogram(rows: DataFrame) -> DataFrame:
    """Records by the rule that labelled them."""
    rule = F.coalesce(F.get_json_object(field(F.col("record"), "provenance"), "$.parser_rule_id"), F.lit("none"))
    return rows.groupBy(rule.alias("rule_id")).agg(F.count("*").alias("n"))
