"""Distinct draws and draws that go together."""

import pytest
from pyspark.sql import functions as F

from loglathe.operators.parsing import PATTERNS
from loglathe.plans.pipeline import Options, parse
from loglathe.sources.draws import METRICS, distinct_lines, permuted, vision_metrics


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 1000])
def test_a_permutation(spark, count):
    size = 4
    while size < count:
        size *= 4
    got = [r.p for r in spark.range(size).select(permuted(F.col("id"), count, 7).alias("p")).collect()]
    assert sorted(got) == list(range(size)) and (size < 64 or got != sorted(got))


def test_a_million_lines_are_distinct(spark):
    for domain in PATTERNS:
        rows = distinct_lines(spark, domain, 1_000_000 if domain == "llm" else 20_000, 5)
        assert rows.agg((F.count("*") - F.count_distinct("@message")).alias("d")).first()["d"] == 0


def test_draws_follow_the_seed(spark):
    a, b, c = (distinct_lines(spark, "cv", 500, s).orderBy("_seq").collect() for s in (1, 1, 2))
    assert a == b and [r["@message"] for r in a] != [r["@message"] for r in c]
    assert spark.createDataFrame(a).count() == 500


def test_distinct_lines_parse(spark):
    assert parse(distinct_lines(spark, "cv", 300), Options(domain="cv")).where("ok").count() >= 285


def test_metrics_go_together(spark):
    rows = vision_metrics(spark.range(40_000).withColumnRenamed("id", "_seq")).cache()
    pairs = [("accuracy", "recall", 0.65, 0.9), ("precision", "map", 0.6, 0.85), ("accuracy", "fps", -0.65, -0.3), ("iou", "ap", 0.55, 0.8)]
    found = rows.select(*(F.corr(a, b).alias(f"c{i}") for i, (a, b, _, _) in enumerate(pairs))).first()
    for i, (_, _, low, high) in enumerate(pairs):
        assert low < found[f"c{i}"] < high
    bounds = rows.select(*(F.struct(F.min(m), F.max(m), F.avg(m)).alias(m) for m in METRICS)).first()
    for name, (low, high, _) in METRICS.items():
        least, most, mean = bounds[name]
        assert low <= least and most <= high and abs(mean - (low + high) / 2) < 0.02 * (high - low)
    assert rows.where("f1_score > greatest(precision, recall) + 0.0001 or f1_score < least(precision, recall) - 0.0001").count() == 0
