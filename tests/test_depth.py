"""Values at any depth: units, contracts, differences; digests by range; what is kept of columns."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loglathe.functions.literals import parsed
from loglathe.operators import comparing, parsing
from loglathe.operators.contracts import check
from loglathe.operators.normalising import unit_errors, units
from loglathe.operators.records import canonical_json


def records(spark, *objects):
    rows = [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(objects)]
    return spark.createDataFrame(rows, "_seq long, j string").withColumn("record", parsed(F.col("j")))


def test_units_at_any_depth(spark):
    given = {"a": {"b": {"c": {"d": {"duration": "2s", "note": 'say "latency": "3s" \\', "tokens": "1,000"}}}}, "l": [[{"x": [{"ttft": "1m", "size": "?"}]}], "10s"], "duration": "5s", "latency": "none"}
    row = records(spark, given).select(canonical_json(units(F.col("record"))).alias("j"), unit_errors(units(F.col("record"))).alias("e")).first()
    want = json.loads(json.dumps(given))
    want["a"]["b"]["c"]["d"] |= {"duration": 2000.0, "tokens": 1000}
    want["l"][0][0]["x"][0]["ttft"] = 60000.0
    want["duration"] = 5000.0
    assert json.loads(row.j) == want
    assert row.e.startswith("latency: not a duration")


def test_contracts_of_any_depth(spark):
    item = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "minLength": 2}}}}
    deep = {"type": "object", "properties": {"e": {"type": "object", "required": ["f"], "properties": {"f": {"type": "string"}}}}}
    contract = {"type": "object", "properties": {"list": {"type": "array", "items": item}, "a": {"type": "object", "properties": {"b": {"type": "object", "properties": {"c": deep}}}}}}
    good = {"list": [{"id": 1, "tags": ["ab"]}, {"id": 2}], "a": {"b": {"c": {"e": {"f": "x"}}}}}
    bad = {"list": [{"id": 1}, {"id": "2", "tags": ["ab", "c"], "more": 1}, {}], "a": {"b": {"c": {"e": {"g": 1}}}}}
    rows = check(records(spark, good, bad, {"list": []}), "record", F.lit("own"), {"own": contract}).orderBy("_seq").collect()
    got = [{(x.path, x.keyword) for x in r.failures} for r in rows]
    assert got == [set(), {("/list/1/id", "type"), ("/list/1/tags/1", "minLength"), ("/list/1", "additionalProperties"), ("/list/2", "required"), ("/a/b/c/e", "required")}, set()]


def _differences(a, b, path=""):
    kind = lambda x: type(x).__name__
    if kind(a) != kind(b):
        return {(path, "type")}
    if isinstance(a, (dict, list)):
        x, y = (dict(enumerate(v)) if isinstance(v, list) else v for v in (a, b))
        out = {(f"{path}/{k}", "missing") for k in x.keys() - y.keys()} | {(f"{path}/{k}", "extra") for k in y.keys() - x.keys()}
        for k in x.keys() & y.keys():
            out |= _differences(x[k], y[k], f"{path}/{k}")
        return out
    return set() if repr(a) == repr(b) else {(path, "value")}


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, 2, 1.5, "x", "y", True, None, [], {}])
    if rng.random() < 0.4:
        return [_random(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: _random(rng, depth - 1) for k in rng.sample("abcd", rng.randrange(4))}


def test_differences_at_any_depth(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(60):
        a = {k: _random(rng, 6) for k in "abc"}
        b = json.loads(json.dumps(a))
        if rng.random() < 0.7:
            b[rng.choice("abcd")] = _random(rng, 6)
        pairs.append((a, b))
    got = comparing.differences(records(spark, *(a for a, _ in pairs)), records(spark, *(b for _, b in pairs)), limit=None).collect()
    want = {(i, *d) for i, (a, b) in enumerate(pairs) for d in _differences(a, b)}
    assert {(r["at"], r["path"], r["kind"]) for r in got} == want and len(got) == len(want) > 50


def test_counts_and_limits_of_differences(spark):
    a, b = records(spark, *({"n": i} for i in range(30))), records(spark, *({"n": i + 1} for i in range(29)))
    got = comparing.differences(a, b).orderBy("at").collect()
    assert len(got) == 10 and (got[0]["at"], got[0]["kind"], got[0]["a"], got[0]["b"]) == (-1, "count", "30", "29")
    every = comparing.differences(a, b, limit=None).collect()
    assert len(every) == 31 and [(r["path"], r["kind"]) for r in every if r["at"] == 29] == [("", "missing")]
    assert comparing.differences(a, a).count() == 0


def test_one_changed_record_is_found_in_one_range(spark, tmp_path):
    rows = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("_seq"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("record"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows.write.parquet(a)
    changed = F.when(F.col("_seq") == 54_321, F.create_map(F.lit("n"), F.lit('"?"'))).otherwise(F.col("record"))
    rows.withColumn("record", changed).repartition(3, "_seq").sortWithinPartitions("_seq").write.parquet(b)
    x, y = spark.read.parquet(a), spark.read.parquet(b)
    ranges = comparing.differing_ranges(comparing.digests_by_range(x), comparing.digests_by_range(y))
    assert [r["range"] for r in ranges.collect()] == [54_321 // comparing.RANGE]
    some = comparing.within(x, ranges)
    assert some.count() == comparing.RANGE and "GreaterThanOrEqual(_seq," in some._jdf.queryExecution().toString()
    got = comparing.compare_runs(x, y).collect()
    assert [tuple(r) for r in got] == [(54_321, "/n", "54321", '"?"', "type")]


@pytest.mark.parametrize("bounds", [0, 64])
def test_many_ranges_are_joined(spark, monkeypatch, bounds):
    monkeypatch.setattr(comparing, "BOUNDS", bounds)
    a = records(spark, *({"n": i} for i in range(50)))
    b = records(spark, *({"n": -i if i in (7, 40) else i} for i in range(50)))
    assert [(r["at"], r["kind"]) for r in comparing.compare_runs(a, b, width=5).orderBy("at").collect()] == [(7, "value"), (40, "value")]


def test_columns_of_two_tables_are_not_mixed(spark):
    rows = [("[Data] Could not open stream fps=3",), ("[Infer] batch done",)]
    for table in (spark.createDataFrame(rows, "line string"), spark.createDataFrame(rows[::-1], "line string")):
        found = table.select(parsing.pattern_of(table["line"], F.lit("cv")).alias("p"))
        assert {r["p"] for r in found.collect()} == {"cv_data_load", "cv_component_log"}
