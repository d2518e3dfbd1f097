"""Patterns of one's own beside the built-in ones."""

import json

import pytest
from pyspark.sql import functions as F

from loglathe.operators.parsing import BUILT_IN, registry
from loglathe.operators.patterns import SCHEMA, BadPattern, read_patterns, registry_of
from loglathe.plans.pipeline import Options, classify_lines, parse

OWN = {
    "domain": "core_api", "pattern_id": "order_event", "confidence": 0.9, "regex": r"^ORDER (\w+) #(\d+)(?: took ([\d.]+)s)?(?: by (\w+))?",
    "fields": [{"group": 1, "field": "action", "transform": "upper"}, {"group": 2, "field": "order.id", "transform": "integer"}, {"group": 3, "field": "order.seconds", "transform": "number"}, {"group": 4, "field": "user"}],
    "constants": {"event_type": "http_request", "level": "info"}, "pairs": "tool",
}


def _fields(spark, lines, patterns, domain="core_api"):
    rows = spark.createDataFrame([(i, "t", x) for i, x in enumerate(lines)], "_seq long, `@timestamp` string, `@message` string")
    found = parse(rows, Options(domain=domain, patterns=patterns)).orderBy("_seq").select("pattern", "confidence", F.col("fields")).collect()
    return [(r["pattern"], r["confidence"], r["fields"] and {k: json.loads(v) for k, v in r["fields"].items()}) for r in found]


def test_own_pattern(spark):
    found = _fields(spark, ["ORDER paid #007 took 1.50s by ann", "ORDER lost #9", "[Build] x", "ORDER"], registry_of(spark, [OWN]))
    assert found[0] == ("order_event", 0.9, {"action": "PAID", "order": {"id": 7, "seconds": 1.5}, "user": "ann", "event_type": "http_request", "level": "info"})
    assert found[1][2] == {"action": "LOST", "order": {"id": 9, "seconds": None}, "user": None, "event_type": "http_request", "level": "info"}
    assert found[2][0] == "build_event" and found[3] == (None, None, None)


def test_own_pattern_in_the_place_of_a_built_in_one(spark, tmp_path):
    own = {"domain": "core_api", "pattern_id": "build_event", "confidence": 0.99, "regex": r"\[Build\] (.+)", "fields": [{"group": 1, "field": "what"}]}
    (tmp_path / "own.json").write_text(json.dumps({"patterns": [own]}))
    patterns = read_patterns(spark, str(tmp_path / "own.json"))
    assert _fields(spark, ["[Build] now"], patterns) == [("build_event", 0.99, {"what": "now"})]
    assert _fields(spark, ["[Build] now"], BUILT_IN)[0][2] != {"what": "now"}
    assert registry(patterns)[0]["pattern_id"] == "build_event" and len(registry(patterns)) == len(registry())


def test_patterns_of_a_table_go_through_the_chain(spark):
    table = spark.createDataFrame([(OWN["domain"], OWN["pattern_id"], 0.9, OWN["regex"], [(1, "action", "upper"), (2, "request_id", "text")], OWN["constants"], None)], SCHEMA)
    rows = spark.createDataFrame([(1, "t", "ORDER paid #7")], "_seq long, `@timestamp` string, `@message` string")
    row = classify_lines(rows, Options(domain="core_api", patterns=registry_of(spark, table))).first()
    assert row["pattern"] == "order_event" and row["record"]["request_id"] == '"7"' and json.loads(row["record"]["meta"])["parse"]["pattern_id"] == "order_event"


def test_order_of_patterns(spark):
    """By confidence; of equal ones those of the rows first, in their order."""
    own = [OWN | {"pattern_id": x, "confidence": c} for x, c in (("b", 0.9), ("a", 0.9), ("c", 0.95))]
    names = [x["pattern_id"] for x in registry(registry_of(spark, own)) if x["domain"] == "core_api"]
    assert names[:2] == ["c", "http_request_uvicorn"] and names[2:4] == ["b", "a"]
    confidences = [x["confidence"] for x in registry(registry_of(spark, own)) if x["domain"] == "core_api"]
    assert confidences == sorted(confidences, reverse=True)


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"regex": "("}, "order_event"), ({"regex": ""}, "no regex"), ({"confidence": 2}, "confidence"), ({"confidence": None}, "confidence"), ({"domain": "x"}, "no domain"), ({"pattern_id": "a b"}, "name"),
        ({"fields": [{"group": 9, "field": "x"}]}, "no group 9 of 4"), ({"fields": [{"group": 1, "field": "x", "transform": "eval"}]}, "no transform"), ({"pairs": "?"}, "no form"),
        ({"fields": [{"group": 1, "field": "level"}]}, "doubled"), ({"fields": [{"group": 1, "field": "a"}, {"group": 2, "field": "a.b"}]}, "within"), ({"pattern_id": "cv_model"}, "of cv"),
    ],
)
def test_bad_patterns(spark, change, said):
    with pytest.raises(BadPattern, match=said):
        registry_of(spark, [OWN | change])


def test_names_come_once(spark):
    with pytest.raises(BadPattern, match="twice"):
        registry_of(spark, [OWN, OWN])
