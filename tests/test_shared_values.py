"""Values that stand several times in an expression are worked out once a row."""

import json

from pyspark.sql import functions as F

from loglathe.functions.literals import bound, parsed, quoted, text_of
from loglathe.operators.comparing import digest
from loglathe.operators.normalising import literal, units
from loglathe.operators.records import canonical_json


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def records(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_seq long, j string")


def parses(rows):
    """How often a JSON text is parsed in the plan."""
    return plan(rows).lower().count("parsejson")


def test_canonical_json_works_its_record_out_once(spark):
    rows = records(spark, '{"zeta": 1, "meta": {"a": "x"}, "q\\"k": 2, "level": "info"}', "[1]")
    done = rows.select(canonical_json(parsed(F.col("j"))).alias("c"), literal(parsed(F.col("j"))).alias("l"))
    assert parses(done) <= 2 * parses(rows.select(parsed(F.col("j")).alias("r")))
    assert [tuple(r) for r in done.collect()] == [('{"level": "info", "meta": {"a":"x"}, "q\\"k": 2, "zeta": 1}', '{"level": "info", "meta": {"a":"x"}, "q\\"k": 2, "zeta": 1}'), (None, None)]


def test_units_below_split_a_value_once(spark):
    rows = records(spark, '{"list": [{"ttft": "1h"}, 5, "10s"]}').select(parsed(F.col("j")).alias("r"))
    done = rows.select(canonical_json(units(F.col("r"))).alias("c"))
    assert plan(done).count("regexp_extract_all") == 1
    assert done.first().c == '{"list": [{"ttft": 3600000.0}, 5, "10s"]}'


def test_a_digest_writes_a_record_once(spark):
    rows = records(spark, '{"a": 1}', '{"a": 2}').select("_seq", parsed(F.col("j")).alias("record"))
    assert plan(digest(rows)).count("sha2") == 1 and digest(rows).first().n == 2


def test_literals_with_and_without_escapes(spark):
    texts = ["", "plain", 'q"', "back\\slash", "new\nline", "end\n", "\x01", "é日", "~ }", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", quoted(F.col("t")).alias("q"), text_of(quoted(F.col("t"))).alias("b"), bound(F.col("t"), F.length).alias("n"))
    for r in rows.collect():
        assert (None if r.q is None else json.loads(r.q)) == r.t == r.b and r.n == (None if r.t is None else len(r.t))
