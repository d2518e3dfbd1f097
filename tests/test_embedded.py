"""JSON inside text against the standard library's decoder."""

import json
import random

from pyspark.sql import functions as F

from loglathe.operators.embedded import generated_record, objects, written_record


def decoded(text):
    """The objects that raw_decode finds from the left."""
    out, at = [], 0
    while (at := text.find("{", at)) >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        out.append((at, end, text[at:end]))
        at = end
    return out


PIECES = [
    '{"a": 1}', '{"s": "a } { \\" b"}', '{"n": {"l": [1, {"x": []}]}}', "{}", "{broken", "}", "]", "[", '"', "\\", 'say "hi', " ", "text", "é日", '{"a": }', '{"k": "\\\\"}', "{{", '{"a":"\\u00e9"}', "[{\"b\":2}]", "\n",
]


def test_objects_like_the_decoder(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(500)] + ["", "plain", '{"a":1}' * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", objects(F.col("t")).alias("o"))
    got = {r.i: r.o for r in rows.collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i]] == decoded(t), t
    assert got[len(texts)] is None


def _records(spark, build, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", build(F.col("t")).alias("r"))
    return [None if r.r is None else {k: json.loads(v) for k, v in r.r.items()} for r in rows.orderBy("i").collect()]


def test_records_written_as_text(spark):
    texts = ['RAW_TXT a=1 b="x y" c={"d": [1, 2], "e": "} \\" ="} word a=null', "RAW_TXT a=1 b=bad", "RAW_TXT ", "raw_txt a=1", 'RAW_TXT k="a=b"', None]
    assert _records(spark, written_record, texts) == [{"a": None, "b": "x y", "c": {"d": [1, 2], "e": '} " ='}}, None, {}, None, {"k": "a=b"}, None]


def test_lines_that_are_records(spark):
    texts = [' {"a": {"b": 1}} ', '{"a": 1} tail', "RAW_TXT a=1.5", "[Build] x", '{"a"', ""]
    assert [None if x is None else x.get("a") for x in _records(spark, generated_record, texts)] == [{"b": 1}, None, 1.5, None, None, None]


def test_generated_lines_are_labelled(spark):
    """Records in lines pass as they are, other lines are parsed; none is lost."""
    from loglathe.operators.records import canonical_json
    from loglathe.plans.pipeline import Options, classify_generated

    lines = ['{"event_type": "startup", "latency": "2s"}', 'RAW_TXT event_type="health_check" note="a b"', 'INFO:     1.1.1.1:1 - "GET /a HTTP/1.1" 200 OK', "nothing known"]
    rows = spark.createDataFrame([(i, "t", x) for i, x in enumerate(lines)], "_seq long, `@timestamp` string, `@message` string")
    got = [json.loads(r.j) for r in classify_generated(rows, Options(domain="core_api")).orderBy("_seq").select(canonical_json(F.col("record")).alias("j")).collect()]
    assert [x.get("event_type") for x in got] == ["startup", "health_check", "http_request", "exception"]
    assert [x["meta"]["parse"]["pattern_id"] for x in got[:3]] == ["generated", "generated", "http_request_uvicorn"]
    assert got[0]["meta"]["parse"]["parser_name"] == "generator" and got[0]["meta"]["raw_message"] == lines[0] and got[1]["metadata"]["note"] == "a b"
    assert got[0]["timestamp"] == "t" and got[3]["unparsed_reason"] == "no_pattern_match"
