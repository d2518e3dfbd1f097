"""Commands over files, and what they exit with."""

import json

import pytest

from loglathe.__main__ import main
from loglathe.plans.reports import report
from loglathe.sources import synthetic
from loglathe.sources.lines import from_list, read_jsonl, write_jsonl

GOOD, BAD = 'INFO:     1.1.1.1:1 - "GET /a HTTP/1.1" 200 OK', "nothing known"


def raw(message, **more):
    return {"@timestamp": "2025-01-01T00:00:00Z", "@message": message} | more


def _input(tmp_path, items):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in items) + "not json\n\n")
    return f"file://{tmp_path}/in"


def test_stats(spark, tmp_path, capsys):
    records = [{"category": "llm", "timestamp": "t"}, {"pipeline_stage": "serve", "unparsed_reason": "odd"}, {"step_kind": "x", "meta": {"parse": {"ok": False}}}, {"phase": "pose", "meta": {"parse": {"ok": False, "error": "e"}}}, {"other": 1}]
    items = [raw(GOOD), raw("  more of it"), raw(BAD), raw(BAD), {"@timestamp": "t", "@message": 5}, *records]
    folder = _input(tmp_path, items)
    assert main(["stats", folder, "--format", "json"]) == 1
    got = json.loads(capsys.readouterr().out)
    core = got["domains"]["core_api"]
    assert (core["total"], core["parsed"], core["failed"], core["top_errors"]) == (3, 1, 2, [["no_pattern_match", 2]]) and not core["threshold_met"]
    assert [got["domains"][d]["top_errors"] for d in ("llm", "agentic", "cv")] == [[["odd", 1]], [["unknown_error", 1]], [["e", 1]]]
    assert got["overall"] == {"total": 7, "parsed": 2, "failed": 5, "parse_rate": pytest.approx(200 / 7)} and got["all_thresholds_met"] is False
    assert main(["stats", folder, "--threshold", "core_api=30,llm=50,agentic=0,cv=0"]) == 0
    assert "no_pattern_match: 2" in capsys.readouterr().out
    assert main(["stats", folder, "--threshold", "none=1"]) == 1 and "unknown domains" in capsys.readouterr().err


def test_an_empty_report(spark):
    found = report(from_list(spark, [{"x": 1}]))
    assert found["overall"]["total"] == 0 and found["all_thresholds_met"] and found["domains"]["cv"]["parse_rate"] == 0.0


def test_classify_and_parse(spark, tmp_path):
    folder = _input(tmp_path, [raw(GOOD), raw(BAD)])
    assert main(["classify", folder, f"file://{tmp_path}/out", "--domain", "core_api"]) == 0
    lines = [json.loads(x) for x in (tmp_path / "out" / "a.classified.jsonl").read_text().splitlines()]
    assert [x.get("http_status") for x in lines] == [200, None] and lines[0]["provenance"] and (tmp_path / "out" / "_DONE").exists()
    assert main(["parse", folder, f"file://{tmp_path}/parsed"]) == 0
    parsed = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/parsed").collect()]
    assert len(parsed) == 2 and all("provenance" not in x for x in parsed)


def test_wrong_arguments(tmp_path, capsys):
    with pytest.raises(SystemExit) as e:
        main(["stats"])
    assert e.value.code == 2
    assert main(["stats", f"file://{tmp_path}/none"]) == 1 and "ERROR" in capsys.readouterr().err


def test_records_are_written_and_read_back(spark, tmp_path):
    rows = from_list(spark, [{"n": i, "d": "xy"[i % 2]} for i in range(9)]).withColumnRenamed("given", "record")
    write_jsonl(rows, f"{tmp_path}/all")
    assert sorted(json.loads(r["value"])["n"] for r in read_jsonl(spark, f"{tmp_path}/all").collect()) == list(range(9))
    write_jsonl(rows.selectExpr("*", "_seq % 2 as part"), f"{tmp_path}/parts", by_file="part")
    assert [json.loads(r.value)["n"] % 2 for r in spark.read.text(f"{tmp_path}/parts/part=1").collect()] == [1] * 4


def test_generated_groups_and_invalid_records(spark):
    rows = synthetic.grouped(spark, "core_api", 400, 3).orderBy("_seq").collect()
    heads = [r for r in rows if not r["@message"].startswith("    ")]
    assert len(heads) == 400 and 30 < sum(b["@message"].startswith("    at step 1") for b in rows) < 140
    records = from_list(spark, [{"a": 1, "b": 2, "c": 3} for _ in range(60)]).withColumnRenamed("given", "record")
    left = [set(r["record"]) for r in synthetic.invalid(records).collect()]
    assert all(len(x) == 2 for x in left) and len({frozenset(x) for x in left}) == 3


def test_the_baseline(spark):
    rows = synthetic.baseline(spark, 5).select("record_index", "schema_id", "rule").collect()
    assert sorted(r.record_index for r in rows) == list(range(20)) and {r.schema_id for r in rows} <= {"core_api", "llm", "agentic", "computer_vision"}
