"""Files in the order of their names, one output for each input, joining over many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loglathe.operators import joining
from loglathe.sources import folders, numbering
from loglathe.sources.lines import read_jsonl
from loglathe.sources.numbering import numbered_lines, running_total


@pytest.fixture()
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_in_the_order_of_names(spark, tmp_path, small_parts):
    """Spark reads the larger files first and in parts."""
    names = {"b.jsonl": 50, "a.jsonl": 2, "c d+é.jsonl": 120, "B.jsonl": 7, "empty.jsonl": 0, "a%20.jsonl": 11}
    for name, n in names.items():
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 40)}\n" if i % 7 else "\n" for i in range(n)))
    want = [(name, i) for name in sorted(names) for i in range(names[name])]
    got = [(r["source_file"], r["line"], r["_seq"], r["value"]) for r in numbered_lines(spark, str(tmp_path)).orderBy("_seq").collect()]
    assert [(n, i) for n, i, _, _ in got] == want and [s for _, _, s, _ in got] == list(range(len(want)))
    assert all(v.split(" x")[0].strip() == (f"{n} {i}" if i % 7 else "") for n, i, _, v in got)


@pytest.mark.parametrize("bound", [None, 0])
def test_jsonl_order(spark, tmp_path, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(numbering, "BROADCAST_PARTS", bound)
    for name, n in (("a", 2), ("b", 50), ("c", 10)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"f": name, "i": i}) + "\nbad\n" for i in range(n)))
    got = [(r["source_file"], r["line"], json.loads(r["value"])["i"]) for r in read_jsonl(spark, str(tmp_path)).orderBy("_seq").collect()]
    assert got == [(f"{n}.jsonl", 2 * i, i) for n, k in (("a", 2), ("b", 50), ("c", 10)) for i in range(k)]


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(9)) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k"], "v", "before").orderBy("k").collect()
    assert [r.before for r in got] == [sum(v for _, v in rows[:i]) for i in range(500)]


LINES = ['INFO:     1.1.1.1:1 - "GET /a HTTP/1.1" 200 OK', "[Coder] writes k=1", "nothing known", "[Pose] found fps=2"]


def _files(folder):
    folder.mkdir()
    raw = [json.dumps({"@timestamp": "2025-01-01T00:00:00Z", "@message": x}) for x in LINES]
    (folder / "llm_b.jsonl").write_text("\n".join(raw * 5))
    (folder / "a.log").write_text("\n".join([raw[0], "", "not json", raw[1]]) + "\n")
    (folder / "z.jsonl").write_text(json.dumps({"timestamp": "t", "meta": {}, "event_type": "startup"}) + "\n")
    (folder / "empty.jsonl").write_text("")
    return str(folder)


def _outputs(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith(".")}


def test_one_output_for_each_input(spark, tmp_path):
    source, out = _files(tmp_path / "in"), tmp_path / "out"
    folders.classify_folder(spark, source, f"file://{out}", lines=8)
    first = _outputs(out)
    assert set(first) == {"a.log.classified.jsonl", "empty.classified.jsonl", "llm_b.classified.jsonl", "llm_b.classified.part-00001.jsonl", "llm_b.classified.part-00002.jsonl", "z.classified.jsonl", "_DONE"}
    counts = {n: b.count(b"\n") for n, b in first.items()}
    assert counts["llm_b.classified.jsonl"] == 8 and counts["llm_b.classified.part-00002.jsonl"] == 4 and counts["empty.classified.jsonl"] == 0
    record = json.loads(first["a.log.classified.jsonl"].split(b"\n")[0])
    assert record["http_status"] == 200 and counts["a.log.classified.jsonl"] == 2
    assert json.loads(first["z.classified.jsonl"])["event_type"] == "startup"
    assert [p.name for p in out.iterdir() if p.name.startswith(".")] == []
    folders.classify_folder(spark, source, f"file://{out}", lines=8)
    assert _outputs(out) == first


def test_a_failed_task_leaves_no_marker(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id") % 4).alias("source_file"), F.col("id").alias("line"), F.col("id").cast("string").alias("value"))
    folders.write_outputs(rows, f"file://{out}")
    assert (out / "_DONE").exists()
    broken = rows.withColumn("value", F.when(F.col("line") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        folders.write_outputs(broken, f"file://{out}")
    assert not (out / "_DONE").exists() and [p.name for p in out.iterdir() if p.name.startswith(".staging")] == []
    assert (out / "f3.classified.jsonl").read_text() == "".join(f"{i}\n" for i in range(3, 40, 4))  # of the run before
    folders.write_outputs(rows, f"file://{out}")
    assert (out / "_DONE").exists()


@pytest.mark.parametrize(("flags", "form"), [(["", "r"], "raw"), (["n", "r"], "json"), (["r", "n"], "raw"), (["", ""], "json"), ([""] * 60 + ["n"], "json"), ([""] * 60 + ["n", "r"], "raw"), ([""] * 49 + ["n", "r"], "json")])
def test_formats(spark, flags, form):
    keys = {"": ["x"], "r": ["@message"], "n": ["timestamp", "meta"]}
    rows = spark.createDataFrame([("f", i, dict.fromkeys(keys[x], "1")) for i, x in enumerate(flags)], "source_file string, _seq long, given map<string,string>")
    assert [tuple(r) for r in folders.formats(rows).collect()] == [("f", form)]


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_joining_in_blocks(spark, monkeypatch, block):
    """One stream over many blocks, and several, like a loop over all lines."""
    monkeypatch.setattr(joining, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), rng.choice([f"t{i}", f"t{i}", None]), rng.choice(["x", " y", "\tz", None])) for i in sorted(rng.sample(range(400), 150))]
    out, held = [], {}
    for _, s, ts, m in rows:
        s, m = s or "__default__", m or ""
        if ts is None:
            continue
        if m[:1] in (" ", "\t"):
            out.append((held[s][0], held.pop(s)[1] + "\n" + m) if s in held else (ts, m))
        else:
            if s in held:
                out.append(held.pop(s))
            held[s] = (ts, m)
    out += [held[s] for s in sorted(held)]
    got = joining.join_lines(spark.createDataFrame(rows, "_seq int, source string, `@timestamp` string, `@message` string")).orderBy("final", "place", "stream").collect()
    assert [(r.timestamp, r.message) for r in got] == out
