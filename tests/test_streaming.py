"""The chain over streams gives what it gives over tables."""

import json

from pyspark.sql import functions as F

from loglathe.operators.records import canonical_json
from loglathe.plans.pipeline import Options, classify_lines
from loglathe.sources.lines import raw_events, read_jsonl, read_stream
from loglathe.streaming.classify import classify_stream, windowed_rates, write_stream

LINES = ['INFO:     1.1.1.1:1 - "GET /a HTTP/1.1" 200 OK', "[Coder] writes k=1", "nothing known", "[Pose] found fps=2"]


def _source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, line in enumerate(LINES):
        (folder / f"{i}.jsonl").write_text(json.dumps({"@timestamp": f"2025-01-01T00:0{i}:00Z", "@message": line}) + "\n")
    return str(folder)


def test_a_stream_is_labelled_like_a_table(spark, tmp_path):
    folder = _source(tmp_path)
    labelled = classify_stream(raw_events(read_stream(spark, folder)), Options())
    write_stream(labelled, str(tmp_path / "out"), str(tmp_path / "marks"), once=True).awaitTermination(120)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    table = classify_lines(raw_events(read_jsonl(spark, folder)), Options())
    assert got == sorted(r.j for r in table.select(canonical_json(F.col("record")).alias("j")).collect()) and len(got) == len(LINES)


def test_rates_by_window(spark, tmp_path):
    table = classify_lines(raw_events(read_jsonl(spark, _source(tmp_path))), Options())
    got = {(r.domain, r.total, r.parsed) for r in windowed_rates(table).collect()}
    assert got == {("core_api", 2, 1), ("agentic", 1, 1), ("cv", 1, 1)}


def _minute(s):
    return f"2025-01-01T{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}Z"


def _joined_by_a_loop(lines, wait):
    """Lines (second, seq, stream, message) in order, joined as the stream's state should."""
    out, heads = [], {}
    for s, _, stream, message in sorted(lines):
        head = heads.pop(stream, None)
        if head and head[0] + wait < s:
            out.append((stream, _minute(head[0]), head[1]))
            head = None
        if message[:1] in (" ", "\t"):
            out.append((stream, _minute(head[0]), f"{head[1]}\n{message}") if head else (stream, _minute(s), message))
        else:
            if head:
                out.append((stream, _minute(head[0]), head[1]))
            heads[stream] = (s, message)
    return out, heads


def test_joining_over_restarts_and_files_out_of_order(spark, tmp_path):
    import random

    from loglathe.streaming import joining

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", joining.PROVIDER)
    rng, folder, out = random.Random(6), tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    lines = [(rng.randrange(300), i, rng.choice("ab"), rng.choice(["x", "x", " y", "\tz", ""]) + (f"{i}" if rng.random() < 0.9 else "")) for i in range(80)]
    schema = "s int, seq long, stream string, message string, timestamp string"

    def run():
        rows = spark.readStream.schema(schema).json(str(folder)).select("stream", F.col("seq").alias("_seq"), "timestamp", "message")
        joined = joining.join_events(rows, "10 minutes", 20_000)
        query = joined.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    try:
        for n in range(3):  # each run starts from the state of the one before; files hold times in any order
            some = lines[n::3] if n < 2 else lines[2::3] + [(2000, 900, "end", "."), (None, 901, "a", "no time")]
            (folder / f"{n}.json").write_text("".join(json.dumps({"s": s, "seq": q, "stream": t, "message": m, "timestamp": None if s is None else _minute(s)}) + "\n" for s, q, t, m in some))
            run()
        late = [(10, 950, "a", "late"), (4000, 951, "end", ".")]
        (folder / "3.json").write_text("".join(json.dumps({"s": s, "seq": q, "stream": t, "message": m, "timestamp": _minute(s)}) + "\n" for s, q, t, m in late))
        run()
        (folder / "4.json").write_text(json.dumps({"s": 4001, "seq": 952, "stream": "end", "message": ".", "timestamp": _minute(4001)}) + "\n")
        run()  # a watermark holds from the batch after the one that moved it
        got = [(r.stream, r.timestamp, r.message) for r in spark.read.schema("stream string, timestamp string, message string").json(str(out)).collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want, heads = _joined_by_a_loop(lines, 20)
    want += [(t, _minute(s), m) for t, (s, m) in heads.items()] + [("end", _minute(2000), ".")]
    assert sorted(got) == sorted(want)
