"""Synthetic lines of each domain, by hash of a seed and the line's number: the same seed gives the
same lines, on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = {
    "core_api": (
        'INFO:     10.0.{a}.{b}:{port} - "{method} /items/{n} HTTP/1.1" {status} OK',
        "{method} /api/items/{n} {status} {ms}ms",
        "[AppRunner] Deployment Artifact: [Repo Type: Source], [Repository: service-{n}]",
        "[Build] Downloading package-{a}.{b}.whl ({n} kB)",
        "Traceback (most recent call last):",
        "Health check is successful. Routing traffic to application.",
        "ERROR: No matching distribution found for package{n}",
    ),
    "llm": (
        "[Tokenizer][INFO] loaded vocab size={n} latency={ms}ms",
        "[Model][WARNING] device_map=auto tokens_in={n} tokens_out={a}",
        "[KVCache][INFO] paged KV enabled: max_kv_tokens={n} threshold={b}",
        "[Sampler] temperature=0.{a} top_p=0.{b} max_tokens={n}",
    ),
    "agentic": (
        "[Agent] session_start id=agnt-{n} model=m{a} locale=en",
        "[Tool] call web_search k={a} timeout={ms}ms",
        "[Tool][ERROR] code_exec exit_code=1 latency={ms}ms",
        "[Graph] state=PLAN -> ACT reason='ready_{n}'",
        "[Planner] plan_created plan_id=pln-{n} steps={a}",
    ),
    "cv": (
        "[Data] Opened stream 1920x1080 fps={a} frames={n}",
        "[Preproc] resize width={n} height={ms}",
        "[Infer] batch done fps={a} latency={ms}ms batch={b}",
        "[Track] new track id={n} conf=0.{b}",
        "[Post][WARNING] few detections n={a}",
    ),
}
_PICKS = {"method": ("GET", "POST", "PUT", "DELETE"), "status": ("200", "201", "404", "409", "500", "503")}


def _draw(seed: int, what: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(what)), F.lit(n))


def filled(template: str, seed: int, **given: Column) -> Column:
    """A template with its slots drawn, or given."""
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        value = given[name] if name in given else F.element_at(F.array(*map(F.lit, _PICKS[name])), (_draw(seed, name, len(_PICKS[name])) + 1).cast("int")) if name in _PICKS else _draw(seed, name, {"a": 90, "b": 90, "port": 60000, "n": 100000, "ms": 9000}[name]).cast("string")
        parts += [F.lit(text), value]
    return F.concat(*parts, F.lit(rest))


def lines(spark: SparkSession, domain: str, count: int, seed: int = 12345) -> DataFrame:
    """Rows (_seq, ``@timestamp``, ``@message``)."""
    options = F.array(*(filled(t, seed) for t in TEMPLATES[domain]))
    pick = (_draw(seed, "template", len(TEMPLATES[domain])) + 1).cast("int")
    moment = F.timestamp_seconds(F.lit(1735689600) + F.col("id"))
    return spark.range(count).select(F.col("id").alias("_seq"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@timestamp"), F.element_at(options, pick).alias("@message"))


def grouped(spark: SparkSession, domain: str, count: int, seed: int = 12345, share: float = 0.2) -> DataFrame:
    """lines(), of which a share is followed by one to four continuation lines half a second apart."""
    rows = lines(spark, domain, count, seed).withColumn("id", F.col("_seq"))
    more = F.when(_draw(seed, "group", 1000) < int(1000 * share), _draw(seed, "length", 4) + 1).otherwise(0)
    each = rows.select("id", "`@timestamp`", "`@message`", F.explode(F.sequence(F.lit(0).cast("long"), more.cast("long"))).alias("part"))
    text = F.when(F.col("part") == 0, F.col("`@message`")).otherwise(F.concat(F.lit("    at step "), F.col("part").cast("string")))
    return each.select((F.col("id") * 8 + F.col("part")).alias("_seq"), F.col("`@timestamp`").alias("@timestamp"), text.alias("@message"))


def invalid(records: DataFrame, seed: int = 12345, name: str = "record") -> DataFrame:
    """Records without one of their fields, picked by hash of their order."""
    keys = F.array_sort(F.map_keys(name))
    gone = F.element_at(keys, (F.pmod(F.xxhash64(F.lit(seed), "_seq"), F.size(keys)) + 1).cast("int"))
    return records.withColumn("_gone", gone).withColumn(name, F.map_filter(name, lambda k, _: k != F.col("_gone"))).drop("_gone")


def baseline(spark: SparkSession, count: int = 50, seed: int = 12345) -> DataFrame:
    """Labelled lines of all domains: generated, parsed, classified and numbered (record_index)."""
    from functools import reduce

    from ..plans.pipeline import Options, classify_lines

    rows = [lines(spark, d, count, seed + 1000 * i).withColumn("_seq", F.col("_seq") + i * count) for i, d in enumerate(TEMPLATES)]
    done = classify_lines(reduce(DataFrame.unionByName, rows), Options())
    schema = F.when(F.col("domain") == "cv", "computer_vision").otherwise(F.col("domain"))
    return done.withColumn("record_index", F.col("_seq")).withColumn("schema_id", schema)
