"""Sources and sinks of lines and records: JSONL files, directories, in-memory lists, payloads."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import RECORD, field, parsed, strip, text_of
from ..operators.records import canonical_json, parse_ok
from .numbering import numbered_lines

#: Domains by what a file's name holds, in order (fixed values).
NAME_HINTS = (("agentic", "agentic"), ("core_api", "core_api"), ("computer_vision", "cv"), ("cv", "cv"), ("llm", "llm"), ("api", "core_api"))


def spread(rows: DataFrame, key: str = "_seq") -> DataFrame:
    """Rows of a scan over all cores, where its files have fewer parts than there are: labelling a line
    costs far more than moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows (_seq, source_file, line, value, given) of JSONL files: blank lines and lines that aren't JSON
    are left out.  _seq numbers all lines in the order of the files' names, line those of a file."""
    lines = numbered_lines(spark, path).withColumn("value", strip(F.col("value")))
    return lines.where("value <> ''").withColumn("given", parsed(F.col("value"))).where(F.col("given").isNotNull())


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same of files as they come; without _seq."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_name").alias("source_file"), strip(F.col("value")).alias("value"))
    return lines.where("value <> ''").withColumn("given", parsed(F.col("value"))).where(F.col("given").isNotNull())


def raw_events(rows: DataFrame) -> DataFrame:
    """given's ``@timestamp``, ``@message`` and stream keys as columns."""
    names = ("@timestamp", "@message", "source", "stream", "logger", "component")
    return rows.select("*", *(text_of(field(F.col("given"), n)).alias(n) for n in names if n not in rows.columns))


def from_list(spark: SparkSession, items: list[dict[str, Any]]) -> DataFrame:
    import json

    return spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(items)], "_seq long, value string").withColumn("given", parsed(F.col("value")))


def guess_format(rows: DataFrame, probe: int = 50) -> str:
    """``raw`` or ``json``, by the first of the first rows that tells, then by any."""
    first = rows.orderBy("_seq").limit(probe).select(*(F.map_contains_key("given", k).alias(k.strip("@")) for k in ("@message", "timestamp", "meta"))).collect()
    for r in first:
        if r["message"]:
            return "raw"
        if r["timestamp"] and r["meta"]:
            return "json"
    return "raw" if rows.where(F.map_contains_key("given", F.lit("@message"))).head(1) else "json"


def hint_of_name(name: Column) -> Column:
    """The domain that a file's name hints at, or SQL NULL."""
    chain = F
    for text, domain in NAME_HINTS:
        chain = chain.when(F.lower(name).contains(text), domain)
    return chain


def choose_domain(explicit: str | None, name: str | None) -> tuple[str | None, str]:
    """(domain, where it is from): given explicitly, by the file's name, or found for each line."""
    if explicit:
        return explicit, "explicit"
    low = (name or "").lower()
    for text, domain in NAME_HINTS:
        if text in low:
            return domain, "filename"
    return None, "auto"


class Rejected(ValueError):
    """A payload that isn't what it should be; status as of HTTP."""

    def __init__(self, message: str, status: int = 422):
        super().__init__(message)
        self.status = status


def check_payload(items: Any, needed: tuple[str, ...] = ()) -> list[dict]:
    """items, if they are a list of objects that have the needed fields."""
    if not isinstance(items, list):
        raise Rejected("Input should be a valid list")
    for i, x in enumerate(items):
        if not isinstance(x, dict):
            raise Rejected(f"item {i}: Input should be a valid dictionary")
        for k in needed:
            if k not in x:
                raise Rejected(f"item {i}: {k}: Field required")
    return items


def read_ndjson(text: str) -> list[dict]:
    """The objects of NDJSON text; unlike a file's, a bad line is an error."""
    import json

    out = []
    for i, line in enumerate(text.splitlines()):
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError as e:
                raise Rejected(f"line {i + 1}: {e}") from e
    return check_payload(out)


def classify_payload(spark: SparkSession, payload: dict[str, Any]) -> dict[str, Any]:
    """A request ``{"logs": [...], "domain", "filename", "input_format", "enable_validation"}``: its
    answer, with the records as objects.  Items that aren't objects are left out."""
    import json

    from ..plans.pipeline import Options, classify_lines, classify_records

    logs = payload.get("logs")
    if not isinstance(logs, list):
        return {"statusCode": 400, "error": "logs should be a list"}
    try:
        domain, source = choose_domain(payload.get("domain"), payload.get("filename"))
        rows = from_list(spark, [x for x in logs if isinstance(x, dict)])
        form = payload.get("input_format") or guess_format(rows)
        options = Options(domain=domain, validate=payload.get("enable_validation", True))
        done = classify_lines(raw_events(rows), options) if form == "raw" else classify_records(rows.drop("given"), options)
        found = done.select("_seq", canonical_json(F.col("record")).alias("json"), parse_ok(F.col("record")).alias("ok")).orderBy("_seq").collect()
    except Exception as e:  # the answer tells what went wrong
        return {"statusCode": 500, "error": str(e)}
    return {"statusCode": 200, "processed": sum(r["ok"] for r in found), "total": len(found), "results": [json.loads(r["json"]) for r in found], "inference": {"domain": domain, "source": source}}


def write_jsonl(rows: DataFrame, path: str, name: str = "record", by_file: str | None = None) -> None:
    """A JSON object a line, in canonical order; by_file: a column by whose values folders are made.
    Spark's ``_SUCCESS`` marks a whole run."""
    lines = rows.select(canonical_json(F.col(name)).alias("value"), *([by_file] if by_file else []))
    writer = lines.write.partitionBy(by_file) if by_file else lines.write
    writer.text(path)


__all__ = ["RECORD", "read_jsonl"]
