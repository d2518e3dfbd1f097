"""Queries over files that are made of the tables: written, one for each input, and read back in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.literals import field, text_of
from ..operators import joining
from ..operators.embedded import objects
from ..operators.patterns import registry_of
from ..sources.folders import write_outputs
from ..sources.lines import read_jsonl
from ..sources.shared import fresh_path
from .pipeline import Options, parse

#: Ids of events that one file covers.
IDS = 3000


def ordered_lines(spark, sf_dir):
    """Events as lines of one file for each type, large ones in several, and the lines of all files in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.concat("event_type", F.lit(".jsonl")).alias("source_file"), F.col("event_id").alias("line"), F.to_json(F.struct("event_id", "value")).alias("value"))
    folder = fresh_path(spark, "lines")
    write_outputs(rows, folder, lines=IDS)
    found = read_jsonl(spark, folder)
    return found.select(F.col("_seq").alias("seq"), "source_file", "line", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))


def joiner_one_stream(spark, sf_dir):
    """Turns of all conversations as lines of one stream; the assistant's continue the line before them."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.concat(F.when(F.col("role") == "assistant", F.lit(" ")).otherwise(F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    made = rows.select((F.col("conv_id") * 4096 + F.col("turn")).alias("_seq"), F.lit("t").alias("@timestamp"), text.alias("@message"))
    return joining.join_lines(made).select("stream", "place", "final", F.md5("message").alias("digest"))


def embedded_objects(spark, sf_dir):
    """JSON objects within lines that are put together of events: props, and one whose strings hold brackets."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit('at {x '), "props", F.lit(' "then {"id": '), F.col("event_id").cast("string"), F.lit(r', "s": ["} \" {", {"t": "'), "event_type", F.lit('"}]} {tail } {'))
    found = events.select("event_id", F.posexplode(objects(line)).alias("n", "x"))
    return found.select("event_id", "n", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.json").alias("json"))


#: Patterns of one's own: one that no built-in pattern covers, and one in the place of a built-in one.
OWN_PATTERNS = (
    {"domain": "core_api", "pattern_id": "unknown_line", "confidence": 0.5, "regex": r"^nothing known here (\d+)$", "fields": [{"group": 1, "field": "note.number", "transform": "integer"}], "constants": {"level": "debug"}},
    {"domain": "core_api", "pattern_id": "apprunner_event", "confidence": 0.9, "regex": r"^\[AppRunner\] (\w+) .* exit code: (\d+)$", "fields": [{"group": 1, "field": "service", "transform": "lower"}, {"group": 2, "field": "note.number", "transform": "integer"}], "constants": {"level": "fatal"}},
)


def own_patterns(spark, sf_dir):
    """Lines that patterns of one's own match, with the fields that they read."""
    from .queries import events

    found = parse(events(spark, sf_dir), Options(patterns=registry_of(spark, OWN_PATTERNS))).where(F.col("pattern").isin([x["pattern_id"] for x in OWN_PATTERNS]))
    get = lambda n: text_of(field(F.col("fields"), n))
    return found.select(F.col("_seq").alias("event_id"), "pattern", "confidence", get("level").alias("level"), get("service").alias("service"), F.get_json_object(field(F.col("fields"), "note"), "$.number").cast("long").alias("number"))


QUERIES = {f.__name__: f for f in (ordered_lines, joiner_one_stream, embedded_objects, own_patterns)}

ORACLE_SQL = {
    "ordered_lines": f"""with n as (select event_id, event_type || '.classified' || case when event_id < {IDS} then '' else '.part-' || lpad(cast(event_id // {IDS} as varchar), 5, '0') end || '.jsonl' as source_file from events)
      select row_number() over (order by source_file, event_id) - 1 as seq, source_file, row_number() over (partition by source_file order by event_id) - 1 as line, event_id from n""",
    "embedded_objects": r"""with o as (select event_id, props as a, '{"id": ' || event_id || ', "s": ["} \" {", {"t": "' || event_type || '"}]}' as b from events)
      select event_id, 0 as n, 6 as start, 6 + length(a) as end, a as json from o union all select event_id, 1, 13 + length(a), 13 + length(a) + length(b), b from o""",
    "own_patterns": """select event_id, if(event_id % 6 = 3, 'apprunner_event', 'unknown_line') as pattern, if(event_id % 6 = 3, 0.9, 0.5)::double as confidence, if(event_id % 6 = 3, 'fatal', 'debug') as level,
      if(event_id % 6 = 3, 'service', null) as service, if(event_id % 6 = 3, event_id % 5, event_id % 10)::bigint as number from events where event_type = 'error' and event_id % 6 in (3, 5)""",
    "joiner_one_stream": """with m as (select '__default__' as stream, conv_id * 4096 + turn as "at", case when role = 'assistant' then ' ' else '' end || coalesce(text, '') as message from conversations),
      a as (select *, regexp_matches(message, '^[ \t]') as more from m), w as (select *, coalesce(lag(more) over s, true) as earlier, lead(more) over s as later, lead("at") over s as nxt, lead(message) over s as following from a window s as (order by "at"))
      select stream, coalesce(case when more then "at" else nxt end, 0) as place, case when more then "at" else nxt end is null as final, md5(case when not more and coalesce(later, false) then message || chr(10) || following else message end) as digest from w where not more or earlier""",
}
