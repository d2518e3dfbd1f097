"""The chain over streams: labelling keeps no state; rates by window and joining do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.records import canonical_json
from ..plans.pipeline import Options, classify_lines


def classify_stream(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Labelled lines of a stream with the columns ``@timestamp`` and ``@message``."""
    return classify_lines(lines, options)


def write_stream(labelled: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Records as JSONL files; once: what there is now, then stop."""
    lines = labelled.select(canonical_json(F.col("record")).alias("value"))
    writer = lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_rates(labelled: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Parse rates of each domain by window of event time, for streams and tables alike."""
    timed = labelled.withColumn("event_time", F.try_to_timestamp(F.col("`@timestamp`")))
    grouped = timed.withWatermark("event_time", late).groupBy(F.window("event_time", window), "domain")
    return grouped.agg(F.count("*").alias("total"), F.count_if("ok").alias("parsed"))


def join_stream(lines: DataFrame, wait: int = 10_000) -> DataFrame:
    """Continuations joined to the line before them, in a stream of (stream, _seq, timestamp, message).

    A head waits for the next line of its stream, or for ``wait`` milliseconds: a table's joining knows
    when nothing more comes, a stream can't.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            if held:
                out.append((key[0], held[0], held[1]))
            state.remove()
        else:
            for frame in frames:
                for timestamp, message in frame.sort_values("_seq")[["timestamp", "message"]].itertuples(index=False):
                    if message[:1] in (" ", "\t"):
                        out.append((key[0], held[0], f"{held[1]}\n{message}") if held else (key[0], timestamp, message))
                        held = None
                    else:
                        if held:
                            out.append((key[0], held[0], held[1]))
                        held = (timestamp, message)
            if held:
                state.update(held)
                state.setTimeoutDuration(wait)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["stream", "timestamp", "message"])

    return lines.groupBy("stream").applyInPandasWithState(run, "stream string, timestamp string, message string", "timestamp string, message string", "append", GroupStateTimeout.ProcessingTimeTimeout)
