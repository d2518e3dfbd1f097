"""Multi-line joining over streams in event time, with the state of each stream kept by Spark.

Lines wait until the watermark has passed them and are then joined in the order of (event time, _seq), so
files may come in any order within the delay that the watermark allows.  A head waits for the next line
of its stream, or until the watermark is ``wait`` past it.  What is late, lines whose event time the
watermark has passed when they come, Spark leaves out.  A continuation whose head has been given out
stands alone, as one after a joined continuation does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that holds typed state and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JOINED = "stream string, timestamp string, message string"


class Joining(StatefulProcessor):
    """held: lines that the watermark hasn't passed; head: a line that the next one may continue."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ms long, seq long", "timestamp string, message string")
        self.head = handle.getValueState("head", "ms long, timestamp string, message string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for ms, seq, timestamp, message in frame[["ms", "place", "timestamp", "message"]].itertuples(index=False):
                self.held.updateValue((int(ms), int(seq)), (timestamp, message))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame([], columns=["stream", "timestamp", "message"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        due = sorted((tuple(k), tuple(v)) for k, v in self.held.iterator() if k[0] <= now)
        head = tuple(self.head.get()) if self.head.exists() else None
        for (ms, seq), (timestamp, message) in due:
            self.held.removeKey((ms, seq))
            if head and head[0] + self.wait < ms:  # the wait was over before this line
                out.append((key[0], *head[1:]))
                head = None
            if message[:1] in (" ", "\t"):
                out.append((key[0], head[1], f"{head[2]}\n{message}") if head else (key[0], timestamp, message))
                head = None
            else:
                if head:
                    out.append((key[0], *head[1:]))
                head = (ms, timestamp, message)
        if head and head[0] + self.wait <= now:
            out.append((key[0], *head[1:]))
            head = None
        if head:
            self.head.update(head)
            self.handle.registerTimer(head[0] + self.wait)
        elif self.head.exists():
            self.head.clear()
        yield pd.DataFrame(out, columns=["stream", "timestamp", "message"])

    def close(self) -> None:
        pass


def join_events(lines: DataFrame, late: str = "1 minute", wait: int = 10_000) -> DataFrame:
    """Continuations joined to the line before them, in a stream of (stream, _seq, timestamp, message).

    timestamp: text that tells the event time; lines whose timestamp doesn't, or is null, are left out, a
    null message counts as empty.  late: how much later than others lines may come; wait: milliseconds
    of event time that a head waits.  _seq orders lines of one stream and instant; a line that comes
    again with the same place counts once.  The session's state store has to be PROVIDER.
    """
    timed = lines.withColumn("event_time", F.try_to_timestamp(F.col("timestamp"))).where("event_time is not null").withColumn("ms", F.unix_millis("event_time")).withColumn("message", F.coalesce("message", F.lit("")))
    kept = timed.withWatermark("event_time", late).select("stream", F.col("_seq").alias("place"), "timestamp", "message", "event_time", "ms")
    return kept.groupBy("stream").transformWithStateInPandas(statefulProcessor=Joining(wait), outputStructType=_JOINED, outputMode="Append", timeMode="EventTime")
