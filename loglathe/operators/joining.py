"""Multi-line joining: a line that starts with white space continues the line before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order that one task joins of a stream.
BLOCK = 1 << 20
STREAM_KEYS = ("source", "stream", "logger", "component")


def stream_of(rows: DataFrame) -> Column:
    """What tells streams apart: the first of the stream keys that is there and not empty."""
    found = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in STREAM_KEYS if k in rows.columns]
    return F.coalesce(*found, F.lit("__default__"))


def join_lines(rows: DataFrame, order: str = "_seq", timestamp: str = "@timestamp", message: str = "@message", stream: Column | None = None) -> DataFrame:
    """Rows (stream, place, final, timestamp, message): the events of rows, in the order of (final,
    place, stream).

    Within a stream a continuation joins the line before it unless that is a continuation as well;
    then it stands alone.  A group keeps its head's timestamp and stands where it was complete: at its
    continuation, or at the next head of its stream; groups that nothing completes come last (final).
    Rows without a timestamp are left out, a null message counts as empty.

    A scan in segments: blocks of BLOCK places each look at their own lines of a stream, and tell their
    first and last one; what stands before and after a block comes from those of its neighbours.  So one
    stream that holds all lines is spread over as many tasks as it has blocks.  order: a whole number.
    """
    ts, text = F.col(f"`{timestamp}`"), F.coalesce(F.col(f"`{message}`"), F.lit(""))
    stream = stream_of(rows) if stream is None else stream
    at = F.col(order)
    some = rows.where(ts.isNotNull()).select(stream.alias("stream"), F.floor(at / BLOCK).alias("_block"), at.alias("_at"), ts.alias("timestamp"), text.alias("message"), text.rlike("^[ \t]").alias("_more"))
    edges = some.groupBy("stream", "_block").agg(F.min(F.struct("_at", "_more", "message")).alias("_first"), F.max(F.struct("_at", "_more")).alias("_last"))
    w = Window.partitionBy("stream").orderBy("_block")
    carried = edges.select("stream", "_block", F.lag("_last._more").over(w).alias("_earlier"), F.lead("_first").over(w).alias("_later"))
    w = Window.partitionBy("stream", "_block").orderBy("_at")
    seen = some.withColumn("_prior", F.lag("_more").over(w)).withColumn("_own", F.lead(F.struct("_at", "_more", "message")).over(w)).join(carried, ["stream", "_block"])
    seen = seen.withColumn("_before", F.coalesce("_prior", "_earlier", F.lit(True))).withColumn("_after", F.coalesce("_own", "_later"))
    heads = seen.where(~F.col("_more") | F.col("_before"))
    joined = ~F.col("_more") & F.coalesce(F.col("_after._more"), F.lit(False))
    place = F.when(F.col("_more"), F.col("_at")).otherwise(F.col("_after._at"))
    return heads.select("stream", F.coalesce(place, F.lit(0)).alias("place"), place.isNull().alias("final"), "timestamp", F.when(joined, F.concat("message", F.lit("\n"), "_after.message")).otherwise(F.col("message")).alias("message"))
