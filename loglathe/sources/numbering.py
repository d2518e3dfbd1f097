"""Line numbers over files: contiguous, in the order of the files' names, whatever parts Spark reads them in.

Spark packs parts of files into tasks by size, so neither tasks nor their rows follow the names.  Each
part's lines do stand together, in order: they are counted by part, a running total over the parts in
the order of (name, place in the file) says where each one starts, and a line's number is its part's
start and its place within.  Lines themselves are never shuffled; only a row for each part is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Parts of files up to which their starts are sent to every task, some 100 bytes each; beyond, they are joined.
BROADCAST_PARTS = 1 << 20


def running_total(rows: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows before, in an order without ties.  A prefix sum of two
    steps: within ranges of the order, and over the ranges' sums, of which there are as many as tasks."""
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_range", (F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_sum")).alias("_range_start"))
    before = F.sum(value).over(Window.partitionBy("_range").orderBy(*order)) - F.col(value)
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_range_start") + before).drop("_range", "_range_start")


def file_name(path: Column) -> Column:
    """A path as it is written, from the escaped one that Spark tells."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (_seq, source_file, line, value) of the lines of text files: _seq from 0 over all files in the
    order of their paths' code points, line from 0 within its file.  source_file: the file's name without
    folders.  Blank lines count; empty files have none."""
    found = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    parts = found.groupBy("_path", "_from").agg(F.count("*").alias("_lines"), F.min("_id").alias("_first"))
    parts = running_total(parts.withColumn("_decoded", file_name(F.col("_path"))), ["_decoded", "_path", "_from"], "_lines", "_start")
    parts = stored(parts.withColumn("_base", F.min("_start").over(Window.partitionBy("_path"))).drop("_decoded", "_lines"), "parts")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts.hint("merge")
    within = F.col("_id") - F.col("_first")
    numbered = found.join(parts, ["_path", "_from"])
    return numbered.select((F.col("_start") + within).alias("_seq"), file_name(F.col("_name")).alias("source_file"), (F.col("_start") - F.col("_base") + within).alias("line"), "value")
