"""What the training-data operators share: shared storage, Arrow batch sizes, components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of one Arrow batch handed to Python; bounds a worker's memory.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast, of some 100 bytes each.
BROADCAST_ROWS = 100_000
#: Columns that an operator hands through, in one struct.
KEPT = "_kept"

_tables = threading.local()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about size bytes of text, a document at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        edges = np.append(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // size, prepend=-1)), batch.num_rows)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about size bytes, cut where white space stands, so that no word is cut."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end] if at or end < len(text) else text
        at = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Only where it is unset, in a local session, the session's warehouse stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/loglathe-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so that a lost
    executor costs no recomputation, and later plans see an unpartitioned table, which lets
    adaptive execution split hot keys of a join with it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # the driver lets go of shuffles that no plan needs any more, executors delete them
    table = spark.read.schema(df.schema).parquet(path)
    table._loglathe_path = path
    written().append(path)
    return table


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join that cut() wrote: broadcast if its counted rows are few, else joined by sort and
    merge.  Left alone, Spark goes by the size of its compressed files, which says little."""
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table that cut() wrote and that no plan still to run reads."""
    _delete(table.sparkSession, table._loglathe_path)


def written() -> list[str]:
    """Paths that this thread wrote by cut(), in order, without those that sweep() deleted."""
    if not hasattr(_tables, "paths"):
        _tables.paths = []
    return _tables.paths


def sweep(kept: DataFrame, since: int) -> None:
    """Delete what this thread wrote by cut() but for its first ``since`` tables and kept; call it once
    kept is written, since no plan reads the tables on the way to it any more."""
    paths = written()
    for path in paths[since:]:
        if path != kept._loglathe_path:
            _delete(kept.sparkSession, path)
    paths[since:] = [kept._loglathe_path]


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """docs with the columns of other names than own in one struct, so that no name of theirs can be one
    that an operator adds."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*others).alias(KEPT) if others else F.lit(0).alias(KEPT))


def unpacked(columns: list[str], *own: str) -> list[Column]:
    """The columns again, in their order, from rows that packed() was given with own."""
    return [F.col(c) if c in own else F.col(KEPT).getField(c).alias(c) for c in columns]


def remove_shared(spark: SparkSession) -> None:
    """Delete what this application wrote by cut(); call it once no result is read any more."""
    _delete(spark, shared_folder(spark))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected link table: rows (node, component), the component
    being the smallest node reachable.  Nodes without a link have no row.

    Each round hooks every node's neighbours to the smallest of them (large star, then small
    star), so that rounds grow with the logarithm of a component's diameter; a round is written
    to the shared folder.  No neighbourhood is gathered: a round is a min by key and a join.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct(), "small")
        n, s, roots = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        old = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if (n, s) == (old[0], old[1]) and roots == n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
