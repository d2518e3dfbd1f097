"""WARC archives: written with revisit records for equal payloads, and read back in splits.

Reading needs no index and no file as a whole.  Splits of a file are read apart at the records' magic
line, which payloads may hold too.  Each piece so found is a candidate record: its task emits its
offset and that of its successor, by the length that its header gives.  Pointer jumping from each
file's start then keeps the candidates that the chain of successors reaches, and so rejects magic
lines inside payloads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh_path

MAGIC = "WARC/1.1\r\n"
#: Bytes that a payload needs for equal ones to be stored once.
LEAST_PAYLOAD = 1000
#: Records of a file at most.
RECORDS_PER_FILE = 65_536


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends in values become spaces."""
    return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Rows (page_id, record): the bytes of each page's record but for the last line feed.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id has a
    response record, the others revisit it; all rows of that page_id, should it be repeated, are
    responses.  A null page_id is never revisited and never revisits.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.to_binary(F.lit(""), F.lit("utf-8"))).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    large = rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    last = cut(large.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.min("page_id").alias("other")).where("first <> other").drop("other"), "originals")
    rows = rows.join(bounded(last), ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    block = F.when(revisit, F.to_binary(F.lit(""), F.lit("utf-8"))).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select("page_id", F.concat(head.cast("binary"), block, F.lit("\r\n\r").cast("binary")).alias("record"))


def write(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, compression: str = "none") -> None:
    """Write the pages' records to files under path, a header and payload for each row.  A file's splits
    are read apart; files compressed as wholes (compression "gzip") are read by one task each."""
    rows = records(pages, least).select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)


def _jump(chains: pd.DataFrame) -> pd.DataFrame:
    """Of a file's candidates those that the chain from its start reaches."""
    chains = chains.sort_values("offset")
    offset, successor = chains["offset"].to_numpy(), chains["successor"].to_numpy()
    n = len(offset)
    if not n:
        return chains.assign(reached=np.zeros(0, bool), pieces=np.zeros(0, np.int64))
    at = np.minimum(np.searchsorted(offset, successor), n - 1)
    jump = np.append(np.where((offset[at] == successor) & (successor > offset), at, n), n)  # n: the end
    reached = np.zeros(n + 1, bool)
    reached[0] = offset[0] == 0
    while True:  # after k rounds the first 2**k records are known
        more = reached.copy()
        more[jump[reached.nonzero()[0]]] = True
        jump = jump[jump]
        if (more == reached).all():
            break
        reached = more
    reached = reached[:n]
    place = np.flatnonzero(reached)
    pieces = np.zeros(n, np.int64)
    pieces[place] = np.diff(np.append(place, n))
    return chains.assign(reached=reached, pieces=pieces)


def _header(piece: Column, name: str) -> Column:
    return F.regexp_extract(F.split_part(piece, F.lit("\r\n\r\n"), F.lit(1)), rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Rows (value, file, split, number, length, head, whole): the pieces between the magic lines of the
    files under path.  head: bytes of the piece's header; whole: bytes that its record should have, by
    its header, with the line ends after it and without the magic line (null: no length stated)."""
    text = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))
    text = text.withColumn("length", F.octet_length("value").cast("bigint"))
    head = F.octet_length(F.split_part("value", F.lit("\r\n\r\n"), F.lit(1))).cast("bigint") + 4
    whole = head + F.try_to_number(F.nullif(_header(F.col("value"), "Content-Length"), F.lit("")), F.lit("9" * 18)).cast("bigint") + 4
    return text.withColumn("head", head).withColumn("whole", whole)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (record_id, type, uri, refers_to, stated_digest, stated_bytes, payload) of the records of
    the WARC files under path, in no order.

    Bytes that no chain of records reaches are no records; a file that doesn't start with a record
    has none; a record that is cut off at its file's end is left out.
    """
    # written down first: number names a piece, and another reading might deal the splits differently
    pieces = cut(candidates(spark, path), "pieces")
    # offsets: lengths summed within a split, then over the splits of a file
    size = F.col("length") + len(MAGIC)
    light = pieces.select("file", "split", "number", "length", "whole")
    splits = light.groupBy("file", "split").agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0)))
    within = F.sum(size).over(Window.partitionBy("file", "split").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = light.withColumn("within", F.coalesce(within, F.lit(0))).join(splits.select("file", "split", "before"), ["file", "split"])
    # the bytes before the first magic line are the first piece of a file; others follow a magic line
    placed = placed.withColumn("offset", F.col("before") + F.col("within") - len(MAGIC)).where("offset >= 0")
    place = F.row_number().over(Window.partitionBy("file").orderBy("offset"))
    placed = cut(placed.select("file", "offset", "number", "whole", place.alias("place")), "placed")
    chains = placed.select("file", "offset", F.coalesce(F.col("offset") + len(MAGIC) + F.col("whole"), F.lit(-1)).alias("successor"), "number", "place")
    found = cut(chains.groupBy("file").applyInPandas(_jump, "file string, offset bigint, successor bigint, number bigint, place int, reached boolean, pieces bigint").where("reached").select("file", "number", "place", "pieces"), "records")
    # payloads stay where they are: pieces that aren't a record of their own are few unless payloads hold the magic line
    others = cut(light.select("number").join(found.where("pieces = 1").select("number"), "number", "left_anti"), "others")
    one = pieces.join(bounded(others), "number", "left_anti").where("length >= whole").select("value", "whole", "head")
    # payloads that hold the magic line: their pieces together again
    more = found.where("pieces > 1").select("file", F.col("place").alias("start"), F.explode(F.expr("sequence(place, place + cast(pieces as int) - 1)")).alias("place"))
    more = cut(more.join(placed.select("file", "place", "number"), ["file", "place"]).select("file", "start", "place", "number"), "more")
    joined = pieces.drop("file").join(bounded(more), "number").groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("place", "value", "whole", "head"))).alias("x"))
    joined = joined.select(F.array_join("x.value", MAGIC).alias("value"), F.col("x")[0]["whole"].alias("whole"), F.col("x")[0]["head"].alias("head")).where(F.octet_length("value") >= F.col("whole"))
    every = one.unionByName(joined)
    get = lambda name: F.nullif(_header(F.col("value"), name), F.lit(""))
    payload = F.substring(F.col("value").cast("binary"), F.col("head").cast("int") + 1, (F.col("whole") - F.col("head") - 4).cast("int"))
    return every.select(
        get("WARC-Record-ID").alias("record_id"), get("WARC-Type").alias("type"), get("WARC-Target-URI").alias("uri"), get("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(get("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"), get("WARC-Payload-Length").cast("bigint").alias("stated_bytes"), payload.alias("payload"),
    )


def round_trip(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), one for each row of pages
    (page_id, url, html, ...), read back from archives written to the shared folder.

    A null html is an empty payload, a null url has no header line, a null page_id stays null; empty
    tables write no records; repeated rows have a record each.  Responses' figures are those of the
    payload read, revisits' those of their header.  Columns other than the named ones are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, least)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    revisit = F.col("type") == "revisit"
    return read(spark, path).select(
        F.nullif(number("record_id"), F.lit("")).cast("bigint").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number("refers_to").cast("bigint")).alias("refers_to"),
    )
