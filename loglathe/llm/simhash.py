"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Links come from an inverted index over byte positions.  Two fingerprints that differ in at most two
bits agree in at least six of their eight bytes.  The eight positions form four neighbouring pairs;
two differing bytes touch at most two of them, so the bytes of some two pairs are all equal.  Each of
the six choices of two pairs is a posting list of the index.  Within a list the equal positional bytes
of each pair of fingerprints are tallied, pairs below six are dropped, and the rest are verified bit
by bit.

Only distinct fingerprints are indexed.  A list longer than ``longest`` isn't paired: its members meet
in the lists of their one-bit neighbours instead.  Fingerprints within two bits have a common
neighbour at no more than one bit from either, and a neighbour has at most 65 fingerprints, all
within two bits of each other: a star from each such list links them exactly, without any pair more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, prepare

BITS, BYTES, SEED = 64, 8, 42
#: Differing bits of a link; the index's layout follows from it.
DISTANCE = 2


def hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """The XXH64 hashes (seed 42) of the text's word shingles, repeats included.

    Words are runs of non-white-space bytes with A-Z lower-cased; a text of fewer words than width is
    one shingle; none: no hash.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes, as a signed long: a bit is set where over half of them have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The majority of the hashes of the text's word shingles; of no words: zero."""
    return majority(hashes(text, width))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fp), one for each row of docs."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(width), "doc_id bigint, fp bigint")


def links(distinct: DataFrame, longest: int = 64) -> DataFrame:
    """Links between the distinct fingerprints of rows (fp, node): rows (a, b) of nodes, which
    connect exactly what pairs within DISTANCE bits connect."""
    pairs = list(combinations(range(4), 2))
    mask = [sum(0xFFFF << (16 * i) for i in chosen) for chosen in pairs]
    signed = [m - (1 << 64) if m >> 63 else m for m in mask]
    postings = distinct.select("fp", "node", F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)))).alias("list")).select("list.*", "fp", "node")
    ranked = postings.withColumn("n", F.row_number().over(Window.partitionBy("choice", "bytes").orderBy("fp"))).where(F.col("n") <= longest + 1)
    lists = cut(ranked.groupBy("choice", "bytes").agg(F.collect_list(F.struct("fp", "node")).alias("members")).where(F.size("members") > 1), "postings")

    def tally(differing):
        return sum((differing.bitwiseAND(F.lit((0xFF << (8 * i)) - ((1 << 64) if i == 7 else 0))) == 0).cast("int") for i in range(BYTES))

    def near(x):
        return F.transform(
            F.filter("members", lambda y: (y["fp"] > x["fp"]) & (tally(y["fp"].bitwiseXOR(x["fp"])) >= BYTES - DISTANCE) & (F.bit_count(y["fp"].bitwiseXOR(x["fp"])) <= DISTANCE)),
            lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")),
        )

    short = lists.where(F.size("members") <= longest).select(F.explode(F.flatten(F.transform("members", near))).alias("link")).select("link.*")
    long = lists.where(F.size("members") > longest).select("choice", "bytes")
    dense = postings.join(long, ["choice", "bytes"], "left_semi").select("fp", "node").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)) for i in range(BITS)))
    neighbours = dense.select("node", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("neighbour"))
    stars = neighbours.groupBy("neighbour").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    stars = stars.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    return short.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, longest: int = 64) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs (doc_id, text, ...).

    fingerprint: 16 lower-case hex digits; component_id: the smallest doc_id reachable over links of
    at most two differing bits, itself included.  Null and empty texts have the fingerprint zero and
    are linked as any other; repeated rows keep a row each; a null doc_id can't be a component's
    name, its row has the name of its component's smallest doc_id, or null if it has none.
    Columns other than doc_id and text are not read.
    """
    marked = cut(fingerprints(docs, width), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(links(distinct.where("node is not null"), longest), "a", "b")
    named = cut(distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 3, longest: int = 64) -> DataFrame:
    """docs without the near-copies: of each component the document named by it stays, once, and
    with it every row that has no doc_id.  Columns stay as they are."""
    return first_of_each(docs, near_duplicates(docs, width, longest))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs reduced to the documents that name a component of the rows (doc_id, component_id), each
    once, and the rows that have no doc_id."""
    names = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(cut(names, "kept"), "doc_id", "left_semi")
    once = kept.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id")))).where("_row = 1").drop("_row")
    return once.unionByName(docs.where("doc_id is null"))
