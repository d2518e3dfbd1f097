"""Near-copies by similarity: documents linked where the Jaccard similarity of their sets of five-word
shingles is at least 0.8, exactly, and their components.

First each document has the fingerprint of operator 3, over the same shingles, and the index of simhash
gives the pairs that differ in few bits; those that the whole sets confirm are linked.  A fingerprint's
bits have no bound at a similarity of 0.8, so the index can't find every link: between the components of
its links, and only there, a prefix filter looks for the rest.

The shingles of every set are put in one order that is the same for all sets; two sets of similarity 0.8 share one of the first n // 5 + 1 of either's n shingles.
Which order it is changes no result, only the work: shingles found often in a sample of the documents
come last.  Candidates are filtered by their sizes and places and verified on the whole sets.

Before whole sets are read, pairs are held against a bound: each set has a map of BITMAP bits that are
flipped once for each of its shingles, two maps differ in at most as many bits as shingles are in one
set only, so pairs with more differing bits than 0.8 allows are dropped; none that is similar enough is.

Lists of up to ``longest`` sets are paired, where their components differ.  Longer ones go by rounds: each
deals a list's sets into groups at random and pairs them within a group, where the maps allow it and the
links so far leave the two in different components, since another link within a component changes
nothing.  The groups grow from round to round until each list has been one, so no link is lost.  Where many
sets are similar a few links join most of them: a sample that takes each link with probability p leaves, on
average, at most n / p links between different components of n sets.  Groups aren't quite such a sample, but
by that measure a round makes about GROWTH pairs of similar sets for each set, however many the list has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, prepare, slices
from .simhash import SEED, hashes, links, majority

WIDTH = 5
#: Bytes of text whose hashes a task holds at a time, a document at least.
SLICE = 1 << 20
#: The order counts shingles in one document of this many, in each one of up to LEAST documents, and knows
#: this many shingles as common, at most.
STEP, LEAST, COMMON = 16, 5_000, 1 << 16
#: Bits of a set's map, in longs.
LONGS = 16
BITMAP = 64 * LONGS
#: Sets of a long list that meet in the first round, and how many times more do in each next one.
MEET, GROWTH = 8, 32
#: A round is the last, with whole lists, where at most so many pairs for each place in them are left.
FEW = 8


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, which are those of simhash."""
    return np.unique(hashes(text, width))


def parity(shingles: np.ndarray) -> np.ndarray:
    """A map of BITMAP bits, as longs: bit h modulo BITMAP is flipped for each shingle h."""
    odd = np.bincount((shingles.view(np.uint64) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _read(width: int, common=None):
    """Rows (*columns but text, fp, n, hashes) of rows with a text: the name of its set of shingles, how
    many there are, and the shingles; with the common ones known, only the first n // 5 + 1 in the order,
    and the set's map besides (bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, often = (np.frombuffer(x, np.int64) for x in (common.value if common else (b"", b"")))
        for batch in slices(batches, SLICE):
            names, sizes, maps, chosen = [], [], [], [np.empty(0, np.int64)]
            for text in batch.column("text").to_pylist():
                x = shingles(text, width)
                names.append(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                sizes.append(len(x))
                x = x.view(np.int64)
                if common:
                    maps.append(parity(x))
                    at = np.searchsorted(known, x)
                    at[at == len(known)] = 0
                    count = np.where(known[at] == x, often[at], 0) if len(known) else np.zeros(len(x), np.int64)
                    x = x[np.lexsort((x, count))[: len(x) // 5 + 1]]
                chosen.append(x)
            ends = np.cumsum(list(map(len, chosen))).astype(np.int32)
            kept = [c for c in batch.schema.names if c != "text"]
            columns = [*(batch.column(c) for c in kept), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(chosen)))]
            if common:
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * LONGS), pa.array(np.concatenate([*maps, np.empty(0, np.int64)]))))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "fp", "n", "hashes", *(["bits"] if common else [])])

    return run


def _names(width: int):
    """Rows (doc_id, fp, print): the name of each document's set, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, SLICE):
            found = [hashes(x, width) for x in batch.column("text").to_pylist()]
            names = np.array([xxhash.xxh64_intdigest(np.unique(x).tobytes(), SEED) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(list(map(majority, found)), pa.int64())], ["doc_id", "fp", "print"])

    return run


def _common(texts: DataFrame, n: int, width: int):
    """Shingles that several documents of a sample hold, sorted, and how many do: two int64 buffers."""
    step = min(STEP, max(1, n // LEAST))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).mapInArrow(_read(width), "doc_id bigint, fp bigint, n int, hashes array<bigint>")
    often = sample.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON)
    found = cut(often, "common").toPandas().sort_values("h")  # at most COMMON rows
    return found["h"].to_numpy(np.int64).tobytes(), found["count"].to_numpy(np.int64).tobytes()


def _may(a: str, b: str) -> Column:
    """Whether sets whose first common shingle is at places a.i, b.i can be similar enough."""
    an, bn, ai, bi = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.i"), F.col(f"{b}.i")
    return (F.least(an, bn) * 5 >= F.greatest(an, bn) * 4) & (F.least(an - ai, bn - bi) * 9 >= (an + bn) * 4)


def _map_bound(a: list[Column], b: list[Column], n: Column) -> Column:
    """Whether maps let two sets of n shingles together be similar enough: of those both sets hold at
    least n * 4 / 9, and at least as many as bits differ are in one of them only."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(differ[1:], differ[0]) * 9 <= n


def _bounded(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose maps let them be similar enough."""
    left, right = (maps.select(F.col("fp").alias(x), F.col("n").alias(f"{x}n"), *(F.col("bits")[i].alias(f"{x}{i}") for i in range(LONGS))) for x in "ab")
    names = [[F.col(f"{x}{i}") for i in range(LONGS)] for x in "ab"]
    return pairs.join(left, "a").join(right, "b").where(_map_bound(*names, F.col("an") + F.col("bn"))).select("a", "b")


def _verified(pairs: DataFrame, maps: DataFrame, texts: DataFrame, once: DataFrame, width: int, name: str) -> DataFrame:
    """Of the pairs (a, b) of sets those of a similarity of at least 0.8; only their texts are read."""
    pairs = cut(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    pairs = cut(_bounded(pairs, maps), "bounded")
    wanted = cut(once.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp").select("doc_id", F.col("fp").alias("wanted")), "wanted")
    sets = texts.join(wanted, "doc_id").mapInArrow(_read(width), "doc_id bigint, wanted bigint, fp bigint, n int, hashes array<bigint>").where("fp = wanted")
    sets = cut(sets.select("fp", "hashes").dropDuplicates(["fp"]), "sets")
    left, right = (sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"_{x}")) for x in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    found = cut(pairs.join(left, "a").join(right, "b").where(both * 9 >= (F.size("_a") + F.size("_b")) * 4).select("a", "b"), name)
    discard(sets)
    return found


def _indexed(names: DataFrame, maps: DataFrame, texts: DataFrame, once: DataFrame, width: int) -> DataFrame:
    """Rows (a, b) of sets of at least 0.8 whose fingerprints the index of simhash links, or that share one."""
    marked = cut(names.where("doc_id is not null").select("print", "fp").distinct(), "marked")
    prints = cut(marked.groupBy("print").agg(F.min("fp").alias("node")), "prints")
    near = links(prints.select(F.col("print").alias("fp"), "node"))
    same = marked.join(prints, "print").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    pairs = near.unionByName(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(pairs, maps, texts, once, width, "indexed")


def _rest(postings: DataFrame, indexed: DataFrame, maps: DataFrame, texts: DataFrame, once: DataFrame, width: int, longest: int) -> DataFrame:
    """Rows (a, b) of sets, which with the indexed ones connect exactly what all pairs of at least 0.8 connect."""

    def paired(rows: DataFrame, key: list[str], condition: Column) -> DataFrame:
        met = rows.alias("x").join(rows.alias("y"), reduce(and_, (F.col(f"x.{k}") == F.col(f"y.{k}") for k in key)) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.component") != F.col("y.component")) & _may("x", "y") & condition)
        return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()

    pairs = paired(postings.where(F.col("size") <= longest), ["h"], F.lit(True))
    lists, found, meet = postings.where(F.col("size") > longest), [], MEET
    while True:
        counts = lists.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("within"))
        mixed = cut(counts.where(F.col("size") * F.col("size") > F.col("within")), "mixed")
        rows, most, left = mixed.agg(F.sum("size"), F.max("size"), F.sum((F.col("size") * F.col("size") - F.col("within")) / 2)).first()
        if rows:
            meet = most if left <= FEW * rows else meet
            open_ = lists.join(mixed.select("h"), "h", "left_semi")
            open_ = cut(open_ if found else open_.join(maps.select("fp", "bits"), "fp"), "open")
            groups = open_.withColumn("group", F.pmod(F.xxhash64("h", F.lit(meet), "fp"), F.ceil(F.col("size") / F.lit(meet))))
            met = paired(groups, ["h", "group"], _map_bound([F.col("x.bits")[i] for i in range(LONGS)], [F.col("y.bits")[i] for i in range(LONGS)], F.col("x.n") + F.col("y.n")))
            pairs = met if found else pairs.unionByName(met).distinct()
        if rows or not found:
            found.append(_verified(pairs, maps, texts, once, width, "similar"))
        if not rows or meet >= most:
            return reduce(DataFrame.unionByName, found)
        label = components(reduce(DataFrame.unionByName, found, indexed), "a", "b").withColumnRenamed("node", "fp")
        lists = open_.where(F.col("size") > meet).drop("component").join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        lists, meet = cut(lists, "lists"), meet * GROWTH


def similar(docs: DataFrame, width: int = WIDTH, longest: int = 2) -> DataFrame:
    """Rows (doc_id, component_id), one for each row of docs (doc_id, text, ...).

    component_id: the smallest doc_id reachable over pairs of documents whose sets of word shingles
    have a Jaccard similarity of at least 0.8, itself included.  Words are those of simhash; a text of
    fewer words than width is one shingle, texts without words are equal to each other.  A null
    doc_id can't be a component's name.  Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    names = cut(texts.mapInArrow(_names(width), "doc_id bigint, fp bigint, print bigint"), "names")
    distinct = cut(names.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    common = spark.sparkContext.broadcast(_common(texts, names.count(), width))
    once = distinct.select("fp", F.col("node").alias("doc_id"))
    heads = texts.mapInArrow(_read(width, common), "doc_id bigint, fp bigint, n int, hashes array<bigint>, bits array<bigint>").where("n > 0")
    heads = cut(heads.join(once, ["fp", "doc_id"], "left_semi").dropDuplicates(["fp", "doc_id"]).drop("doc_id"), "heads")
    maps = heads.select("fp", "n", "bits")
    indexed = _indexed(names, maps, texts, once, width)
    label = components(indexed, "a", "b").withColumnRenamed("node", "fp")
    labelled = heads.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    postings = labelled.select("fp", "n", "component", F.posexplode("hashes").alias("i", "h")).withColumn("size", F.count("*").over(Window.partitionBy("h")))
    postings = cut(postings.where("size > 1"), "postings")
    found = indexed.unionByName(_rest(postings, indexed, maps, texts, once, width, longest))
    discard(heads)
    discard(postings)
    for x in "ab":
        found = found.join(distinct.select(F.col("fp").alias(x), F.col("node").alias(f"node_{x}")), x)
    found = components(found, "node_a", "node_b")
    named = cut(distinct.join(found, distinct["node"] == found["node"], "left").select("fp", F.coalesce("component", distinct["node"]).alias("component_id")), "named")
    return names.join(named, "fp").select("doc_id", "component_id")
