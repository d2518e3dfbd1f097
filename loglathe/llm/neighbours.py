"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, and posted in the inverted files of the first
POSTED of them.  A query goes to the files of its first VISITED pivots; a file's vectors are ranked
by the footrule distance between the two orders, and the best are reranked by cosine.

Vectors of one direction are one class in the index, with as many of its smallest ids as a query can
need, so that a very frequent vector neither fills a file nor crowds out others; queries of one
direction are asked once.  Files are dealt out in shards of bounded size, so no file is ever gathered
whole.  Scores are added up in the order of the components, so that equal scores are equal everywhere
and ties go by id.  Vectors are scaled by powers of two before anything is squared, which changes no
score and leaves none without a number; those given out are worked out on the rows' own vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Pivots for n distinct vectors: PIVOTS_BY_ROOT times their root, between these bounds.  The pivots
#: are the sample that the index is fitted on: at most MOST_PIVOTS vectors, whose ids hash lowest.
PIVOTS_BY_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 2.0, 16, 1 << 16
#: Pivots of an order, files that a vector is posted in, and files that a query visits.
ORDER, POSTED, VISITED = 48, 8, 48
#: Numbers of a block of distances to pivots that a task holds at a time.
BLOCK = 1 << 22
#: What rounding can change of a cosine, with room to spare.
MARGIN = 1e-9
#: Of a file's shard, vectors at least and their share that are reranked for a query; a shard's size aimed at.
RERANKED, RERANKED_SHARE, SHARD = 96, 0.2, 4096


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component of each is from 0.5 to 1: products and sums
    then neither overflow nor vanish, and cosines are what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _orders(pivots: np.ndarray, posted: int) -> Callable:
    """Adds the order of the nearest pivots, and the file for each of the first ``posted``."""

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            x = _scaled(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            k = min(ORDER, len(pivots))
            order, step = np.empty((len(x), k), np.int32), max(1, BLOCK // len(pivots))
            for i in range(0, len(x), step):
                near = -(x[i : i + step] @ pivots.T)
                first = np.argpartition(near, k - 1, axis=1)[:, :k]
                by = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")
                order[i : i + step] = np.take_along_axis(first, by, 1)
            out = frame.assign(order=list(order)).iloc[np.repeat(np.arange(len(frame)), min(posted, k))]
            yield out.assign(file=order[:, : min(posted, k)].ravel())

    return run


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows of x with y (a row, or as many), added in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[..., j]
    return total


def _visit(k: int) -> Callable:
    """Of a file's shard the k + 1 nearest classes to each query: one of them may be the query alone."""

    def run(key, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"asked": np.zeros(0, np.int64), "class": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(found) or not len(asked):
            return none
        x = _scaled(np.stack(found["embedding"].to_numpy()).astype(np.float64))
        norm = np.sqrt(_dot(x, x))
        name = found["class"].to_numpy()
        order = np.stack(found["order"].to_numpy())
        places, most = np.arange(order.shape[1], dtype=np.int32), max(RERANKED, int(RERANKED_SHARE * len(x)))
        parts = []
        for query, vector, own in zip(asked["asked"], asked["embedding"], asked["order"], strict=True):
            q = _scaled(np.asarray(vector, np.float64)[None])[0]
            at = np.full(max(int(order.max()), int(own.max())) + 1, len(own), np.int32)
            at[own] = places[: len(own)]
            there = at[order]
            # the footrule over both orders: a pivot of one only counts as standing behind the other's last
            rule = np.abs(there - places).sum(axis=1) - (len(own) - there).sum(axis=1)
            chosen = np.argpartition(rule, most)[:most] if len(rule) > most else np.arange(len(rule))
            size = np.sqrt(_dot(q[None], q[None]))[0]
            about = (x[chosen] @ q) / (norm[chosen] * size)
            kept = min(k + 1, len(chosen))
            chosen = chosen[about >= np.partition(about, -kept)[-kept] - MARGIN]
            score = _dot(x[chosen], q) / (norm[chosen] * size)
            top = np.lexsort((name[chosen], -score))[:kept]
            parts.append((np.full(len(top), query), name[chosen[top]], score[top]))
        return pd.DataFrame(dict(zip(("asked", "class", "score"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))

    return run


def directed(rows: DataFrame) -> DataFrame:
    """rows with dims and direction: the vector by its largest component, alike for positive multiples."""
    largest = F.aggregate("embedding", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v).cast("double")))
    return rows.withColumn("dims", F.size("embedding")).withColumn("_most", largest).withColumn("direction", F.transform("embedding", lambda v: v.cast("double") / F.col("_most"))).drop("_most")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) whose vectors take part: not null, empty or zero, all components finite."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(finite & F.exists("embedding", lambda v: v != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k found nearest rows of vectors (vec_id, embedding,
    ...) to each of queries (same columns), by cosine, nearest first and ties to the smaller id.

    A query's own row (by id) is no candidate.  Vectors that are null, empty, zero, or hold null or
    non-finite components take no part; vectors of another length than the query's are no candidates;
    repeated rows count once; of positive multiples of a vector those with the smallest ids are found;
    fewer candidates than k are all given; no queries or no vectors give no rows.
    Columns other than the named ones are not read.
    """
    spark: SparkSession = vectors.sparkSession
    prepare(spark)
    # k + 1 ids of a class are enough: the query's own may be among them
    few = directed(usable(vectors)).distinct().withColumn("n", F.row_number().over(Window.partitionBy("dims", "direction").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("dims", "direction").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("members"))
    classes = classes.select("dims", F.col("members")[0]["vec_id"].alias("class"), F.col("members")[0]["embedding"].alias("embedding"), F.slice("members", 2, k + 1).alias("others"))
    classes = cut(classes, "classes")
    every = directed(usable(queries)).withColumnRenamed("vec_id", "query_id").distinct()
    asked = cut(every.groupBy("dims", "direction").agg(F.min("query_id").alias("asked"), F.min_by("embedding", F.struct("query_id", "embedding")).alias("embedding")), "asked")
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    queried = {r["dims"]: r["n"] for r in asked.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    element = classes.schema["embedding"].dataType.elementType.simpleString()
    ordered = f"embedding array<{element}>, order array<int>, file int"
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    found = None
    for dims in sorted(sizes.keys() & queried.keys()):
        some, own, n = classes.where(F.col("dims") == dims), asked.where(F.col("dims") == dims), sizes[dims]
        wanted = int(min(max(PIVOTS_BY_ROOT * n**0.5, LEAST_PIVOTS), MOST_PIVOTS))
        pivots = np.array([r[0] for r in some.orderBy(F.xxhash64("class"), "class").limit(wanted).select("embedding").collect()], np.float64)
        pivots = _scaled(pivots)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        shards, rounds = (max(1, round(m * each / len(pivots) / SHARD)) for m, each in ((n, POSTED), (queried[dims], VISITED)))
        posted = some.select("class", "embedding").mapInPandas(_orders(pivots, POSTED), f"class bigint, {ordered}")
        posted = posted.withColumn("shard", part("class", shards)).withColumn("round", parts(rounds))
        visits = own.select("asked", "embedding").mapInPandas(_orders(pivots, VISITED), f"asked bigint, {ordered}")
        visits = visits.withColumn("shard", parts(shards)).withColumn("round", part("asked", rounds))
        met = posted.groupBy("file", "shard", "round").cogroup(visits.groupBy("file", "shard", "round")).applyInPandas(_visit(k), "asked bigint, class bigint, score double")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def best(rows: DataFrame, by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), by))
        return rows.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n")

    near = best(found.distinct(), "class").join(classes.select("class", "embedding", "others"), "class")
    near = near.select("asked", "score", F.explode(F.concat(F.array(F.struct(F.col("class").alias("vec_id"), "embedding")), "others")).alias("x")).select("asked", "score", "x.*")
    near = best(near.groupBy("asked", "vec_id").agg(F.max("score").alias("score"), F.first("embedding").alias("embedding")), "vec_id").drop("score")
    members = every.join(asked.select("dims", "direction", "asked"), ["dims", "direction"]).select("query_id", "asked", _powers("embedding").alias("q"))
    pairs = members.join(near.select("asked", "vec_id", _powers("embedding").alias("x")), "asked").where("query_id <> vec_id")
    scored = pairs.groupBy("query_id", "vec_id").agg(F.max(_cosine("q", "x")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _powers(name: str) -> Column:
    """_scaled() of a column's vectors; in two steps, since the power itself may be too large for a number."""
    largest = F.aggregate(name, F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v).cast("double")))
    power = -F.floor(F.log2(largest)).cast("double")
    half = F.floor(power / 2)
    return F.transform(name, lambda v: v.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half))


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
