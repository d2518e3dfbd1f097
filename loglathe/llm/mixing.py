"""Mixing sources to target weights, with DataFrame functions only.

Targets: each source's weight gives it a share of all words; no target exceeds REPEATS times its
source's size, and what is above goes to the other sources by weight (water filling).

Drawing: a source's documents fall into blocks by hash.  A target of q times the source's size takes
every block in floor(q) rounds and, of a last round, blocks in a permuted order until the target is
met; where it ends within a block, documents of that block in a permuted order.  The blocks so drawn
are the source's exact quota.  A splitting tree deals the quotas out among the output shards: at each
node the two halves' block counts are drawn from the multivariate hypergeometric distribution, by
selection sampling over the node's blocks, so that counts add up exactly; each shard then gets the
next blocks of each source's permutation, and orders its documents by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Times that a document may be taken.
REPEATS = 3
#: Words of a block at least, and blocks of all sources at most (but for one block for each source):
#: the splitting tree's state is a counter for each source, its work a draw for each block and level.
BLOCK_WORDS, BLOCKS = 1 << 14, 1 << 14
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Rows (source, source_size, rank, target) from rows (source, source_size), a row for each source."""
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    # in the order of cap / weight the sources that stop at their cap come first
    by = every.orderBy((F.col("source_size") / F.col("weight")), "rank")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    filled = (
        ranked.withColumn("cap", F.col("source_size") * repeats)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("share", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", F.row_number().over(by))
        .withColumn("fits", wide("left") * wide("weight") <= wide("cap") * wide("share"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("at", "left", "share"))).over(every)
    filled = filled.withColumn("level", level)
    target = F.when(F.col("at") < F.col("level.at"), F.col("cap").cast("double")).otherwise(F.col("level.left").cast("double") * F.col("weight") / F.col("level.share"))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _half(seed: int) -> Column:
    """Of the counts of a node the left half's, drawn without replacement."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)

    def draw(state: Column, i: Column) -> Column:
        def pick(inner: Column, j: Column) -> Column:
            hit = (_chance(F.lit(seed), F.col("level"), F.col("node"), i, j) * inner["rest"] < inner["need"]).cast("long")
            return F.struct((inner["need"] - hit).alias("need"), (inner["rest"] - 1).alias("rest"), (inner["got"] + hit).alias("got"))

        n = F.element_at("counts", i + 1)
        start = F.struct(state["need"].alias("need"), state["rest"].alias("rest"), F.lit(0).cast("long").alias("got"))
        after = F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), start, pick)
        return F.struct(after["need"].alias("need"), after["rest"].alias("rest"), F.array_append(state["left"], after["got"]).alias("left"))

    zero = F.struct(F.floor(total / 2).alias("need"), total.alias("rest"), F.array().cast("array<bigint>").alias("left"))
    each = F.when(F.size("counts") > 0, F.sequence(F.lit(0), F.size("counts") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, zero, draw, lambda s: s["left"])


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Rows (rank, shard, first, last): of the quota of blocks of each source (rank, quota) those in
    [first, last) go to the shard; there are 2**depth shards."""
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("x"))
    nodes = listed.select(F.lit(0).alias("node"), F.lit(0).alias("level"), F.col("x.rank").alias("ranks"), F.col("x.quota").alias("counts"))
    for level in range(depth):
        halves = nodes.withColumn("half", _half(seed))
        right = F.zip_with("counts", "half", lambda a, b: a - b)
        nodes = halves.select("ranks", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.lit(level + 1).alias("level"), F.col("half").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), F.lit(level + 1).alias("level"), right.alias("counts")))).alias("x")).select("ranks", "x.*")
    each = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("ranks", "counts")).alias("x")).select("shard", F.col("x.ranks").alias("rank"), F.col("x.counts").alias("n")).where("n > 0")
    last = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    return each.select("rank", "shard", (last - F.col("n")).alias("first"), last.alias("last"))


def mix(docs: DataFrame, keep: tuple[str, ...] = (), depth: int = 4, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Rows (doc_id, source, *keep, size, source_size, target, copies, taken), one for each row of
    docs (doc_id, text, source, ...).

    size: words, that is runs of other than ASCII white space (null text: 0); target: words that the
    mix takes of the source; copies: array of (shard, round, place), at most ``repeats``: the output
    shards that the document goes to and its place in each one's order; taken: words taken of it.
    Documents are taken whole, so a source's taken words meet its target but for less than a document.

    Sources are ordered by code point, null (a source as any other) last.  Empty documents count no
    words.  Repeated rows are documents of their own.  A table without rows or words gives no copies.
    The same rows give the same mix again, in any order and partitioning.  Columns of other names are
    only read if keep names them.
    """
    sized = docs.select("doc_id", "source", *(c for c in keep if c not in ("doc_id", "source")), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sized = cut(sized.withColumn("_row", F.monotonically_increasing_id()), "sized")  # written once, and so a row keeps its number
    per = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")
    all_words = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    per = per.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(BLOCK_WORDS), F.ceil(all_words / BLOCKS)))).cast("long"))
    per = per.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    per = cut(per.withColumn("rest", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long")), "per")
    rows = sized.join(per.select(F.col("source").alias("_source"), "source_size", "rank", "target", "blocks"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    drawn = cut(_drawn(rows.groupBy("rank", "block").agg(F.sum("size").alias("words")), per, depth, seed), "drawn")
    rows = rows.join(drawn, ["rank", "block"], "left").withColumn("whole", F.coalesce("whole", F.array().cast(drawn.schema["whole"].dataType)))
    partly = rows.where("part is not null")
    added = _cut_block(partly.select("_row", "doc_id", "size", "rank", "block", "part"), seed)
    partly = partly.join(added, "_row", "left").withColumn("whole", F.when(F.col("added").isNull(), F.col("whole")).otherwise(F.array_append("whole", F.col("added"))))
    rows = rows.where("part is null").drop("part").unionByName(partly.drop("part", "added"))
    copies = F.transform("whole", lambda c: F.struct(c["shard"].alias("shard"), c["round"].alias("round"), F.xxhash64(F.lit(seed), c["shard"], c["round"], F.col("doc_id")).alias("place")))
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("size") * F.size("copies"))
    return rows.select(*(c for c in sized.columns if c != "_row"), "source_size", "target", "copies", "taken")


def _drawn(blocks: DataFrame, per: DataFrame, depth: int, seed: int) -> DataFrame:
    """Rows (rank, block, whole, part): the shards and rounds that take a block whole, and in the
    round in which its source's target is met (words, shard, round) of the block met there."""
    turns = blocks.join(per.select("rank", "rounds", "rest"), "rank").withColumn("round", F.explode(F.expr("sequence(0L, rounds)")))
    turns = turns.where("round < rounds or rest > 0")
    chance = F.xxhash64(F.lit(seed), F.col("rank"), F.col("round"), F.col("block"))
    upto = F.sum("words").over(Window.partitionBy("rank", "round").orderBy(chance, "block"))
    turns = turns.withColumn("upto", upto).withColumn("room", F.when(F.col("round") < F.col("rounds"), F.col("words")).otherwise(F.col("rest") - F.col("upto") + F.col("words")))
    turns = turns.where((F.col("room") > 0) | (F.col("round") < F.col("rounds")))
    turns = turns.withColumn("turn", F.row_number().over(Window.partitionBy("rank").orderBy("round", chance, "block")) - 1)
    turns = cut(turns.select("rank", "block", "round", "words", "room", "turn"), "turns")
    split = split_quotas(turns.groupBy("rank").agg(F.count("*").alias("quota")), depth, seed)
    dealt = turns.join(split, "rank").where("turn >= first and turn < last")
    whole = F.col("room") >= F.col("words")
    return dealt.groupBy("rank", "block").agg(
        F.sort_array(F.collect_list(F.when(whole, F.struct("round", "shard")))).alias("whole"),
        F.max(F.when(~whole, F.struct("room", "round", "shard"))).alias("part"),
    )


def _cut_block(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (_row, added): the round and shard that take a document of the blocks in which targets are
    met.  These are documents in a permuted order while room for one of the largest is left, then a few
    times the largest that still fits, then the one that comes nearest to the words left over, if that
    is nearer than none.  Only ids and sizes go through the windows, texts don't."""
    block = Window.partitionBy("rank", "block")
    chance = F.xxhash64(F.lit(seed + 1), F.col("doc_id"))
    rows = rows.withColumn("upto", F.sum("size").over(block.orderBy(chance, "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("in", F.col("upto") <= F.col("part.room") - F.max("size").over(block))
    for nearest in (False,) * 10 + (True,):
        rows = rows.withColumn("over", F.col("part.room") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))).over(block), F.lit(0)))
        off = F.abs(F.col("over") - F.col("size"))
        able = ~F.col("in") & ((off < F.col("over")) if nearest else (F.col("size") <= F.col("over")))
        rows = rows.withColumn("able", able).withColumn("first", F.row_number().over(block.orderBy(F.col("able").desc(), off, chance, "doc_id")))
        rows = rows.withColumn("in", F.col("in") | (F.col("able") & (F.col("first") == 1)))
    added = F.struct(F.col("part.round").alias("round"), F.col("part.shard").alias("shard"))
    return rows.where(F.col("in")).select("_row", added.alias("added"))


def shards(mixed: DataFrame) -> DataFrame:
    """The mix as its shards hold it: a row (shard, ...) for each copy, each shard's rows together and
    in its own order."""
    each = mixed.select(F.explode("copies").alias("copy"), *(c for c in mixed.columns if c not in ("copies", "taken")))
    each = each.select("copy.shard", "copy.round", "copy.place", *(c for c in each.columns if c != "copy"))
    return each.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place")
