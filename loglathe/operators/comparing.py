"""Comparing runs: record by record at any depth, by one digest for all, and by digests of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .records import canonical_json

#: Places of the order that one digest covers.
RANGE = 1 << 12
#: Ranges that are asked for by their bounds, so that a scan can leave out the rest; more of them are joined.
BOUNDS = 64


def _kind(literal: Column) -> Column:
    """A literal's type; whole and other numbers are types of their own."""
    first = F.substring(literal, 1, 1)
    return (
        F.when(first == "{", "object").when(first == "[", "list").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null")
        .when(literal.rlike("[.eE]"), "float").otherwise("integer")
    )


def differences(a: DataFrame, b: DataFrame, order: str = "_seq", name: str = "record", limit: int | None = 10) -> DataFrame:
    """Rows (at, path, a, b, kind) where two runs' records differ, at any depth: kind is missing, extra,
    type or value, of whole records (path '') as well; numbers differ where their texts do.  One row of
    kind count, at -1, tells the numbers of records where they differ.  limit: the first so many, by
    place and path (None: all).

    Level by level: equal values are left behind, what differs in type or as a scalar is told, and only
    the members of objects and lists that differ (lists' by place) go on to the next level.
    """
    x, y = (rows.select(F.col(order).cast("bigint").alias("at"), canonical_json(F.col(name)).alias(side)) for rows, side in ((a, "a"), (b, "b")))
    level = x.join(y, "at", "full").select("at", F.lit("").alias("path"), "a", "b").where(~F.col("a").eqNullSafe(F.col("b")))
    found = a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b"))).where("a <> b")  # of one row each
    found = found.select(F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("path"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.lit("count").alias("kind"))
    while True:
        kinds = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(_kind(F.col("a")) != _kind(F.col("b")), "type")
        level = stored(level.withColumn("kind", kinds.when(F.substring("a", 1, 1).isin("{", "["), "open").otherwise("value")), "level")
        found = found.unionByName(level.where("kind <> 'open'"))
        inner = level.where("kind = 'open'")
        if inner.isEmpty():
            break
        one, two = (F.try_parse_json(c).cast("map<string,variant>") for c in "ab")
        p, q = (F.try_parse_json(c).cast("array<variant>") for c in "ab")
        member = lambda k, v, w: F.struct(k.alias("name"), v.alias("a"), w.alias("b"))
        text = lambda v, there: F.when(there, F.coalesce(F.to_json(v), F.lit("null")))
        names = F.transform(F.array_union(F.map_keys(one), F.map_keys(two)), lambda k: member(k, text(F.element_at(one, k), F.map_contains_key(one, k)), text(F.element_at(two, k), F.map_contains_key(two, k))))
        places = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.size(q))), lambda i: member((i - 1).cast("string"), text(F.get(p, i - 1), i <= F.size(p)), text(F.get(q, i - 1), i <= F.size(q))))
        members = inner.select("at", "path", F.explode(F.when(F.substring("a", 1, 1) == "{", names).when(F.greatest(F.size(p), F.size(q)) > 0, places)).alias("x"))
        level = members.select("at", F.concat("path", F.lit("/"), "x.name").alias("path"), "x.a", "x.b").where("not (a <=> b)")
    found = found.select("at", "path", "a", "b", "kind")
    return found if limit is None else found.orderBy("at", "path").limit(limit)


def _digests(rows: DataFrame, order: str, name: str, by: list[Column]) -> DataFrame:
    """Rows (*by, n, digest): equal for groups of the same records at the same places."""
    text = F.sha2(F.concat(F.col(order).cast("string"), F.lit(" "), canonical_json(F.col(name))), 256)
    rows = rows.withColumn("_text", text)  # once, not in each part
    parts = [F.bit_xor(F.conv(F.substring("_text", 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"d{i}") for i in range(4)]
    grouped = rows.groupBy(*by).agg(F.count("*").alias("n"), *parts)
    return grouped.withColumn("digest", F.concat_ws("-", "d0", "d1", "d2", "d3")).drop("d0", "d1", "d2", "d3")


def digest(rows: DataFrame, order: str = "_seq", name: str = "record") -> DataFrame:
    """One row (n, digest) for a run: equal if all records are, in their order."""
    return _digests(rows, order, name, [])


def digests_by_range(rows: DataFrame, order: str = "_seq", name: str = "record", width: int = RANGE) -> DataFrame:
    """Rows (range, n, digest): one for each ``width`` places of the order.  Written with a run, they are
    all that another run needs to be compared with where it is equal."""
    return _digests(rows, order, name, [F.floor(F.col(order) / width).alias("range")])


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (range) in which the digests of two runs differ."""
    both = a.select("range", F.col("n").alias("an"), F.col("digest").alias("ad")).join(b.select("range", F.col("n").alias("bn"), F.col("digest").alias("bd")), "range", "full")
    return both.where("not (an <=> bn and ad <=> bd)").select("range")


def within(rows: DataFrame, ranges: DataFrame, order: str = "_seq", width: int = RANGE) -> DataFrame:
    """The rows of the given ranges: few are asked for by their bounds, which reach the scan."""
    some = [r["range"] for r in ranges.limit(BOUNDS + 1).collect()]
    if len(some) > BOUNDS:
        return rows.join(ranges, F.floor(F.col(order) / width) == ranges["range"], "left_semi")
    condition = F.lit(False)
    for x in sorted(some):
        condition = condition | ((F.col(order) >= x * width) & (F.col(order) < (x + 1) * width))
    return rows.where(condition)


def compare_runs(a: DataFrame, b: DataFrame, order: str = "_seq", name: str = "record", width: int = RANGE, limit: int | None = 10) -> DataFrame:
    """differences() of two runs, of which only the ranges are read again and joined whose digests differ."""
    ranges = stored(differing_ranges(digests_by_range(a, order, name, width), digests_by_range(b, order, name, width)), "ranges")
    return differences(within(a, ranges, order, width), within(b, ranges, order, width), order, name, limit)


def unaligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows (key, side): keys that only one of two tables has."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)
