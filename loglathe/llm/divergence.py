"""Source divergence audit: how far the sources of a language are from each other and from the whole of
it, by the shares of its terms.

Two-dimensional group-block tiling.  The sources of a language are dealt into blocks, its terms into
chunks, and a source's counts within a chunk are one packed vector.  Each pair of blocks is a task
(and, over a large vocabulary, each range of chunks): the vectors of a block go to all tasks of its row
and of its column, and a task takes chunk after chunk, adding the terms of every pair of its sources to
a submatrix.  It holds two blocks' vectors of one chunk, whatever the vocabulary and the corpus are.

All arithmetic is on whole numbers: shares are billionths, rounded down, and differences are squared
and divided as such.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, discard, parts, prepare

#: Documents of a language that a term is in at least; what a whole is divided into; terms listed of each source.
DOCUMENTS, PARTS, TOP = 3, 1_000_000_000, 200
#: Sources of a block, terms of a chunk, chunks of a task: what is aimed at, since hashes deal them.
BLOCK, CHUNK, CHUNKS = 16, 2048, 64
#: Bytes of a text that are read at a time, and terms that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 1 << 17
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told():
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in found.items() for term, n in counts.items()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            own: Counter[str] = Counter()
            for part in parts(text.as_py() or b"", PIECE):
                own.update(_TERM.findall(part.lower().decode("utf-8", "replace")))
            if not own:
                continue
            counts, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(counts)
            counts.update(own)
            docs.update(own.keys())
            held += len(counts)
            if held > HELD:
                yield told()
                held = 0
    if found:
        yield told()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / (total + terms)) in longs: a long division by thousands, exact up to
    9e15 occurrences."""
    whole = total + terms
    found, rest = F.lit(1).cast("long"), n + 1
    for scale in (1_000_000, 1_000, 1):
        found = found + F.expr("1L") * scale * F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return found


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() of arrays."""
    found, rest = np.ones(np.broadcast(n, whole).shape, np.int64), n + 1
    for scale in (1_000_000, 1_000, 1):
        found += rest * 1000 // whole * scale
        rest = rest * 1000 % whole
    return found


_PAIRS = "lang string, source string, item string, value bigint"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (lang, row, column, part, chunk): a tile's sources come first (chunk -1), then
    of each chunk the packed vectors of its sources, with the chunk's number of terms."""
    key, names, wholes, vectors, chunk, size, sums = None, ([], []), ([], []), {}, -1, 0, None

    def add():
        """Add the chunk that has been read to the submatrix."""
        counts = [np.zeros((len(side), size), np.int64) for side in names]
        for side in (0, 1):
            for i, source in enumerate(names[side]):
                if (found := vectors.get((side, source))) is not None:
                    counts[side][i, found[0]] = found[1]
        p, q = (_shares(c, np.array(w, np.int64)[:, None]) for c, w in zip(counts, wholes, strict=True))
        for i in range(len(p)):  # one source's row at a time, so that a chunk takes little memory
            sums[i] += ((p[i] - q) ** 2 // q).sum(axis=1)

    def tile():
        rows = [(key[0], a, b, int(sums[i, j])) for i, a in enumerate(names[0]) for j, b in enumerate(names[1]) if a != b]
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "item", "value"])] if rows else []

    for batch in batches:
        for r in range(batch.num_rows):
            x = {c: batch.column(c)[r] for c in ("places", "counts")}
            lang, row, column, part, at, side, source, whole, terms = (batch.column(c)[r].as_py() for c in ("lang", "row", "column", "part", "chunk", "side", "source", "whole", "terms"))
            if (lang, row, column, part) != key or at != chunk:
                if key is not None and chunk >= 0:
                    add()
                if (lang, row, column, part) != key:
                    if key is not None:
                        yield from tile()
                    key, names, wholes, sums = (lang, row, column, part), ([], []), ([], []), None
                chunk, vectors = at, {}
            if at < 0:
                names[side].append(source)
                wholes[side].append(whole)
                sums = np.zeros((len(names[0]), len(names[1])), np.int64)
            else:
                size = terms
                if source is not None:
                    vectors[side, source] = x["places"].values.to_numpy(), x["counts"].values.to_numpy()
    if key is not None:
        if chunk >= 0:
            add()
        yield from tile()


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    """Rows by group with their rank, value down and items in the order of their bytes up."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank)
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of docs (text, lang, source, ...), with null taken as ''.

    A term is a run of ASCII letters and code points beyond ASCII, with A-Z lower-cased; a language keeps
    the terms that DOCUMENTS of its rows hold.  Every (lang, source) group and every language give a kept
    term the share p = 1 + floor(PARTS * (n + 1) / (N + V)), n being the term's occurrences there, N their
    sum over the V kept terms.  A distance of p from q is floor((p - q)**2 / q).

    part 'pair': item is another source of the language, value the distance of the group from it, summed
    over all kept terms.  part 'term': item is a kept term of the group whose p is over the language's q,
    value its distance; the TOP largest.  rank: from 1 in each group and part, by value, then item.

    A group without terms has its pairs; a language without kept terms gives pairs of 0; one with a single
    source gives none.  Repeated rows count each; no documents give no rows.  Columns other than the named
    ones are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    by = ["lang", "source"]
    counts = cut(named.mapInArrow(_counted, _COUNTS).groupBy(*by, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= DOCUMENTS).drop("docs"), "kept")
    # a row for each language or group: no large table is dealt out by its language or source alone
    languages = bounded(cut(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("all_terms")), "languages"))
    placed = kept.join(languages.withColumn("chunks", F.ceil(F.col("terms") / CHUNK)), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    placed = cut(placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1), "placed")
    found = cut(counts.drop("docs").join(placed, ["lang", "term"]), "found")
    totals = bounded(cut(found.groupBy(by).agg(F.sum("n").alias("total")), "totals"))
    groups = named.select(by).distinct().join(totals, by, "left").join(languages, "lang", "left")
    groups = groups.select(*by, F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
    groups = cut(groups.withColumn("whole", F.col("total") + F.col("terms")), "groups")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = placed.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    parts_of = groups.groupBy("lang").agg(F.max(F.greatest(F.lit(1), F.ceil(F.ceil(F.col("terms") / CHUNK) / CHUNKS))).alias("parts"))
    shape = bounded(cut(blocks.join(parts_of, "lang"), "shape"))
    tiled = bounded(cut(groups.join(shape, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "tiled"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def both_sides(rows: DataFrame) -> DataFrame:
        """Each row for the tiles of its block's row and of its block's column."""
        as_row = rows.withColumn("side", F.lit(0)).withColumn("row", F.col("block")).withColumn("column", every("blocks"))
        as_column = rows.withColumn("side", F.lit(1)).withColumn("column", F.col("block")).withColumn("row", every("blocks"))
        return as_row.unionByName(as_column)

    columns = ["lang", "row", "column", "part", "chunk", "side", "source", "whole", "terms", "places", "counts"]
    none = lambda t: F.lit(None).cast(t)
    heads = both_sides(tiled.withColumn("part", every("parts"))).withColumn("chunk", F.lit(-1).cast("long")).withColumn("terms", none("int"))
    heads = heads.withColumn("places", none("array<int>")).withColumn("counts", none("array<bigint>")).select(columns)
    # a chunk that no source of a tile has a term of still counts: its size goes to every tile
    ends = sizes.join(shape, "lang").withColumn("part", F.pmod("chunk", "parts")).withColumn("row", every("blocks")).withColumn("column", every("blocks"))
    ends = ends.select("lang", "row", "column", "part", "chunk", F.lit(0).alias("side"), none("string").alias("source"), none("bigint").alias("whole"), F.col("size").alias("terms"), none("array<int>").alias("places"), none("array<bigint>").alias("counts"))
    packed = found.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("x"))
    packed = packed.join(sizes, ["lang", "chunk"]).join(tiled.select(*by, "block", "blocks", "parts", "whole"), by)
    packed = both_sides(packed.withColumn("part", F.pmod("chunk", "parts"))).select("lang", "row", "column", "part", "chunk", "side", "source", "whole", F.col("size").alias("terms"), F.col("x.place").alias("places"), F.col("x.n").alias("counts"))
    key = ["lang", "row", "column", "part"]
    tasks = heads.unionByName(ends).unionByName(packed).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), *key).sortWithinPartitions(*key, "chunk")
    pairs = tasks.mapInArrow(_tiles, _PAIRS).groupBy(*by, "item").agg(F.sum("value").alias("value"))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all"), F.col("all_terms"), F.col("terms"))
    terms = found.join(totals, by).select(*by, F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select(*by, "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    result = _ranked(cut(pairs, "pairs"), "pair", None).unionByName(_ranked(terms, "term", TOP))
    discard(counts)
    return result


def brute_force(rows: list[tuple]) -> set[tuple]:
    """The rows of divergence() for (text, lang, source) rows, term by term."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}
    for text, lang, source in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in _TERM.findall(text or "")]
        counts.setdefault((lang or "", source or ""), Counter()).update(found)
        docs.setdefault(lang or "", Counter()).update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= DOCUMENTS]
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        shares = lambda c: {t: 1 + PARTS * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in groups if o != s}
            terms = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if groups[s][t] and p[s][t] > q[t]}
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, TOP)):
                for rank, item in enumerate(sorted(found, key=lambda x: (-found[x], x.encode()))[:top], 1):
                    out.add((lang, s, part, item, found[item], rank))
    return out
