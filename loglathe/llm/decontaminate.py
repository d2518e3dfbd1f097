"""Benchmark decontamination: documents that hold questions of a benchmark, also re-parameterised.

Template canonicalisation: numbers (also spelt), names (runs of capitalised words) and units become typed
placeholders; what is left are literal words, case-folded, without punctuation around them.  A run of
names or of spelt numbers is one placeholder, so that names of one, two or three words stand for each
other.  Windows of WIDTH placeholders and words are hashed as templates and, for copies in another case,
windows of WIDTH words with every word literal.  Documents'
windows meet the benchmark's in a hash join.  Windows that meet on one diagonal (the same shift
between document and question) are taken together, and their slots have to be consistent: each value
of the question stands for one value of the document and the other way round.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: Words of a window; a question with fewer words is one window of its own length.
WIDTH = 10
#: Literal words without which a template window of WIDTH words says too little; a shorter question, as one
#: window, needs the same share of its words, and below LITERAL words it has its literal window only.
LITERAL = 5
#: Bits of the filter of the benchmark's windows that goes to every task: its size, and so its bound.
FILTER_BITS = 22
#: Distinct words whose hashes a task remembers.
REMEMBERED = 1 << 18

#: Words that are units wherever they stand (fixed list; words with other meanings are left out).
UNITS = frozenset(
    "kg mg lb lbs oz km cm mm mph kph kmh ml kwh mw ghz mhz hz gb mb kb tb "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "inch inches foot feet yard yards mile miles liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit watt watts volt volts".split()
)
#: Spelt numbers (fixed list).
SPELT = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[+\-]?[$€£¥]?\d[\d.,:/\-]*(?:%|°|[a-zµ]{1,3})?")
_EDGES = re.compile(r"^[^\w$€£¥+\-]+|[^\w%°]+$")


#: Kinds of words; of NAME and SPELT_NUMBER, runs are one placeholder.
PLAIN, NUMBER, NAME, UNIT, SPELT_NUMBER, NONE = range(6)
_PLACEHOLDERS = {NUMBER: "\0number", NAME: "\0name", UNIT: "\0unit", SPELT_NUMBER: "\0number"}


def canonical(word: str) -> tuple[str, str, int]:
    """(literal, template, kind) of a word; NONE is punctuation only and left out."""
    core = _EDGES.sub("", word)
    literal = core.casefold()
    if not any(c.isalnum() for c in core):
        return "", "", NONE
    if _NUMBER.fullmatch(core):
        kind = NUMBER
    elif literal in UNITS:
        kind = UNIT
    elif all(x in SPELT for x in literal.split("-")):
        kind = SPELT_NUMBER
    else:
        kind = NAME if core[0].isupper() and core[1:] == core[1:].lower() else PLAIN
    return literal, _PLACEHOLDERS.get(kind, literal), kind


class Words:
    """Hashes of words, remembered."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int]] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                literal, template, kind = canonical(w)
                known[w] = (xxhash.xxh64_intdigest(literal), xxhash.xxh64_intdigest(template), kind)
        return np.array([known[w] for w in words], np.uint64).reshape(-1, 3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _parts(words: Words, batch: pa.RecordBatch) -> tuple[dict, dict]:
    """Words and parts (placeholders and literal words) of the batch's texts, in order, as columns: row, place
    (a word's: that of its part), at (its first word), words (how many), hash, kind, value."""
    split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
    flat = split.flatten().dictionary_encode()
    found = words(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)]
    row = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    real = found[:, 2] != NONE
    found, row = found[real], row[real]
    literal, template, kind = found[:, 0], found[:, 1], found[:, 2].astype(np.int64)
    n = len(row)
    counts = np.bincount(row, minlength=batch.num_rows)
    at = np.arange(n) - (np.cumsum(counts) - counts)[row]
    runs = np.zeros(n, bool)
    runs[1:] = (row[1:] == row[:-1]) & (kind[1:] == kind[:-1]) & np.isin(kind[1:], (NAME, SPELT_NUMBER))
    first = np.flatnonzero(~runs)
    part = np.cumsum(~runs) - 1
    size = np.diff(np.append(first, n))
    value = np.add.reduceat(_mix(literal + (np.arange(n) - first[part]).astype(np.uint64) * _ODD), first) if n else literal
    sizes = np.bincount(row[first], minlength=batch.num_rows)
    place = np.arange(len(first)) - (np.cumsum(sizes) - sizes)[row[first]]
    every = {"row": row, "place": place[part], "at": at, "words": np.ones(n, np.int64), "hash": literal, "kind": np.full(n, PLAIN), "value": literal}
    return every, {"row": row[first], "place": place, "at": at[first], "words": size, "hash": template[first], "kind": np.where(kind == SPELT_NUMBER, NUMBER, kind)[first], "value": value}


def _windows(of: dict, rows: int, literal: bool, widths: list[int], short: bool) -> Iterator[tuple]:
    """Of each width: (hashes, where they start, width) of the windows of words, or of parts, of each text."""
    row, n_all = of["row"], len(of["row"])
    counts = np.bincount(row, minlength=rows)
    inner = np.arange(n_all) - (np.cumsum(counts) - counts)[row]
    plain = np.concatenate([[0], np.cumsum(of["kind"] == PLAIN)])
    for width in widths:
        n = n_all - width + 1
        if n <= 0:
            continue
        fits = inner[:n] + width <= counts[row[:n]]
        if short and width < WIDTH:
            fits &= counts[row[:n]] == width
        at = np.flatnonzero(fits)
        if not literal:
            mixed = plain[at + width] - plain[at]
            at = at[(mixed >= width * LITERAL // WIDTH) & (mixed < width)] if width >= LITERAL else at[:0]
        h = np.full(n, np.uint64(width * 2 + literal), np.uint64)
        for k in range(width):
            h = h * _ODD + of["hash"][k : k + n]
        yield _mix(h[at]), at, width


_SCHEMA = "hash bigint, id bigint, place int, at int, words int, literal boolean, width int, slots array<bigint>"


def _rows(id_column: str, widths: dict[bool, list[int]], short: bool, bits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool) if bits is not None else None
        for batch in batches:
            ids = batch.column(id_column).to_numpy(zero_copy_only=False)
            for literal, of in zip((True, False), _parts(words, batch), strict=True):
                ends = np.cumsum(of["words"])
                for h, at, width in _windows(of, batch.num_rows, literal, widths[literal], short):
                    if held is not None:
                        kept = held[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                        h, at = h[kept], at[kept]
                    if not len(h):
                        continue
                    inner = at[:, None] + np.arange(width)
                    slot = of["kind"][inner] != PLAIN
                    values = of["value"][inner][slot] ^ (of["kind"][inner][slot].astype(np.uint64) << np.uint64(61))
                    slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(slot.sum(axis=1))]).astype(np.int32)), pa.array(values.view(np.int64)))
                    n = len(h)
                    covered = ends[at + width - 1] - ends[at] + of["words"][at]
                    columns = [h.view(np.int64), ids[of["row"][at]].astype(np.int64), of["place"][at].astype(np.int32), of["at"][at].astype(np.int32), covered.astype(np.int32), np.full(n, literal), np.full(n, width, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), slots], ["hash", "id", "place", "at", "words", "literal", "width", "slots"])

    return run


def questions(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, question_id) of benchmark (item_id, text, ...): the smallest item_id with an equal
    text, under which contaminated() names all of them.  Rows without an id or a text have none."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return rows.join(rows.groupBy("text").agg(F.min("item_id").alias("question_id")), "text").select("item_id", "question_id")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, n_words, exact, n_items): the documents of docs (doc_id, text, ...) that hold a
    window of a question of benchmark (item_id, text, ...), once for each such question.

    n_words: words that the windows of the best diagonal (of words and placeholders) cover; exact: they are literally the same
    but for case and punctuation, otherwise values differ consistently.  Equal questions, of
    which there are n_items, go by the smallest item_id; questions() tells which they are.  A question of fewer than LITERAL words is only found literally;
    null or empty texts have no windows; rows without an id take no part; repeated rows count once.  Columns other
    than the named ones are not read.

    Every window of every document is looked up in a filter of the benchmark's windows, whose size is
    fixed (2**FILTER_BITS bits), and those that pass are joined by hash; a fuller filter lets more
    windows through and changes no result.  The join is an ordinary one: neither side is broadcast
    but where Spark finds it small, and a window that very many documents hold is split by Spark.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").cast("bigint").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    items = cut(items.select("item_id", "text", "n_items"), "items")
    asked = items.select("item_id", "text").mapInArrow(_rows("item_id", dict.fromkeys((True, False), list(range(1, WIDTH + 1))), True, None), _SCHEMA).drop("at", "words").distinct()
    asked = cut(asked.select("hash", F.col("id").alias("item_id"), F.col("place").alias("item_place"), "literal", "width", F.col("slots").alias("item_slots")), "asked")
    found = sorted((r["literal"], r["width"]) for r in asked.select("literal", "width").distinct().collect())  # at most 2 * WIDTH
    widths = {literal: [w for x, w in found if x == literal] for literal in (True, False)}
    filled = asked.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)  # at most 2**FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[filled] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = texts.mapInArrow(_rows("doc_id", widths, False, shared), _SCHEMA)
    met = held.withColumnRenamed("id", "doc_id").join(asked, ["hash", "literal", "width"])
    met = met.where("size(slots) = size(item_slots)")
    diagonal = met.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.collect_set(F.struct("at", "words", "literal")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("pairs"),
    )
    one_to_one = (F.size("pairs") == F.size(F.array_distinct("pairs.item_slots"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.slots")))
    literal = F.filter("windows", lambda w: w["literal"])
    words = lambda windows: F.size(F.array_distinct(F.flatten(F.transform(windows, lambda w: F.sequence(w["at"], w["at"] + w["words"] - 1)))))
    judged = diagonal.select("doc_id", "item_id", F.when(one_to_one, words(F.col("windows"))).otherwise(words(literal)).alias("n_words"), (words(literal) == words(F.col("windows"))).alias("exact"))
    best = judged.where("n_words > 0").groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "exact")).alias("best"))
    return best.join(items.select("item_id", "n_items"), "item_id").select("doc_id", "item_id", "best.n_words", "best.exact", "n_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; columns stay as they are."""
    return docs.join(cut(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated"), "doc_id", "left_anti").select(docs.columns)
