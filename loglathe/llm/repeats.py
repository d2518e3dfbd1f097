"""Repeated passages: removes every byte that a string of LENGTH bytes covers which also starts
earlier in the corpus.  Exact, by prefix-free parsing.

Parsing.  A rolling hash runs over each document's bytes.  Each string of LENGTH bytes (a *gram*) has
one trigger: the window of WINDOW bytes within it whose hash is least, the first of equals.  Grams
that follow each other and share their trigger form a phrase: the bytes from the first gram's start to
the last one's end.  A trigger depends on its gram's bytes alone, so equal grams have equal triggers
at equal places, wherever they stand.

Corpus order.  Phrases are sorted by (trigger, phrase, document, start): the dictionary's order first,
then the parse's.  In this order
* a phrase that equals the one before it is a repeat as a whole;
* a trigger that only one phrase has can't belong to a repeated gram, its phrase is done;
* the rest, first occurrences of a phrase whose trigger other phrases have as well (the edges of
  repeated passages), go on.  A gram that starts more than REACH bytes before its trigger holds the
  REACH bytes before the trigger too, any other one as many more bytes after it: these two cores of a
  phrase are counted, and where a core is met twice the grams that hold it are handed in, ordered and
  compared one by one.
The order is a range partitioning on the full key, so that neither a frequent phrase nor a frequent
trigger fills one task.  Where a partition starts or ends within a trigger's phrases these count as
met elsewhere and hand in their grams too, which costs work, never results.

Rolling hashes only say where to look: what two different strings' equal hashes cost is work.  What is
called a repeat is told by BLAKE2b digests of the bytes themselves, of 64 bits (beside the trigger's
hash) for phrases and of 96 bits for grams, since polynomial hashes modulo 2**64 are alike for some texts.
The suffix arrays of the method are kept as these sorted tables: no task ever needs a whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, discard, prepare

LENGTH, WINDOW = 100, 32
REACH = (LENGTH - WINDOW) // 2
#: Bytes of the cores before and after a trigger, with the trigger.
CORE = LENGTH - REACH
#: Bytes that are hashed at a time; longer documents go in pieces that overlap.  A piece's arrays are
#: some tens of CHUNK longs, which are to stay in a core's cache and small beside a worker's batch.
CHUNK = 1 << 17
#: Odd multipliers and seeds of the rolling hashes: any odd values do.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of the digest of a phrase and of a gram.
PHRASE_BYTES, GRAM_BYTES = 8, 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of substrings of a piece of bytes, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, kind: int):
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[kind]))
        base = _ODD[kind] | 1
        size = CHUNK + 2 * LENGTH + 1
        self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))

    def load(self, data: np.ndarray) -> Rolling:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n] + np.uint64(n))


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> bytes:
    """The digests, of size bytes each, of the substrings [start, end) of data."""
    whole = memoryview(data.tobytes())
    return b"".join([hashlib.blake2b(whole[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    run = 1
    while 2 * run <= width:
        x, run = np.minimum(x[:-run], x[run:]), 2 * run
    return np.minimum(x[: len(x) - width + run], x[width - run :]) if run < width else x


def triggers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the index of the least, the first of equals."""
    low = np.uint64((1 << max(1, len(hashes).bit_length())) - 1)
    # the upper bits of the least hash, with its index below them
    found = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width) & low).astype(np.int64)
    # whole hashes decide, then the index: where upper bits are alike, another hash can be less
    for i in np.flatnonzero(hashes[found] != _least(hashes, width)).tolist():
        found[i] = i + hashes[i : i + width].argmin()
    return found


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of the documents' joined bytes: whole documents up to CHUNK bytes, or a part
    of a longer one with the LENGTH - 1 bytes after it."""
    starts = np.concatenate([[0], ends[:-1]])
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, starts[i] + CHUNK, side="right"))
        if j > i:
            yield int(starts[i]), int(ends[j - 1])
            i = j
            continue
        for at in range(int(starts[i]), int(ends[i]), CHUNK):
            yield at, min(at + CHUNK + LENGTH - 1, int(ends[i]))
        i += 1


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of the batch's texts (null: none) and where each one ends."""
    text = batch.column("text").fill_null(b"")
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], (at[1:] - at[0]).astype(np.int64)


def _firsts(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (same, order), and for each of them the place of the first of its equals."""
    by = np.lexsort((*order[::-1], *same[::-1]))
    new = np.ones(len(by), bool)
    if len(by) > 1:
        new[1:] = np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in same])
    return by, np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))


_PHRASES = ["trigger", "phrase", "doc_id", "start", "extent"]
#: extent: grams of the phrase (below 128) and 128 times the bytes from the first gram to the trigger;
#: negative where the phrase is known to be a repeat.
_PHRASE_SCHEMA = "trigger bigint, phrase bigint, doc_id bigint, start bigint, extent int"
_SPAN_SCHEMA = "doc_id bigint, start bigint, extent int"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows = Rolling(0)
    for batch in batches:
        data, ends = _bytes(batch)
        ids, starts = batch.column("doc_id").to_numpy(), np.concatenate([[0], ends[:-1]])
        parts = []
        for low, high in _pieces(ends):
            if high - low < LENGTH:
                continue
            piece = data[low:high]
            keys = windows.load(piece).windows(WINDOW)
            trigger = triggers(keys, LENGTH - WINDOW + 1)
            d = np.arange(np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high))
            begin, stop = np.maximum(starts[d], low) - low, np.minimum(ends[d], high) - low - LENGTH + 1
            some = begin < stop
            if not some.any():
                continue
            d, begin, stop = d[some], begin[some], stop[some]
            # a phrase starts where the grams of a document do and where the trigger changes
            new = np.concatenate([[True], trigger[1:] != trigger[:-1]])
            new[begin] = True
            turns = np.zeros(len(trigger) + 1, np.int8)
            turns[begin], turns[stop] = 1, -1
            a = np.flatnonzero(new & (np.cumsum(turns[:-1], dtype=np.int8) > 0))
            k = np.searchsorted(begin, a, side="right") - 1
            b = np.minimum(np.append(a[1:], len(trigger)), stop[k]) - 1
            parts.append((keys[trigger[a]].view(np.int64), np.frombuffer(_digests(piece, a, b + LENGTH, PHRASE_BYTES), np.int64), ids[d[k]], low + a - starts[d[k]], (b - a + 1 + 128 * (trigger[a] - a)).astype(np.int32)))
        if not parts:
            continue
        key, phrase, doc, start, extent = (np.concatenate(x) for x in zip(*parts, strict=True))
        by, lead = _firsts((doc, start), (key, phrase))
        repeat = (doc[by] != doc[by][lead]) | (start[by] != start[by][lead])
        known = by[repeat]  # an equal phrase is earlier in this very batch
        extent[known] = -extent[known]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, phrase, doc, start, extent)], _PHRASES)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of phrases in order: repeats, with a negative extent, and those whose grams are to be compared."""
    held, lead, opened = None, None, True  # the last row so far; the first of its equals; its trigger is this partition's first

    def judged(x, following):
        nonlocal lead, opened
        key, phrase, doc, start, extent = x
        new_key = np.concatenate([[lead is None or key[0] != lead[0]], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[lead is None or phrase[0] != lead[1]], phrase[1:] != phrase[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first_doc = np.where(at < 0, lead[2] if lead else 0, doc[at])
        first_start = np.where(at < 0, lead[3] if lead else 0, start[at])
        repeat = (doc != first_doc) | (start != first_start)
        shared = ~new_key | np.concatenate([~new_key[1:], [following is None or following == key[-1]]])
        if opened:
            keys = int(new_key[1:].argmax()) + 1 if new_key[1:].any() else len(key)
            shared[:keys] = True
            opened = keys == len(key)
        lead = (key[-1], phrase[-1], first_doc[-1], first_start[-1])
        kept = repeat | shared
        return pa.RecordBatch.from_arrays([pa.array(doc[kept]), pa.array(start[kept]), pa.array(np.where(repeat, -extent, extent)[kept].astype(np.int32))], ["doc_id", "start", "extent"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(batch.column(i).to_numpy() for i in range(5))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        held = tuple(x[-1:] for x in rows)
        if len(rows[0]) > 1:
            yield judged(tuple(x[:-1] for x in rows), held[0][0])
    if held is not None:
        yield judged(held, None)


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(bytes, ends, document, start within the bytes, extent) of the phrases listed for each document, in order."""
    data, ends = _bytes(batch)
    lists = batch.column("phrases")
    doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
    flat = lists.flatten()
    low = flat.field("start").to_numpy() + np.concatenate([[0], ends[:-1]])[doc]
    by = np.argsort(low, kind="stable")
    return data, ends, doc[by], low[by], flat.field("extent").to_numpy().astype(np.int64)[by]


def _within(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice]]:
    """(from, bytes, which of the sorted places start there) of the pieces that have any."""
    for i, j in _pieces(ends):
        # a part of a long document shares its last bytes with the next part, which has the places there
        chosen = slice(*np.searchsorted(at, [i, min(i + CHUNK, j) if j - i > CHUNK else j]))
        if chosen.start < chosen.stop:
            yield i, data[i:j], chosen


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cores of the listed phrases, each with the grams that hold it."""
    rolling = Rolling(1)
    for batch in batches:
        data, ends, doc, low, code = _listed(batch)
        ids, origin = batch.column("doc_id").to_numpy(), np.concatenate([[0], ends[:-1]])
        parts = []
        for i, piece, chosen in _within(data, ends, low):
            a, extent, trigger = low[chosen] - i, code[chosen] % 128, low[chosen] - i + code[chosen] // 128
            rolling.load(piece)
            edge = np.clip(trigger - REACH, a, a + extent)
            for start, end, core in ((a, edge, trigger - REACH), (edge, a + extent, trigger)):
                some = np.flatnonzero(end > start)
                d = doc[chosen][some]
                parts.append((rolling.of(core[some], core[some] + CORE).view(np.int64), ids[d], start[some] + i - origin[d], (end - start)[some].astype(np.int32)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["core", "doc_id", "start", "extent"])


_GRAM_SCHEMA = "gram bigint, other int, doc_id bigint, start bigint, extent int"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of the listed phrases: of equals in a batch the first, and runs of the others as repeats, without hashes."""
    for batch in batches:
        data, ends, doc, low, extent = _listed(batch)
        ids, origin = batch.column("doc_id").to_numpy(), np.concatenate([[0], ends[:-1]])
        at = np.repeat(low - np.concatenate([[0], np.cumsum(extent)[:-1]]), extent) + np.arange(extent.sum())
        doc = np.repeat(doc, extent)
        parts = []
        for i, piece, chosen in _within(data, ends, at):
            p = at[chosen] - i
            digest = np.frombuffer(_digests(piece, p, p + LENGTH, GRAM_BYTES), np.dtype([("gram", np.int64), ("other", np.int32)]))
            parts.append((digest["gram"], digest["other"], ids[doc[chosen]], at[chosen] - origin[doc[chosen]]))
        if not parts:
            continue
        g, h, d, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        by, lead = _firsts((d, s), (g, h))
        repeat = np.zeros(len(g), bool)
        repeat[by] = (d[by] != d[by][lead]) | (s[by] != s[by][lead])
        rd, rs = d[repeat], s[repeat]
        new = np.flatnonzero(np.concatenate([[True], (rd[1:] != rd[:-1]) | (rs[1:] != rs[:-1] + 1)])) if len(rd) else np.zeros(0, np.int64)
        runs = np.diff(np.append(new, len(rd)))
        first = ~repeat
        none = pa.nulls(len(new))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(g[first]), none.cast(pa.int64())]), pa.concat_arrays([pa.array(h[first]), none.cast(pa.int32())]), pa.array(np.concatenate([d[first], rd[new]])), pa.array(np.concatenate([s[first], rs[new]])), pa.array(np.concatenate([np.ones(first.sum(), np.int32), runs.astype(np.int32)]))],
            ["gram", "other", "doc_id", "start", "extent"],
        )


def _removal(keep: int, as_text: bool):
    """What is left of each document without the bytes that its repeats cover; keep: columns that come along first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("repeats")
            sizes, removed, runs, kept = [], [], [], []
            for r in range(batch.num_rows):
                text = texts[r].as_py() or b""
                found = lists[r].values
                sizes.append(len(text))
                if found is None or not len(found):
                    removed.append(0), runs.append(0), kept.append(text)
                    continue
                low = found.field("start").to_numpy()
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, np.minimum(low, len(text)), 1)
                np.add.at(edges, np.minimum(low + found.field("extent").to_numpy() + LENGTH - 1, len(text)), -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(keep)), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), left],
                [*batch.schema.names[:keep], "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, repeats), repeats being an array of (start, extent): the document's grams that
    start in [start, start + extent) are repeats.  The table is written to the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = texts.where(F.octet_length("text") >= LENGTH)
    phrases = cut(texts.mapInArrow(_parse, _PHRASE_SCHEMA), "phrases")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = phrases.where("extent > 0").repartitionByRange(parts, "trigger", "phrase", "doc_id", "start").sortWithinPartitions("trigger", "phrase", "doc_id", "start")
    judged = cut(ordered.mapInArrow(_judge, _SPAN_SCHEMA).unionByName(phrases.where("extent < 0").select("doc_id", "start", "extent")), "judged")
    discard(phrases)
    edges = judged.where("extent > 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "extent")).alias("phrases"))
    cores = cut(texts.join(edges, "doc_id").mapInArrow(_cores, "core bigint, doc_id bigint, start bigint, extent int"), "cores")
    shared = cut(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "shared")
    edges = cores.join(shared, "core", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("start", "extent")).alias("phrases"))
    grams = cut(texts.join(edges, "doc_id").mapInArrow(_grams, _GRAM_SCHEMA), "grams")
    discard(cores)
    discard(shared)
    first = grams.where("gram is not null").groupBy("gram", "other").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.drop("n"), "first")
    single = grams.join(first, ["gram", "other"]).where("struct(doc_id, start) > first")
    whole = judged.where("extent < 0").select("doc_id", "start", (-F.col("extent") % 128).alias("extent"))
    every = whole.unionByName(grams.where("gram is null").select("doc_id", "start", "extent")).unionByName(single.select("doc_id", "start", "extent"))
    spans = cut(every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "extent")).alias("repeats")), "spans")
    for table in (judged, grams, first):
        discard(table)
    return spans


def without_repeats(docs: DataFrame, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Rows (doc_id, *keep, n_bytes, n_removed, n_spans, kept), one for each row of docs (doc_id, text, ...).

    A byte is removed if a string of LENGTH bytes covers it that also starts earlier: in a smaller
    doc_id, or before it in the same document.  Strings are judged on the input and never cross
    documents.  kept: the bytes that stay, in order, or with as_text the text that they spell, without
    what is left of characters that were cut; n_spans: maximal runs of removed bytes.

    Null texts count as empty.  A text under LENGTH bytes has no repeats.  A row without doc_id has
    no place in the order: it stays whole and removes nothing.  Rows that share doc_id and text are
    one document; rows that share a doc_id only are documents of their own, in the order of their
    texts' MD5 digests.  Columns other than doc_id, text and keep's are not read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    ordered = keyed(texts)
    spans = repeated_spans(ordered.select(F.col("_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_key")
    joined = ordered.join(spans, "_key", "left").select(*texts.columns, "repeats")
    added = StructType.fromDDL(f"n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}")
    return joined.mapInArrow(_removal(len(keep) + 1, as_text), StructType([*texts.schema.fields[:-1], *added.fields]))


def keyed(texts: DataFrame) -> DataFrame:
    """texts with _key, a number for each document in their order: doc_id, unless texts share one."""
    digest = F.md5(F.coalesce("text", F.lit(b"")))
    digests = texts.where("doc_id is not null").select("doc_id", digest.alias("_digest"))
    shared = digests.groupBy("doc_id").agg((F.min("_digest") < F.max("_digest")).alias("differ")).where("differ")
    if shared.isEmpty():
        return texts.withColumn("_key", F.col("doc_id"))
    order = digests.distinct().repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    order = cut(order.withColumn("_key", F.monotonically_increasing_id()), "order")  # ascends with the ranges
    return cut(texts.withColumn("_digest", digest).join(order, ["doc_id", "_digest"], "left").drop("_digest"), "keyed")


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, str]]:
    """{doc_id: (n_removed, n_spans, digest of the rest)} of a small corpus, by a dictionary of all strings."""
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for i in sorted(texts):
        t = texts[i]
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1):
            if first.setdefault(t[p : p + LENGTH], (i, p)) != (i, p):
                gone[p : p + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out
