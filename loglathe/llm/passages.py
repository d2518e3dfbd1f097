"""Substring dedup by words: removes every word that a window of WINDOW words covers which also starts
in an earlier document.  Exact, by repeated-phrase automata.

Parsing.  Each window has one anchor: of the ANCHOR-word strings within it the one whose hash is least,
the first of equals.  Windows that follow each other and share their anchor form a phrase, of at most
2 * WINDOW - ANCHOR words.  An anchor depends on its window's words alone, so equal windows have equal
anchors at equal places, and a window can only recur among the phrases of its anchor.

Confirming.  Phrases are grouped by their digests: of each distinct one the first document counts, so a
very frequent passage is one row from there on.  A phrase met in a later document recurs as a whole.
Where an anchor has several distinct phrases (the edges of passages), their windows are counted, and
those that several phrases hold are the confirmed passages.

Locating.  The confirmed passages are compiled into Aho-Corasick automata over words, in shards by
anchor; all phrases of a shard's anchors are streamed through its automaton, which tells every place of
every passage in them.  A shard with many passages is cut into several automata, one with many phrases
is dealt out to several tasks, each with the automaton; so neither is bounded by a task's memory, and a
document's words meet the automata of its own anchors only, however many shards there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, discard, parts, prepare
from .repeats import keyed, triggers

WINDOW, ANCHOR = 50, 25
#: Bytes of a document whose words are held at a time, about; longer ones go in pieces that overlap.
PIECE = 1 << 20
#: Distinct words whose hashes a task remembers.
REMEMBERED = 1 << 18
#: Passages of one automaton, and phrases that are streamed through one copy of it.
PASSAGES, PHRASES = 4096, 1 << 15
_ODD = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pieces(text: bytes, overlap: int = WINDOW - 1) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of parts of the text of about PIECE bytes; each but the first
    starts with the last ``overlap`` words of the one before."""
    place, held = 0, []
    for part in parts(text, PIECE):
        words = part.split()
        yield place - len(held), held + words
        place += len(words)
        held = (held + words)[-overlap:] if overlap else []


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR-word strings, from those of strings of 1, 2, 4, ... words."""
    found, width, doubled, power = None, 0, hashes, _ODD
    bits, n = ANCHOR, len(hashes) - ANCHOR + 1
    with np.errstate(over="ignore"):
        size = 1
        while bits:
            if bits & 1:
                part = doubled[width : width + n]
                found = part if found is None else found * np.uint64(power) + part
                width += size
            bits >>= 1
            if bits:
                doubled = doubled[:-size] * np.uint64(power) + doubled[size:]
                size, power = size * 2, power * power % (1 << 64)
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(32))


_PHRASES = "anchor bigint, phrase bigint, doc_id bigint, start int, windows int"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Hashes()

    def phrases(parts):
        """Of parts (document, place, words) one after the other; windows across two of them don't count."""
        counts = np.array([len(w) for _, _, w in parts])
        if counts.sum() < WINDOW:
            return None
        flat = [w for _, _, words in parts for w in words]
        ends = np.cumsum(counts)
        anchors = _anchors(known.of(flat))
        least = triggers(anchors, WINDOW - ANCHOR + 1)
        part = np.searchsorted(ends, np.arange(len(least)), side="right")
        at = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[part])
        if not len(at):
            return None
        new = np.concatenate([[True], (least[at][1:] != least[at][:-1]) | (part[at][1:] != part[at][:-1])])
        first = np.flatnonzero(new)
        a, b = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1]
        digests = b"".join([hashlib.blake2b(b" ".join(flat[i:j]), digest_size=8).digest() for i, j in zip(a.tolist(), (b + WINDOW).tolist(), strict=True)])
        docs, places = (np.array([p[i] for p in parts], np.int64) for i in (0, 1))
        within = a - (ends - counts)[part[a]] + places[part[a]]
        columns = (anchors[least[a]].view(np.int64), np.frombuffer(digests, np.int64), docs[part[a]], within.astype(np.int32), (b - a + 1).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "phrase", "doc_id", "start", "windows"])

    for batch in batches:
        held, size = [], 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for place, words in pieces(text.as_py() or b""):
                if len(words) < WINDOW:
                    continue
                held.append((doc, place, words))
                size += len(words)
                if size >= PIECE // 8:
                    if (found := phrases(held)) is not None:
                        yield found
                    held, size = [], 0
        if held and (found := phrases(held)) is not None:
            yield found


_TEXTS = "anchor bigint, phrase bigint, first bigint, windows int, words binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the phrases that are listed (start, anchor, phrase, windows) for each document."""
    for batch in batches:
        for doc, text, listed in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("phrases").to_pylist(), strict=True):
            rows, listed = [], sorted(listed, key=lambda x: x["start"])
            done = 0
            for place, words in pieces(text.as_py()):
                while done < len(listed) and (end := listed[done]["start"] + listed[done]["windows"] + WINDOW - 1) <= place + len(words):
                    x = listed[done]
                    rows.append((x["anchor"], x["phrase"], doc, x["windows"], b" ".join(words[x["start"] - place : end - place])))
                    done += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "phrase", "first", "windows", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the phrases, by its digest."""
    for batch in batches:
        digests, row, place = [], [], []
        for r, (words, n) in enumerate(zip(batch.column("words").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
            flat = words.split()
            for i in range(n):
                digests.append(hashlib.blake2b(b" ".join(flat[i : i + WINDOW]), digest_size=16).digest())
                row.append(r)
                place.append(i)
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(batch.column(c).take(at) for c in ("anchor", "phrase", "first")), pa.array(place, pa.int32())], ["window", "anchor", "phrase", "first", "place"])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (shard, cut, deal, scanned) the passages (not scanned) make an automaton, and
    the phrases after them go through it: every place of a passage, with its first document."""
    import ahocorasick

    key, automaton, ids, ready = None, None, {}, False
    for batch in batches:
        found = []
        columns = [batch.column(c) for c in ("shard", "cut", "deal", "scanned", "anchor", "phrase", "words", "passages")]
        for *at, scanned, anchor, phrase, words, passages in zip(*(c.to_pylist() for c in columns), strict=True):
            if at != key:
                key, automaton, ids, ready = at, ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}, False
            flat = words.split()
            if not scanned:
                numbers = [ids.setdefault(w, len(ids) + 1) for w in flat]
                for x in passages:
                    automaton.add_word(tuple(numbers[x["place"] : x["place"] + WINDOW]), x["first"])
                continue
            if not len(automaton):
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            numbers = tuple([ids.get(w, 0) for w in flat])
            found += [(anchor, phrase, end - WINDOW + 1, first) for end, first in automaton.iter(numbers)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["anchor", "phrase", "place", "found_in"])


def _located(texts: DataFrame) -> DataFrame:
    """Rows (anchor, phrase, place, found_in): the windows of the phrases (anchor, phrase, first, windows,
    words) that another phrase holds as well, and the first document of any that does."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(_windows, "window binary, anchor bigint, phrase bigint, first bigint, place int")
    counted = counted.groupBy("anchor", "window").agg(F.min(F.struct("first", "phrase", "place")).alias("x"), F.count("*").alias("n")).where("n > 1")
    passages = cut(counted.select("anchor", "x.*", "window"), "passages")
    shards = max(1, passages.count() // (PASSAGES // 2))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    anchors = passages.select("anchor").distinct()
    scanned = cut(texts.join(anchors, "anchor", "left_semi").select(shard, "anchor", "phrase", "words"), "scanned")
    many = passages.groupBy(shard).agg(F.ceil(F.count("*") / PASSAGES).alias("cuts"))
    deals = scanned.groupBy("shard").agg(F.ceil(F.count("*") / PHRASES).alias("deals"))
    sizes = bounded(cut(many.join(deals, "shard"), "sizes"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    listed = passages.select(shard, "anchor", "phrase", "first", "place", "window").join(sizes, "shard")
    listed = listed.withColumn("cut", F.pmod(F.xxhash64("window"), "cuts")).groupBy("shard", "cut", "deals", "anchor", "phrase").agg(F.collect_list(F.struct("place", "first")).alias("passages"))
    compiled = listed.join(texts.select("anchor", "phrase", "words"), ["anchor", "phrase"]).withColumn("deal", each("deals"))
    streamed = scanned.join(sizes, "shard").withColumn("deal", F.pmod(F.xxhash64("phrase"), "deals")).withColumn("cut", each("cuts"))
    columns = ["shard", "cut", "deal", "scanned", "anchor", "phrase", "words", "passages"]
    both = compiled.withColumn("scanned", F.lit(False)).select(columns).unionByName(streamed.withColumn("scanned", F.lit(True)).withColumn("passages", F.lit(None).cast("array<struct<place:int,first:bigint>>")).select(columns))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = both.repartition(parts, "shard", "cut", "deal").sortWithinPartitions("shard", "cut", "deal", "scanned")
    return cut(both.mapInArrow(_locate, "anchor bigint, phrase bigint, place int, found_in bigint"), "located")


def recurring_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans) of docs (doc_id, text as binary), spans being an array of (start, windows): the
    document's windows that start in [start, start + windows) start in an earlier document too."""
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WINDOW - 1)).select("doc_id", "text")
    phrases = cut(texts.mapInArrow(_parse, _PHRASES), "phrases")
    at = F.struct("doc_id", "start")
    distinct = cut(phrases.groupBy("anchor", "phrase").agg(F.min(at).alias("at"), F.max("doc_id").alias("last"), F.first("windows").alias("windows")), "distinct")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("at.doc_id").alias("lo"), F.max("last").alias("hi")).where("n > 1 and lo < hi").select("anchor")
    edges = distinct.join(mixed, "anchor").groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("at.start", "anchor", "phrase", "windows")).alias("phrases"))
    words = cut(texts.join(edges, "doc_id").mapInArrow(_texts, _TEXTS), "words")
    located = _located(words)
    discard(words)
    hits = located.groupBy("anchor", "phrase").agg(F.collect_list(F.struct("place", "found_in")).alias("hits"))
    judged = distinct.select("anchor", "phrase", F.col("at.doc_id").alias("first"), "last").join(hits, ["anchor", "phrase"], "left")
    judged = judged.withColumn("hits", F.transform(F.filter("hits", lambda x: x["found_in"] < F.col("first")), lambda x: x["place"]))
    judged = cut(judged.where("first < last or size(hits) > 0").select("anchor", "phrase", "first", "hits"), "judged")
    one = F.transform(F.coalesce("hits", F.array().cast("array<int>")), lambda x: F.struct((F.col("start") + x).alias("start"), F.lit(1).alias("windows")))
    met = phrases.join(judged, ["anchor", "phrase"]).select("doc_id", F.when(F.col("doc_id") > F.col("first"), F.array(F.struct("start", "windows"))).otherwise(one).alias("spans"))
    spans = cut(met.where("size(spans) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for table in (phrases, distinct, located, judged):
        discard(table)
    return spans


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, removed, kept = [], [], [], []
        lists = batch.column("spans")
        for r, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
            found, n, gone, left = lists[r].values, 0, 0, []
            if found is not None and len(found):
                low = found.field("start").to_numpy().astype(np.int64)
                edges = np.zeros(int((low + found.field("windows").to_numpy()).max()) + WINDOW, np.int64)
                np.add.at(edges, low, 1)
                np.add.at(edges, low + found.field("windows").to_numpy() + WINDOW - 1, -1)
                covered = np.cumsum(edges) > 0
            else:
                covered = np.zeros(0, bool)
            for place, words in pieces(text.as_py() or b"", 0):
                out = covered[place : place + len(words)]
                if out.any():
                    stay = np.flatnonzero(~np.concatenate([out, np.zeros(len(words) - len(out), bool)]))
                    gone += len(words) - len(stay)
                    words_left = [words[i] for i in stay.tolist()]
                else:
                    words_left = words
                n += len(words)
                if words_left:
                    left.append(b" ".join(words_left))
            ids.append(doc), sizes.append(n), removed.append(gone), kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def without_passages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each row of docs (doc_id, text, ...).

    A word (a run of bytes other than space and \\t to \\r, unchanged) is removed if a window of WINDOW
    words of its document covers it whose words also start in a document with a smaller doc_id.  Windows
    are judged on the input; a passage that only its own document repeats stays.  kept: the words that
    stay, joined by single spaces, in UTF-8.

    Null texts have no words; texts of fewer than WINDOW words stay whole.  A row without doc_id has no
    place in the order: it stays whole and removes nothing.  Rows that share doc_id and text are one
    document; rows that share a doc_id only are documents of their own, in the order of their texts'
    MD5 digests.  Columns other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = keyed(texts)
    spans = recurring_spans(ordered.select(F.col("_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_key")
    return ordered.join(spans, "_key", "left").select("doc_id", "text", "spans").mapInArrow(_removal, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    """{doc_id: (n_words, n_removed, kept words)} of a small corpus, by a dictionary of all windows."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for p in range(len(words[i]) - WINDOW + 1):
            first.setdefault(tuple(words[i][p : p + WINDOW]), i)
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - WINDOW + 1) if first[tuple(w[p : p + WINDOW])] < i for q in range(p, p + WINDOW)}
        out[i] = (len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    return out
