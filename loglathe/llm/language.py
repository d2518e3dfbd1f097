"""Language identification of mixed-language texts.

Script ranges narrow the candidates of each word to the languages that were learned with its script;
a naive Bayes model over the word's character n-grams scores them; Viterbi with a penalty for each
switch then labels the words, and so spans of one language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, prepare, slices

#: Labelled documents of a language that are learned from, at most: the bound of the sample.
SAMPLE = 1500
#: Buckets of hashed n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 16, 4
#: Log-likelihood that a switch of language costs, and the weight of an n-gram (they overlap).
SWITCH, WEIGHT = 12.0, 0.5
#: Bytes of text that are labelled at a time; bounds a worker's memory.
PART = 3 << 19
#: Share of a language's letters in a script from which the script is one of the language's.
OWN_SCRIPT = 0.02
UNDETERMINED = "und"

#: Scripts by ranges of code points (fixed values, from the Unicode block list): first, last, script.
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x0250, 0x02AF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)
NAMES = (*dict.fromkeys(x[2] for x in SCRIPTS), "other")


def _script_table() -> np.ndarray:
    table = np.full(0x10000, NAMES.index("other"), np.int8)
    for low, high, name in SCRIPTS:
        table[low : high + 1] = NAMES.index(name)
    return table


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Words:
    """n-grams, letters and scripts of many words at once."""

    def __init__(self):
        self.letter, self.script = _letter_table(), _script_table()

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each n-gram, word of each n-gram, letters of each word, script of each word)."""
        code = np.frombuffer((" " + " ".join(w.casefold() for w in words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
        space = code == 32
        word = np.cumsum(space) - 1
        letter = self.letter[code]
        letters = np.bincount(word[letter], minlength=len(words))[: len(words)]
        script = np.full(len(words), NAMES.index("other"), np.int64)
        at = np.flatnonzero(letter)[::-1]  # the first letter decides
        script[word[at]] = self.script[np.minimum(code[at], 0xFFFF)]
        parts, of = [], []
        hashed = np.zeros(len(code), np.uint64)
        for n in range(1, LONGEST + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            hashed = (hashed[:m] * np.uint64(0x100000001B3)) ^ code[n - 1 :].astype(np.uint64)
            # an n-gram may start or end with the space at a word's edge, but not hold one inside
            inner = np.zeros(m, bool)
            for k in range(1, n - 1):
                inner |= space[k : k + m]
            good = ~inner & ~(space[:m] & space[n - 1 :][:m]) if n > 1 else ~space[:m]
            bucket = (hashed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(48)
            parts.append(bucket[good].astype(np.int64))
            of.append(word[:m][good])
        return np.concatenate(parts), np.concatenate(of), letters, script


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    split = pc.utf8_split_whitespace(pc.fill_null(text, ""))
    words, doc = split.flatten(), pc.list_parent_indices(split)
    kept = pc.not_equal(words, "")
    return words.filter(kept).dictionary_encode(), doc.filter(kept).to_numpy().astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams and letters by script of each language in a task's part of the sample."""
    parse, grams, scripts = Words(), {}, {}
    for batch in slices(batches, PART):
        coded, doc = _split(batch.column("text"))
        words = coded.dictionary.to_pylist()
        if not words:
            continue
        bucket, of, letters, script = parse(words)
        index = coded.indices.to_numpy(zero_copy_only=False)
        langs = np.array(batch.column("lang").to_pylist(), object)[doc]
        for lang in set(langs):
            times = np.bincount(index[langs == lang], minlength=len(words))
            times[letters == 0] = 0
            grams[lang] = grams.get(lang, 0) + np.bincount(bucket, times[of], BUCKETS)
            scripts[lang] = scripts.get(lang, 0) + np.bincount(script, times * letters, len(NAMES))
    for lang in grams:
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([grams[lang].tolist()], pa.list_(pa.float64())), pa.array([scripts[lang].tolist()], pa.list_(pa.float64()))], ["lang", "grams", "scripts"])


class Model:
    """Scores and narrows; holds a table of BUCKETS numbers for each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if not langs:
            self.table, self.allowed = np.zeros((BUCKETS, 0), np.float32), np.ones((len(NAMES), 0), bool)
            return
        known = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
        self.table = np.ascontiguousarray((known - known.mean(axis=0)).T * WEIGHT).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (share >= OWN_SCRIPT).T
        self.allowed = allowed | ~allowed.any(axis=1, keepdims=True)  # a script of no language rules none out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of each language of docs (doc_id, text, lang): those whose
    ids hash lowest.  Only sums of a fixed size come to the driver."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    rows = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # hashes are spread evenly: among the lowest 2 * sample of n are the lowest sample, so that a very
    # frequent language isn't ranked as a whole; the sizes are written first, so that Spark sees that
    # they are few and bounds the rows where they are read, before any shuffle
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    low = rows.select("doc_id", "lang").join(sizes, "lang").where(place / float(1 << 53) <= 2.0 * sample / F.col("n")).select("doc_id", "lang")
    chosen = low.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang").distinct()
    # written first, so that Spark sees how few they are; then a handful of tasks count the sample alone
    taken = rows.join(cut(chosen, "sample"), ["doc_id", "lang"], "left_semi").select("lang", "text").repartition(8).mapInArrow(_count, "lang string, grams array<double>, scripts array<double>")
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for row in taken.toLocalIterator():  # a task's sums at a time
        grams[row["lang"]] = grams.get(row["lang"], 0) + np.array(row["grams"])
        scripts[row["lang"]] = scripts.get(row["lang"], 0) + np.array(row["scripts"])
    langs = sorted(grams)
    return Model(langs, np.array([grams[x] for x in langs]).reshape(-1, BUCKETS), np.array([scripts[x] for x in langs]).reshape(-1, len(NAMES)))


def viterbi(scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best label of each word; words are in order and doc says whose each one is.  All documents
    go ahead together, word by word."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    sizes = np.diff(np.append(starts, len(doc)))
    label = scores.argmax(axis=1)
    # where all words agree that is the best path
    plain = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts) if len(starts) else np.zeros(0, bool)
    starts, sizes = starts[~plain], sizes[~plain]
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    if not len(starts):
        return label
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # documents with more than t words
    values = scores[starts].astype(np.float64)
    own = np.arange(scores.shape[1], dtype=np.min_scalar_type(scores.shape[1]))
    back = np.zeros(scores.shape, own.dtype)
    end = np.empty(len(starts), np.int64)
    for t in range(1, len(alive)):
        n, before = alive[t], alive[t - 1]
        if n < before:
            end[n:before] = values[n:before].argmax(axis=1)
            values = values[:n]
        best = values.argmax(axis=1)
        switched = values[np.arange(n), best] - SWITCH
        stay = values >= switched[:, None]
        back[starts[:n] + t] = np.where(stay, own, best[:, None])
        values = np.where(stay, values, switched[:, None]) + scores[starts[:n] + t]
    end[: len(values)] = values.argmax(axis=1)
    now = np.zeros(0, np.int64)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        if n > len(now):
            now = np.concatenate([now, end[len(now) : n]])
        label[starts[:n] + t] = now
        if t:
            now = back[starts[:n] + t, now].astype(np.int64)
    return label


def _label(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Words()
        size = len(model.langs)
        for batch in slices(batches, PART):
            coded, doc = _split(batch.column("text"))
            n, words = batch.num_rows, coded.dictionary.to_pylist()
            best, share = np.full(n, -1), np.zeros(n)
            spans = [[] for _ in range(n)]
            if words and size:
                bucket, of, letters, script = parse(words)
                each = np.zeros((len(words), size), np.float64)
                for k in range(size):
                    each[:, k] = np.bincount(of, model.table[bucket, k], len(words))
                each = np.where(model.allowed[script], each, -1e3)
                index = coded.indices.to_numpy(zero_copy_only=False)
                place = np.arange(len(index)) - np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])[doc]
                some = letters[index] > 0
                index, doc, place = index[some], doc[some], place[some]
                if len(index):
                    label = viterbi(each[index], doc)
                    weight = np.zeros((n, size))
                    np.add.at(weight, (doc, label), letters[index])
                    lettered = weight.sum(axis=1) > 0
                    best[lettered] = weight[lettered].argmax(axis=1)
                    share[lettered] = weight[lettered].max(axis=1) / weight[lettered].sum(axis=1)
                    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                    last = np.append(new[1:], len(doc)) - 1
                    for d, a, b, k in zip(doc[new], place[new], place[last], label[new], strict=True):
                        spans[d].append({"first": int(a), "last": int(b), "lang": model.langs[k]})
            found = [model.langs[k] if k >= 0 else UNDETERMINED for k in best]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(found), pa.array(share, pa.float64()), pa.array(spans, kind)], [*batch.schema.names, "lang_pred", "score", "lang_spans"])

    return run


_ADDED = "lang_pred string, score double, lang_spans array<struct<first: bigint, last: bigint, lang: string>>"


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, text, lang_pred, score, lang_spans), one for each row of docs (text, ...).

    lang_pred: the language of most letters, ``und`` for a null text or one without letters (or with a
    model of no language); score: its share of the letters; lang_spans: words first to last, counted
    from 0, of each language in turn (words without letters belong to the span around them or to none).
    A word of a script that no language was learned with is scored for all of them.  Repeated rows are
    labelled alike.  Only text is looked at, and only keep's columns come along.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_label(model), StructType([*rows.schema.fields, *StructType.fromDDL(_ADDED).fields]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is of the fold that isn't learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """identify() with a model of the documents that aren't held out."""
    return identify(docs, train(docs.where(~held_out()), sample), keep)
