"""Spelling variants: words that differ by exactly one inserted, deleted or replaced code point, and the
most frequent of them as a word's form.

Near words come from a positional q-gram index with a count filter.  An edit leaves at least one half of
the shorter word whole, at the start or at the end of both words: the index is sharded by that half (its
side, the shorter length, its letters), so that a word goes to four shards whatever the vocabulary's
size.  Within a shard the q-grams that reach into the rest of the words are posted by (length, place,
gram), places counted from the shared side.  A word's postings are merged by a heap under the limits of
one edit: words of its own length have a gram at the same place, words longer by one at the same or the
next.  An edit destroys at most Q grams of the longer word: words that meet in fewer of the others are
dropped, and what is left is verified letter by letter.

A shard with more than SHARD words is cut: each part of its index meets each part of its words in a task
of its own, so no task holds more than SHARD words.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, discard, parts, prepare

#: Code points of a word at least, its occurrences at least, and how many times more its form has.
LEAST, OFTEN, TIMES = 7, 2, 10
#: Code points of a gram.
Q = 2
#: A run whose checksum this divides loses a code point.
NOISE = 31
#: Words that a task indexes at a time.
SHARD = 1 << 13
#: Bytes of a text that are read at a time, and distinct words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 1 << 17
_RUN = re.compile("[a-zÀ-ÿ]+")


def noisy(doc_id: int | None, run: str) -> str:
    """The run, without one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % NOISE == 0 else run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def told():
        words, counts = list(found), list(found.values())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            own: Counter[str] = Counter()
            for part in parts(text.as_py() or b"", PIECE):
                own.update(_RUN.findall(part.lower().decode("utf-8", "replace")))
            for run, n in own.items():
                if len(run) >= LEAST and len(word := noisy(doc, run)) >= LEAST:
                    found[word] += n
            if len(found) > HELD:
                yield told()
    if found:
        yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Rows (word, n): the words of docs (doc_id, text, ...) that occur OFTEN times at least."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def is_near(short: str, long: str) -> bool:
    """Whether one replaced code point, or one inserted into the first word, makes the second."""
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short != long and short[i + (len(short) == len(long)) :] == long[i + 1 :]


#: What a word does in a shard: it is indexed for shorter words; it probes what has come before it and is
#: indexed then, so that two words of a length meet once; in a shard that is cut, it is indexed, or it probes.
LONGER, BOTH, INDEXED, PROBES = range(4)


class Shard:
    """The positional grams of words that share letters at a side, of one length and of those longer by one."""

    def __init__(self, short: int, shared: int, from_end: bool):
        self.short, self.from_end, self.first = short, from_end, max(0, shared - Q + 1)
        self.words: list[tuple[str, int]] = []
        self.same: dict[tuple[int, str], list[int]] = {}
        self.longer: dict[tuple[int, str], list[int]] = {}

    def grams(self, word: str) -> list[tuple[int, str]]:
        """(place, gram) of the grams that reach beyond the shared letters, places from the shared side."""
        if self.from_end:
            word = word[::-1]
        return [(i, word[i : i + Q]) for i in range(self.first, len(word) - Q + 1)]

    def add(self, word: str, n: int) -> None:
        postings = self.same if len(word) == self.short else self.longer
        for x in self.grams(word):
            postings.setdefault(x, []).append(len(self.words))
        self.words.append((word, n))

    def near(self, word: str) -> Iterator[int]:
        """Places of words that meet a word of the shorter length in enough grams: all that one edit parts from
        it are among them.  Postings are merged by a heap: a word's own number comes once for each gram met."""
        grams, least = self.grams(word), self.short - Q + 1 - self.first - Q
        if self.same:
            yield from self.met([found for x in grams if (found := self.same.get(x))], least)
        if self.longer:
            get = self.longer.get
            yield from self.met([found for i, x in grams for place in (i, i + 1) if (found := get((place, x)))], least + 1)

    def met(self, lists: list[list[int]], least: int) -> Iterator[int]:
        if len(lists) < least:
            return
        if len(lists) == 1:
            yield from lists[0]
            return
        last, count = -1, 0
        for x in heapq.merge(*lists):
            count = count + 1 if x == last else 1
            last = x
            if count == least:
                yield x


_PAIRS = "a string, an bigint, b string, bn bigint"
_ORDER = ["side", "short", "half", "cut", "deal"]


def _shard_pairs(side: str, short: int, half: str, rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Near words among the rows (role, word, n) of a shard, in the order of their roles."""
    shard, start, first = Shard(short, len(half), side == "end"), side == "start", short // 2
    for role, word, n in rows:
        if role in (BOTH, PROBES) and shard.words:
            for i in shard.near(word):
                other, m = shard.words[i]
                # a pair that shares its first half is found there
                if (start or other[:first] != word[:first]) and is_near(word, other):
                    if len(other) > short or word < other:
                        yield word, n, other, m
                    elif role == BOTH:
                        yield other, m, word, n
        if role != PROBES:
            shard.add(word, n)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows in the order of (side, short, half, cut, deal, role)."""

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["a", "an", "b", "bn"])

    key, held = None, []
    for batch in batches:
        found = []
        keys = list(zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True))
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("role", "word", "n")), strict=True))
        for at, row in zip(keys, rows, strict=True):
            if at != key:
                if len(held) > 1:
                    found += _shard_pairs(*key[:3], held)
                key, held = at, []
            held.append(row)
        if found:
            yield told(found)
    if len(held) > 1 and (found := list(_shard_pairs(*key[:3], held))):
        yield told(found)


def near_words(words: DataFrame) -> DataFrame:
    """Rows (a, an, b, bn), each pair of words (word, n) that one edit parts once: a is the shorter, or
    else the smaller word; an and bn are their n."""
    spark = words.sparkSession
    length = F.length("word")
    shards = []
    for probing, short in ((True, length), (False, length - 1)):
        start, end = F.floor(short / 2).cast("int"), short - F.floor(short / 2).cast("int")
        shards.append(F.struct(F.lit("start").alias("side"), short.alias("short"), F.substring("word", F.lit(1), start).alias("half"), F.lit(probing).alias("probes")))
        shards.append(F.struct(F.lit("end").alias("side"), short.alias("short"), F.substring("word", length - end + 1, end).alias("half"), F.lit(probing).alias("probes")))
    key = ["side", "short", "half"]
    keyed = words.select("word", "n", F.explode(F.filter(F.array(*shards), lambda x: x["short"] >= LEAST)).alias("x")).select("x.*", "word", "n")
    large = bounded(cut(keyed.groupBy(key).agg(F.ceil(F.count("*") / SHARD).alias("cuts")).where("cuts > 1"), "large"))
    keyed = keyed.join(large, key, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
    own = F.array(F.pmod(F.xxhash64("word"), "cuts"))
    one = F.array(F.lit(0).cast("long"))
    as_role = lambda role, cuts, deals: F.struct(F.lit(role).alias("role"), cuts.alias("cuts"), deals.alias("deals"))
    whole = F.array(F.when(F.col("probes"), as_role(BOTH, one, one)).otherwise(as_role(LONGER, one, one)))
    parted = F.when(F.col("probes"), F.array(as_role(INDEXED, own, every), as_role(PROBES, every, own))).otherwise(F.array(as_role(INDEXED, own, every)))
    dealt = keyed.select(*key, "word", "n", F.explode(F.when(F.col("cuts") == 1, whole).otherwise(parted)).alias("x"))
    dealt = dealt.select(*key, F.explode("x.cuts").alias("cut"), "x.deals", "x.role", "word", "n").withColumn("deal", F.explode("deals"))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = dealt.select(*_ORDER, "role", "word", "n").repartition(count, *_ORDER).sortWithinPartitions(*_ORDER, "role")
    return ordered.mapInArrow(_paired, _PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form), by pointer jumping: a word's form occurs ten times as often,
    so chains are short and end."""
    known = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        following = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(known.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(known)
        known = after
        if after.where("moved").isEmpty():
            return after.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of docs (doc_id, text, ...).

    A run of ASCII letters and U+00C0 to U+00FF, with A-Z lower-cased, loses a code point where its
    document's checksum says so (noisy()); words are the distinct results of at least LEAST code points
    and OFTEN occurrences, n.  Near words differ by one edit; form: the near word of largest n, ties by
    code points, if it has TIMES times the word's n or more, else null; root: the last form of the chain,
    the word itself if it has none.

    Null texts have no words; a null document id counts as an empty string in the checksum; repeated
    rows count each; no documents give no rows.  Columns other than doc_id and text are not read.
    """
    words = cut(vocabulary(docs), "vocabulary")
    pairs = cut(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    enough = -F.col("best.down") >= TIMES * F.col("own")
    best = cut(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.down")).alias("form_n")), "best")
    roots = _roots(best.where("form is not null"))
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def brute_force(texts: dict[int, str | None]) -> dict[str, tuple]:
    """{word: (form, root, n, n_near, form_n)} of a small corpus, by all pairs."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    runs = ((i, r) for i, t in texts.items() for r in _RUN.findall((t or "").translate(lower)))
    n = {w: c for w, c in Counter(noisy(i, r) for i, r in runs).items() if len(w) >= LEAST and c >= OFTEN}
    edit = lambda a, b: is_near(*sorted((a, b), key=len)) if abs(len(a) - len(b)) < 2 else False
    near = {w: [x for x in n if edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= TIMES * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), form[w] and n[form[w]])
    return out
