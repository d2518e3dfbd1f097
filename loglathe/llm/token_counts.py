"""Token counts: pieces are counted once per distinct pre-token, then joined to per-document
pre-token frequencies and summed; no token id is ever kept.

White space parts a text into words, words into the vocabulary's pre-tokens.  Where a vocabulary's
pre-tokens hold white space themselves (byte-level ones whose words start with it) whole texts are
parted instead, and where a library has no pre-tokens whole texts are what is counted once each.  Words that hold one of the vocabulary's special strings stay whole, so that the
library handles these as it does by default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, slices

_BLOCK = "ids array<bigint>, sizes array<bigint>, matrix binary, words array<string>"
#: Bytes of text of a block: what a task parts at a time, which bounds its memory.
BLOCK = 8 << 20
#: Words that are parted, and pairs of document and word that are spread over pre-tokens, at a time: both
#: only bound the memory on the way to a block.
WORDS, PAIRS = 1 << 13, 1 << 17
#: Characters that a vocabulary may take for white space besides the ASCII ones that part words (fixed
#: values: the White_Space property, separators and zero-width spaces).
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Stands before a word that is left to the library as it is; no pre-token starts with it.
RAW = " "


class Vocabulary:
    """Parts words into pre-tokens and counts the pieces of pre-tokens, as the vocabulary's library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.spaced, self.stops, self.model, self.special = False, False, None, []
        if path.endswith(".model"):
            import sentencepiece

            whole = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda words: [len(x) for x in whole.encode(words, num_threads=1)]
            self.spaced = True  # runs of spaces can be pieces
            return
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.library = whole  # keeps the parts below alive
        self.whole = lambda words: [len(x) for x in whole.encode_batch_fast(words, add_special_tokens=False)]
        self.special = [x.content for x in whole.get_added_tokens_decoder().values()]
        if whole.pre_tokenizer is not None:
            self.model = whole.model
            self.normalize = whole.normalizer.normalize_str if whole.normalizer is not None else lambda x: x
            self.part = whole.pre_tokenizer.pre_tokenize_str
            # special strings with white space in them would be lost with the words
            self.spaced = any(not x.isalpha() or len(x) > 1 for x, _ in self.part(self.normalize("a b  c"))) or any(len(x.split()) != 1 for x in self.special)
            # stops after an ASCII letter at a word's end are pre-tokens of their own: such words can be parted before they are told apart
            self.stops = not self.spaced and [x for x, _ in self.part(self.normalize("ab., ab"))] == ["ab", ".,", "ab"] and not any(c in x for x in self.special for c in ".,")

    def pre_tokens(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of words, and the index of the word that each is of."""
        if self.model is None:
            return [RAW + x for x in words], np.arange(len(words))
        # words with special strings, or with white space beyond ASCII that the vocabulary may part them at, go to the library whole
        every = "\n".join(words)
        odd: list[int] = []
        if any(x in every for x in self.special):
            odd = [i for i, w in enumerate(words) if any(x in w for x in self.special)]
        if not self.spaced and _ODD.search(every):
            odd = sorted({*odd, *(i for i, w in enumerate(words) if _ODD.search(w))})
        if len(odd) == len(words):
            return [RAW + x for x in words], np.arange(len(words))
        plain = np.delete(np.arange(len(words)), odd)
        text = None if self.spaced else self.normalize(" ".join(words[i] for i in plain))
        if text is None or text.count(" ") != len(plain) - 1:
            found = [[x for x, _ in self.part(self.normalize(words[i]))] for i in plain]
            of = np.repeat(plain, [len(x) for x in found])
            parts = [x for y in found for x in y]
        else:
            found = self.part(text)
            parts = [x for x, _ in found]
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            of = plain[np.searchsorted(spaces, np.fromiter((at for _, (at, _) in found), np.int64))]
        return parts + [RAW + words[i] for i in odd], np.concatenate([of, np.asarray(odd, np.int64)])

    def coded(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pre-tokens of words as in pre_tokens(), some words at a time."""
        parts, of = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORDS):
            found, word = self.pre_tokens(words.slice(at, WORDS).to_pylist())
            parts.append(pa.array(found, pa.string()))
            of.append(word + at)
        return pa.concat_arrays(parts).dictionary_encode(), np.concatenate(of)

    def pieces(self, parts: list[str]) -> np.ndarray:
        out = np.zeros(len(parts), np.int64)
        raw = [i for i, x in enumerate(parts) if x.startswith(RAW)]
        out[raw] = self.whole([parts[i][1:] for i in raw]) if raw else []
        for i in sorted(set(range(len(parts))) - set(raw)):
            out[i] = len(self.model.tokenize(parts[i]))
        return out


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once by each worker."""
    return Vocabulary(path)


def _pack(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse matrix, by row and code: codes as differences, numbers as planes of bytes, compressed."""
    steps = np.diff(codes, prepend=0)
    fresh = np.flatnonzero(np.diff(rows, prepend=-1))
    steps[fresh] = codes[fresh]
    planes = b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (np.diff(rows, prepend=0), steps, counts))
    return len(rows).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 12 * n, "zstd", asbytes=True), np.uint8).reshape(3, 4, n)
    steps, gaps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in planes)
    rows, total = np.cumsum(steps), np.cumsum(gaps)
    fresh = np.flatnonzero(np.diff(rows, prepend=-1))
    base = total[fresh] - gaps[fresh]
    return rows, total - np.repeat(base, np.diff(np.append(fresh, n))), counts


def _spread(pairs: np.ndarray, counts: np.ndarray, of: np.ndarray, place: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The matrix of documents x words times that of words x pre-tokens, both sparse, by runs of whole
    documents: arrays of document, pre-token, count.

    pairs: document * width + word, sorted, with their counts; of: the word of each pre-token;
    place: the code of each pre-token.
    """
    by = np.argsort(of, kind="stable")
    each = np.bincount(of, minlength=width)
    start = np.cumsum(each) - each
    wide = int(place.max(initial=0)) + 1
    document = pairs // width
    ends = np.append(np.flatnonzero(np.diff(document)) + 1, len(pairs))
    a = 0
    while a < len(pairs):
        b = int(ends[min(np.searchsorted(ends, a + PAIRS), len(ends) - 1)])
        word = pairs[a:b] % width
        much = each[word]
        at = np.repeat(start[word] - (np.cumsum(much) - much), much) + np.arange(much.sum())
        keys, group = np.unique(np.repeat(document[a:b], much) * wide + place[by[at]], return_inverse=True)
        yield keys // wide, keys % wide, np.bincount(group, np.repeat(counts[a:b], much), len(keys)).astype(np.int64)
        a = b


def _blocks(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in slices(batches, BLOCK):
            text = pc.fill_null(batch.column("text"), "")
            if vocabulary.spaced:
                words, doc = text, np.arange(len(text))
            else:
                split = pc.ascii_split_whitespace(pc.replace_substring_regex(text, r"([A-Za-z])([.,]+)(\s|$)", r"\1 \2\3") if vocabulary.stops else text)
                words, doc = split.flatten(), pc.list_parent_indices(split)
                kept = pc.not_equal(words, "")
                words, doc = words.filter(kept), doc.filter(kept).to_numpy().astype(np.int64)
                del split, kept
            coded = words.dictionary_encode()
            width = max(1, len(coded.dictionary))
            pairs, counts = np.unique(doc * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            distinct = coded.dictionary
            del words, doc, coded
            part, of = vocabulary.coded(distinct)
            rank = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(-np.bincount(rank, minlength=len(part.dictionary)), kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            cells = [(np.zeros(0, np.int64),) * 3, *_spread(pairs, counts, of, place[rank], width)]
            matrix = _pack(*(np.concatenate(x) for x in zip(*cells, strict=True)))
            names = part.dictionary.take(pa.array(order))
            ids = batch.column("doc_id")
            sizes = pc.binary_length(text).cast(pa.int64())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            del distinct, pairs, counts, of, rank, cells
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([one(ids), one(sizes), pa.array([matrix], pa.binary()), one(names)], ["ids", "sizes", "matrix", "words"])

    return run


def _counted(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        last: tuple = (None, 0)  # words come in order: only the last of a batch can go on in the next
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            if not words:
                continue
            pieces = np.concatenate([[last[1]], vocabulary.pieces(words[1:])]) if words[0] == last[0] else vocabulary.pieces(words)
            last = (words[-1], pieces[-1])
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("code"), pa.array(pieces[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int32))], ["block", "code", "pieces"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids, known = batch.column("ids")[r].values, batch.column("known")[r].values
            rows, codes, counts = _unpack(batch.column("matrix")[r].as_py())
            per = np.full(codes.max(initial=-1) + 1, -1, np.int64)
            if known is not None:
                per = np.full(max(len(per), known.field("code").to_numpy().max(initial=-1) + 1), -1, np.int64)
                per[known.field("code").to_numpy()] = known.field("pieces").to_numpy()
            if (per < 0).any():
                raise ValueError("a pre-token of a block has no count")
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, rows, per[codes] * counts)
            yield pa.RecordBatch.from_arrays([ids, batch.column("sizes")[r].values, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs (doc_id, text, ...).

    vocabulary: the path, on every executor, of a .json (tokenizers) or .model (sentencepiece) file.
    Begin and end tokens are not added, nothing is truncated.  Null texts and empty ones have no bytes
    and no tokens; repeated rows have a row each; a null doc_id stays null; columns other than doc_id
    and text are not read.

    Pre-tokens are coded per block of documents (at most BLOCK bytes or one document), so a very
    frequent one has a row per block and none per document.  Blocks are written to the shared folder
    once.  Only (block, code, pre-token) goes out to be counted, where equal pre-tokens meet in order;
    the order is dealt out by ranges of (pre-token, block), so that the most frequent one takes several
    tasks, each of which counts it once.  Only (block, code, pieces) comes back to the blocks.
    """
    prepare(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks(vocabulary), _BLOCK)
    blocks = cut(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("code", "word")).repartitionByRange("word", "block").sortWithinPartitions("word")
    pieces = words.mapInArrow(_counted(vocabulary), "block bigint, code int, pieces int")
    known = pieces.groupBy("block").agg(F.collect_list(F.struct("code", "pieces")).alias("known"))
    joined = blocks.drop("words").join(known, "block", "left").select("ids", "sizes", "matrix", "known")
    counted = joined.mapInArrow(_summed, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
