"""Chat formatting as prefix trees: conversations that share their first turns share the tokens.

Conversations are sorted by their turns, so that each one follows those it shares most turns with:
that is the depth-first order of their prefix tree.  Runs of this order are packs, a pack being what
one attention window sees.  Within a pack each shared turn is emitted once; every conversation adds a
segment with the turns that the one before it hasn't, and the segment's place in the tree: the
position id that it starts with and the intervals of the pack that are its ancestors, to which its
tokens attend besides those before them in the segment.

The token here is the code point; a tokenizer that keeps turns apart can take the formatted turns
instead.  Template: ``### Role: text </turn>``.  Within roles and texts a backslash stands before each
``\\``, ``#``, ``<`` and ``:``, and so no control string can come from them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Code points of a pack at which the next conversation starts a new one; a longer conversation is a
#: pack by itself.
PACK = 1 << 16
#: The role whose texts are learned.
LEARNED = "assistant"

_ESCAPED = re.compile(r"([\\#<:])")
_BARE = re.compile(r"\\([\\#<:])")
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.DOTALL)

_SEGMENT = "struct<conv_id: bigint, start: bigint, length: bigint, position: bigint, ancestors: array<struct<first: bigint, last: bigint>>>"
_PACKS = f"tokens string, learned array<struct<first: bigint, last: bigint>>, segments array<{_SEGMENT}>"


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _BARE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the formatted turn, where its text starts and ends)."""
    head, body = f"### {escape(role)}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of a formatted conversation's turns."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class _Pack:
    def __init__(self):
        self.parts, self.size, self.learned, self.segments, self.path = [], 0, [], [], []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        """path: of the last conversation its turns, each with its interval."""
        shared = 0
        while shared < min(len(turns), len(self.path)) and turns[shared] == self.path[shared][0]:
            shared += 1
        del self.path[shared:]
        ancestors: list[list[int]] = []
        for _, first, last in self.path:
            if ancestors and ancestors[-1][1] == first:
                ancestors[-1][1] = last
            else:
                ancestors.append([first, last])
        start, position = self.size, sum(b - a for a, b in ancestors)
        for turn in turns[shared:]:
            text, first, last = format_turn(*turn)
            if turn[0] == LEARNED:
                self.learned.append({"first": self.size + first, "last": self.size + last})
            self.path.append((turn, self.size, self.size + len(text)))
            self.parts.append(text)
            self.size += len(text)
        self.segments.append({"conv_id": conv_id, "start": start, "length": self.size - start, "position": position, "ancestors": [{"first": a, "last": b} for a, b in ancestors]})

    def row(self) -> dict:
        return {"tokens": "".join(self.parts), "learned": self.learned, "segments": self.segments}


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                if pack.segments and pack.size >= limit:
                    yield pa.RecordBatch.from_pylist([pack.row()], schema=_arrow())
                    pack = _Pack()
                pack.add(conv_id, [(x["role"], x["text"]) for x in turns])
        if pack.segments:
            yield pa.RecordBatch.from_pylist([pack.row()], schema=_arrow())

    return run


def _arrow() -> pa.Schema:
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    segment = pa.struct([("conv_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("ancestors", span)])
    return pa.schema([("tokens", pa.string()), ("learned", span), ("segments", pa.list_(segment))])


def pack(conversations: DataFrame, limit: int = PACK) -> DataFrame:
    """Rows (tokens, learned, segments), one for each pack, of conversations (conv_id, turn, role, text, ...).

    tokens: the pack's text; learned: the intervals of it under the loss mask, which are the texts of
    the assistant's turns; segments: of each conversation of the pack (conv_id, start, length,
    position, ancestors), ancestors being intervals (first, last) of tokens, in order, last excluded.

    Turns of a conversation are ordered by turn, then role and text; null turns come first, repeated
    rows are turns of their own, null roles and texts are empty; rows without a conv_id are one
    conversation; empty tables give no packs.  Other columns are not read.  A conversation is held by
    one task, a shared start of any number of conversations by as many as it takes.
    """
    spark = conversations.sparkSession
    prepare(spark)
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), clean("role").alias("role"), clean("text").alias("text")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    whole = whole.select("conv_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # equal turns have equal hashes, so hashes put a tree's branches together as the turns would; the
    # id parts conversations that are wholly equal
    whole = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInArrow(_packed(limit), _PACKS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = {x: [] for x in names}
        for row in batch.to_pylist():
            tokens = row["tokens"]
            learned = [(x["first"], x["last"]) for x in row["learned"]]
            at = 0
            firsts = [x for x, _ in learned]
            for segment in row["segments"]:
                spans = [(x["first"], x["last"]) for x in segment["ancestors"]] + [(segment["start"], segment["start"] + segment["length"])]
                formatted = "".join(tokens[a:b] for a, b in spans)
                turns = parse(formatted)
                loss = []
                for a, b in spans:
                    at = _first(firsts, a)
                    while at < len(learned) and learned[at][0] < b:
                        loss.append(unescape(tokens[learned[at][0] : learned[at][1]]))
                        at += 1
                joined = "".join(loss)
                values = (segment["conv_id"], len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(joined), _sha(joined), len(formatted))
                for name, value in zip(names, values, strict=True):
                    out[name].append(value)
        if out["conv_id"]:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[x], k) for x, k in zip(names, kinds, strict=True)], names)


def _first(values: list[int], least: int) -> int:
    import bisect

    return bisect.bisect_left(values, least)


def read_back(packs: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), one for each
    conversation of packs, from the packs alone: its ancestors' and its segment's tokens, parsed."""
    return packs.mapInArrow(_read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
