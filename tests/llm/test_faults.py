"""Cases that went wrong once, and small brute-force checks of single steps."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import language, neighbours, repeats, simhash
from loglathe.llm.token_counts import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_of_odd_characters(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(5)
    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace() or i in (0x180E, 0x200B, 0xFEFF)]
    pools = [spaces, [chr(i) for i in range(0x300, 0x370)], list("İΣßﬁÅ한日ǅ"), list("abcXYZ09.,!?-é"), ["<|endoftext|>", "'s", "'ll", ".,"], [" ", "\n", "\t"]]
    texts = [" a b", "İ,", "GELDİ. x", "hİ., b", *(x + "a b" for x in spaces)]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(30))) for _ in range(800)]
    got = {r.doc_id: r.n_tokens for r in token_counts(docs(enumerate(texts)), path).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_nearest_goes_by_id_among_positive_multiples(spark):
    rows = [(i, [float(i + 1) * x for x in (1.0, 2.0, 3.0)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(vectors, vectors.where("vec_id in (0, 50, 399)")).orderBy("query_id", "rank").collect()
    near = {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 50, 399)}
    assert near == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 399: [0, 1, 2, 3, 4]}
    assert [r["rank"] for r in got[:5]] == [1, 2, 3, 4, 5] and all(abs(r.score - 1) < 1e-12 for r in got)


def test_repeats_of_texts_that_share_a_doc_id(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(str(rng.randrange(1 << 30)) for _ in range(n))
    shared = words(30)
    rows = [(1, shared + words(3)), (1, words(40)), (5, words(2) + shared), (5, words(500)), (7, "short"), (7, shared), (7, shared), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept) for r in repeats.without_repeats(docs).collect()}
    import hashlib

    order = sorted(set(rows), key=lambda r: (r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = repeats.brute_force({i: (t or "").encode() for i, (_, t) in enumerate(order)})
    for i, (doc, text) in enumerate(order):
        removed, kept = got[doc, len((text or "").encode())]
        assert (removed, hashlib.sha256(bytes(kept)).hexdigest()) == (want[i][0], want[i][2])


def test_triggers_compare_whole_hashes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) & ~np.uint64(0) ^ rng.integers(0, 3, 300, dtype=np.uint64)
        x[rng.integers(0, 300, 40)] = x[7] ^ np.uint64(1)
        got = repeats.triggers(x, 20)
        assert got.tolist() == [i + int(np.argmin(x[i : i + 20])) for i in range(281)]


@pytest.mark.parametrize("labels", [3, 140])
def test_viterbi_against_all_paths(labels):
    rng = np.random.default_rng(labels)
    for _ in range(20):
        n = 5 if labels == 3 else 2
        scores = rng.normal(0, 12, (n, labels))
        paths = list(itertools.product(range(labels), repeat=n))
        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - language.SWITCH * sum(a != b for a, b in itertools.pairwise(p))
        got = tuple(language.viterbi(scores, np.zeros(n, np.int64)).tolist())
        assert abs(value(got) - max(map(value, paths))) < 1e-9


def test_fingerprint_bit_by_bit():
    import xxhash

    for text in ("", "one", "a b", "The quick Brown fox\tjumps over over over the lazy dog", "x " * 70):
        words = text.lower().encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == want


def test_language_without_labels(docs):
    found = language.identified(docs([(1, "some words"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in found} == {(1, "und", 0.0), (2, "und", 0.0)}


@pytest.mark.parametrize("kind", ["double", "float"])
def test_nearest_of_vectors_of_any_size(spark, kind):
    """Sizes from 1e-200 to 1e200 (as doubles): scores are those of the rows' own vectors, worked out exactly."""
    from fractions import Fraction
    from math import sqrt

    rng, sizes = random.Random(9), (1e200, 1e-170, 1e-200, 1.0, 3e-310, 1e308) if kind == "double" else (1e30, 1e-38, 1.0, 7.0)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, [float(np.float32(v * (sizes[i % len(sizes)] / 10))) if kind == "float" else v * (sizes[i % len(sizes)] / 10) for v in base[i % 40]]) for i in range(120)]
    rows += [(500, [0.0] * 4), (501, [1.0, float("nan"), 0.0, 0.0]), (502, [float("inf"), 0.0, 0.0, 0.0]), (503, None), (504, [1.0, 2.0]), (505, [1e-5, 2e-5])]
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0 or vec_id = 505")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)

    def cosine(a, b):
        dot = lambda x, y: sum(Fraction(v) * Fraction(w) for v, w in zip(x, y, strict=True))
        square = dot(a, b) ** 2 / (dot(a, a) * dot(b, b))
        return sqrt(square) * (1 if dot(a, b) >= 0 else -1)

    own = {i: v for i, v in rows[:120] if any(v)}
    assert set(got) == {0, 50, 100, 505} and got[505] == {1: (504, pytest.approx(1.0, abs=1e-15))}
    for q in (0, 50, 100):
        want = sorted((-cosine(own[q], v), i) for i, v in own.items() if i != q)
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for rank, (i, score) in got[q].items():
            assert score == pytest.approx(cosine(own[q], own[i]), abs=1e-14)
            assert score == pytest.approx(-want[rank - 1][0], abs=1e-14)
