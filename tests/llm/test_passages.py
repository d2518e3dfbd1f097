"""Passages of words that recur in later documents, against brute force."""

import random

import pytest

from loglathe.llm import passages


def corpus(rng):
    """Texts that share passages, with edges at every distance, copies, near-copies and repeats of their own."""
    word = lambda: f"w{rng.randrange(300)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(rng.randrange(45, 160)) for _ in range(5)]
    out = {}
    for i in range(60):
        words = text(rng.randrange(80))
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            words += p[a : a + rng.randrange(40, 160)] + text(rng.choice([0, 1, 30]))
        if rng.random() < 0.2 and words:
            words[rng.randrange(len(words))] = "changed"
        out[i * 3] = rng.choice([" ", "\n", " \t"]).join(words)
    out |= {200: out[3], 201: out[3] + " x", 202: "same " * 400, 203: "same " * 300, 204: "", 205: None, 206: "é " * 70, 207: "É " * 70}
    own = " ".join(text(70))
    return out | {300: f"{own} {own}", 301: own, 302: " ".join(text(49)), 303: "a\x1cb " * 60, 304: "a\x1cb\x0b" * 55}


@pytest.mark.parametrize("small", [False, True])
def test_passages(docs, monkeypatch, small):
    if small:  # many shards, automata and deals; documents in pieces
        for name, value in (("PASSAGES", 4), ("PHRASES", 3), ("PIECE", 300)):
            monkeypatch.setattr(passages, name, value)
    texts = corpus(random.Random(7 + small))
    want = passages.brute_force(texts)
    assert sum(x[1] for x in want.values()) > 1000
    rows = [*texts.items(), (None, texts[3]), (200, texts[200])]
    found = passages.without_passages(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = want[r.doc_id] if r.doc_id is not None else (want[3][0], 0, " ".join(texts[3].split()))
        assert (r.n_words, r.n_removed, bytes(r.kept).decode()) == expected, r.doc_id


def test_passages_of_one_frequent_anchor(docs):
    """Many documents share 30 words, and pairs of them more on either side."""
    rng = random.Random(3)
    core = [f"c{i}" for i in range(30)]
    sides = [[f"s{rng.randrange(10**6)}" for _ in range(22)] for _ in range(12)]
    texts = {i: " ".join([f"u{i}", *rng.choice(sides), *core, *rng.choice(sides), f"v{i}"]) for i in range(120)}
    want = passages.brute_force(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in passages.without_passages(docs(texts.items())).collect()}
    assert got == want and 0 < sum(x[1] for x in want.values())


def test_no_passages(docs):
    assert passages.without_passages(docs([])).count() == 0
    assert [(r.n_words, r.n_removed, bytes(r.kept)) for r in passages.without_passages(docs([(1, None), (2, "x  y")])).orderBy("doc_id").collect()] == [(0, 0, b""), (2, 0, b"x y")]


def test_passages_of_texts_that_share_a_doc_id(docs):
    rng = random.Random(5)
    shared = " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    rows = [(1, shared), (1, "other " + shared), (2, shared), (2, "short")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in passages.without_passages(docs(rows)).collect())
    assert got[2:] == [(2, 1, 0), (2, 60, 60)] and sorted(x[2] for x in got[:2]) == [0, 60]


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 40)
    words = [b"w%d" % i for i in range(500)]
    parts = list(passages.pieces(b"  ".join(words) + b"\n"))
    assert len(parts) > 10 and all(words[at : at + len(w)] == w for at, w in parts)
    windows = [at + i for at, w in parts for i in range(len(w) - passages.WINDOW + 1)]
    assert windows == list(range(len(words) - passages.WINDOW + 1))
    assert [w for _, x in passages.pieces(b" ".join(words), 0) for w in x] == words
