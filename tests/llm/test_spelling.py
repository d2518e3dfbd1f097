"""Spelling variants against all pairs."""

import random

import pytest

from loglathe.llm import spelling


def edited(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])


def corpus(rng, letters, n=60):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(n)]
    words = [w for w in base for _ in range(rng.choice([1, 3, 30, 300]))]
    for w in base:
        for _ in range(4):
            x = edited(rng, w, letters)
            words += [x] * rng.choice([1, 2, 3, 25])
            words += [edited(rng, x, letters)] * 2
    rng.shuffle(words)
    texts = {i: " ".join(words[i * 20 : i * 20 + 20]) for i in range(len(words) // 20 + 1)}
    return texts | {5000: None, 5001: "", 5002: "short ABCDEFGH abcdefgh xabcdefgh,xabcdefgh;ÀÉabcde ÀÉabcde àÉabcde İstanbulx İstanbulx"}


@pytest.mark.parametrize(("letters", "shard"), [("abcdefghijklm", None), ("abé", None), ("ab", 5), ("abcd×ÿ", 7)])
def test_variants(docs, monkeypatch, letters, shard):
    if shard:  # large shards are cut
        monkeypatch.setattr(spelling, "SHARD", shard)
        monkeypatch.setattr(spelling, "PIECE", 50)
        monkeypatch.setattr(spelling, "HELD", 20)
    texts = corpus(random.Random(len(letters)), letters, 40 if shard else 60)
    want = spelling.brute_force(texts)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs(texts.items())).collect()}
    assert got == want
    assert any(x[0] and x[1] != x[0] for x in want.values()) or len(letters) > 4


def test_candidates_hold_all_near_words():
    rng = random.Random(1)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(7, 12)))
        b = edited(rng, a, "abc")
        short, long = sorted((a, b), key=len)
        if a == b or len(short) < 7:
            continue
        assert spelling.is_near(short, long)
        half = len(short) // 2
        from_end = short[:half] != long[:half]
        shared = len(short) - half if from_end else half
        assert short[-shared:] == long[-shared:] if from_end else True
        shard = spelling.Shard(len(short), shared, from_end)
        shard.add(long, 1)
        assert list(shard.near(short)) == [0]


def test_no_variants(docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (2, "abcdefgh")])).count() == 0


def test_noise_takes_a_code_point():
    found = [r for r in range(5000) if spelling.noisy(r, "àbcdefgh") != "àbcdefgh"]
    assert 100 < len(found) < 230 and all(len(spelling.noisy(r, "àbcdefgh")) == 7 for r in found)
