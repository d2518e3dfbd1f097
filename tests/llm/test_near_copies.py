"""The pipeline's near-copies go through the index of operator 3."""

import random

import corpus_pipeline

from loglathe.llm import similar, simhash


def test_index_links_and_whole_sets_confirm(spark, docs, monkeypatch):
    rng = random.Random(10)
    words = lambda n: " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n))
    base = words(4000)
    texts = {1: base, 2: f"{base} more", 3: "spam " * 400 + words(30), 4: "spam " * 400 + words(30)}
    prints = {i: simhash.fingerprint(t.encode(), similar.WIDTH) for i, t in texts.items()}
    assert 0 < (prints[1] ^ prints[2]).bit_count() <= simhash.DISTANCE and prints[3] == prints[4]
    monkeypatch.setattr(similar, "_rest", lambda postings, indexed, *_: indexed.where("false"))  # the index alone
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs(texts.items()), "").collect()) == [1, 3, 4]


def test_pairs_of_a_large_group_grow_with_its_sets(spark, docs, monkeypatch):
    n, width = 300, 180  # windows of a ring of words: each is similar to those up to 19 places away
    ring = [f"w{i}" for i in range(n)] * 2
    made, cut = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df, name: (made.append(cut(df, name).count()) if name == "pairs" else None, cut(df, name))[1])
    found = similar.similar(docs([(i, " ".join(ring[i : i + width])) for i in range(n)])).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, 0) for i in range(n)}
    assert sum(made) <= 8 * n
