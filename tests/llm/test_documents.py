"""Operators on documents against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loglathe.llm import decontaminate, language, licenses, mixing, repeats, similar, simhash
from loglathe.llm.token_counts import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(rng, n, vocabulary=400):
    return " ".join("".join(chr(97 + (w * 7 + k * 5) % 26) for k in range(2 + w % 6)) for w in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    texts = [None, "", " ", "Hello, world...  it's fine <|endoftext|> a.b. c., Été, İx\x1cy", "\n\ttabs\x0bhere 123 \U0001f600!!", "x" * 3000, "the the. The", "the the. The"]
    got = {r.doc_id: r for r in token_counts(docs(enumerate(texts)), public_tokenizers.path(name), limit=2).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(public_tokenizers.path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False))
    for i, t in enumerate(texts):
        if t is not None:
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (count(t), len(t.encode()), count(t) > 2), t
    assert (got[0].n_tokens, got[0].n_bytes) == (0, 0)


def test_token_counts_of_no_documents(docs):
    assert token_counts(docs([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("longest", [64, 1])
def test_simhash_components(spark, longest):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & ((1 << 64) - 1) for b in base for _ in range(12)})
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "node long, fp long"), longest), "a", "b")
    got = {r.node: r.component for r in found.collect()}
    root = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(root))


def test_simhash_of_odd_texts(docs):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "a b c d"), (5, "a b c d"), (None, "a b c d")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()]
    assert len(got) == 7 and {x for i, x, _ in got if i in (1, 2)} == {"0" * 16}
    assert {c for i, _, c in got if i in (3, 4)} == {3} and {c for i, _, c in got if i in (5, None)} == {5}
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("longest", [16, 1])
def test_similar_documents(spark, docs, longest):
    """Near-copies on both sides of 0.8 against all pairs, and what the pipeline's stage keeps of them."""
    import corpus_pipeline

    rng = random.Random(12)
    texts = {}
    for _ in range(8):
        base = words(rng, rng.randrange(20, 120)).split()
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)
    texts |= {100: "two words", 101: "TWO  words", 102: "", 103: None, 104: texts[7]}
    sets = {i: (lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))((t or "").lower().split()) for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                    root[i] = root[j] = min(root[i], root[j])
    table = docs([*texts.items(), (104, texts[7]), (None, texts[7])])
    got = [(r.doc_id, r.component_id) for r in similar.similar(table, longest=longest).collect()]
    assert len(got) == len(texts) + 2 and {i: c for i, c in got if i is not None} == root
    assert 8 < len(set(root.values())) < len(texts) - 10
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, table, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(root.values())) and kept.count(None) == 1
    assert similar.similar(docs([])).count() == 0


def test_repeats(docs, monkeypatch):
    rng = random.Random(2)
    passages = [words(rng, 40) for _ in range(4)]
    texts = {i: " ".join(words(rng, rng.randrange(60)) + " " + rng.choice(passages) for _ in range(rng.randrange(4))) for i in range(40)}
    texts |= {50: texts[3], 51: "a" * 1500, 52: "ab" * 400 + passages[0], 53: "é" * 300, 54: "", 55: "short", 56: words(rng, 900) + passages[1] * 3}
    expected = repeats.brute_force({i: t.encode() for i, t in texts.items()})
    rows = [*texts.items(), (60, None), (None, texts[3]), (3, texts[3])]
    got = [(r.doc_id, r.n_removed, r.n_spans, r.sha) for r in repeats.without_repeats(docs(rows)).withColumn("sha", F.sha2("kept", 256)).collect()]
    assert len(got) == len(rows)
    for i, *rest in got:
        if i in expected:
            assert tuple(rest) == expected[i], i
        else:
            assert rest[0] == 0
    assert repeats.without_repeats(docs([])).count() == 0


def test_repeats_of_texts_whose_rolling_hashes_are_equal(docs):
    """Polynomials modulo 2**64 are alike for Thue-Morse words and their complements, whatever the base."""
    turned = lambda a, b, flip: "".join((a, b)[i.bit_count() % 2 ^ flip] for i in range(64))
    texts = {i: f"{turned('f', 'D', i)}.cilhzyxohflwqfzkhfgmrvchispltviu......{turned('K', 'B', i)}...." for i in (0, 1)}
    texts |= {i + 2: "".join("ab"[(j + i).bit_count() % 2] for j in range(700)) for i in range(3)}
    expected = repeats.brute_force({i: t.encode() for i, t in texts.items()})
    assert expected[1][0] == 0
    for table in (docs(texts.items()).coalesce(1), docs(texts.items()).repartition(5)):
        got = {r.doc_id: (r.n_removed, r.n_spans, r.sha) for r in repeats.without_repeats(table).withColumn("sha", F.sha2("kept", 256)).collect()}
        assert got == expected


def test_repeats_in_pieces(monkeypatch):
    """Long documents go through in pieces; phrases and cores stay within them."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(3)
    text = words(rng, 800).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["doc_id", "text"])
    (phrases,) = repeats._parse(iter([batch]))
    covered = sorted((s, abs(e) % 128) for s, e in zip(phrases.column("start").to_pylist(), phrases.column("extent").to_pylist(), strict=True))
    at = 0
    for start, extent in covered:
        assert start == at
        at += extent
    assert at == len(text) - repeats.LENGTH + 1
    listed = pa.array([[{"start": s, "extent": e} for s, e in zip(phrases.column("start").to_pylist(), phrases.column("extent").to_pylist(), strict=True) if e > 0]])
    (cores,) = repeats._cores(iter([batch.append_column("phrases", listed)]))
    assert sum(cores.column("extent").to_pylist()) == at


def test_mixing(docs, spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(5, 120)), "en", rng.choice(["a", "b", "c", None]), 0, "") for i in range(600)] + [(1000, None, "en", "a", 0, ""), (1001, "", "en", "d", 0, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    got = mixing.mix(table).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(table.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == len(rows)
    total = sum(r.size for r in got)
    for source, weight in (("a", 1), ("b", 2), ("c", 3), (None, 2)):
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
    assert abs(sum(t for _, t in {(r.source, r.target) for r in got}) - total) < 1
    assert all(r.taken <= 3 * r.size and len({(c.shard, c.round) for c in r.copies}) == len(r.copies) for r in got)
    assert mixing.mix(docs([])).count() == 0
    held = mixing.shards(mixing.mix(table)).select("doc_id", "shard", "round", "place", "size").collect()
    assert sorted((r.doc_id, r.shard, r.round) for r in held) == sorted((r.doc_id, c.shard, c.round) for r in got for c in r.copies)
    assert sum(r["size"] for r in held) == sum(r.taken for r in got) and {r.shard for r in held} <= set(range(16))


def test_mixing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)  # many blocks, so that every shard has some
    rows = [(i % 40, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(400)] + [(None, "x y z", "a")] * 9
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table, keep=("text",)).collect()
    assert {r.shard for r in mixing.shards(mixing.mix(table)).collect()} == set(range(16))
    assert len(got) == len(rows) and all(r["size"] == len(r.text.split()) and r.taken <= 3 * r["size"] for r in got)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 780.0, "b": 30.0, "c": 300.0}


def test_quotas_are_split_exactly(spark):
    quotas = [(0, 100), (1, 3), (2, 57), (3, 0)]
    got = mixing.split_quotas(spark.createDataFrame(quotas, "rank int, quota long"), 3, 5).collect()
    for rank, quota in quotas:
        taken = sorted((r.first, r.last) for r in got if r["rank"] == rank)
        assert [x for a, b in taken for x in range(a, b)] == list(range(quota))
    sizes = {s: sum(r.last - r.first for r in got if r.shard == s) for s in range(8)}
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_language(docs, spark):
    rng = random.Random(5)
    speak = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(1 + rng.randrange(3))) for _ in range(40))
    kinds = {"aa": ["ka", "zu", "mo"], "bb": ["the", "ing", "er"], "cc": ["жа", "ро", "ни"]}
    rows = [(i, speak(kinds[k]), k, "s", 0, "") for i, k in enumerate(list(kinds) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    model = language.train(table)
    texts = [None, "", "123 !", speak(kinds["aa"]), speak(kinds["aa"]) + " " + speak(kinds["bb"]), "你好", speak(kinds["cc"])]
    got = {r.doc_id: r for r in language.identify(docs(enumerate(texts)), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred == "aa" and got[6].lang_pred == "cc"
    assert [s.lang for s in got[4].lang_spans] == ["aa", "bb"] and got[5].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identified(docs([])).count() == 0


def test_licenses(docs):
    rows = [(1, "Foo.\nReleased under the MIT License. All rights reserved.\nBar"), (2, None), (3, ""), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "no license here"), (None, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.license, r.n) for r in licenses.scan(docs(rows)).collect()}
    assert got == {(1, "MIT", 1), (1, "All-Rights-Reserved", 1), (4, "GPL-3.0-only", 1), (None, "CC-BY-NC-4.0", 1)}


MIT = """MIT License

Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
ISC = """ * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice appears in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must
   retain the above copyright notice.
2. Redistributions in binary
   form must reproduce the above copyright notice.
"""
GPL = """# This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU {} Public License as published by
# the Free Software Foundation{} either version {} of the License, or
# (at your option) any later version."""


def test_licenses_of_spdx_expressions(docs):
    texts = {
        1: "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1-or-later */\nint x;",
        2: "# SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0\n# spdx-license-identifier: epl-2.0 and BSL-1.0 or GPL-3.0",
        3: "SPDX-License-Identifier: MIT.\nSPDX-License-Identifier: MIT",
        4: "SPDX-License-Identifier: LicenseRef-own and more",
        5: "SPDX-License-Identifier: ",
        6: "SPDX-License-Identifier: MIT\nReleased under the MIT License.",
    }
    got = {}
    for r in licenses.scan(docs(texts.items())).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.n
    assert got == {
        1: {"MIT": 1, "Apache-2.0": 1, "LGPL-2.1": 1}, 2: {"GPL-2.0-or-later": 1, "EPL-2.0": 1, "BSL-1.0": 1, "GPL-3.0-only": 1}, 3: {"MIT": 2}, 6: {"MIT": 2},
    }
    assert licenses.scan(docs([])).count() == 0


def test_licenses_over_lines(docs):
    texts = [
        (MIT, {("MIT", 1)}),
        (MIT.replace("\n", "\r\n"), {("MIT", 1)}),
        (ISC, {("ISC", 1)}),
        (BSD, {("BSD-2-Clause", 1)}),
        (BSD + "3. Neither the\n   name of X may be used.\n", {("BSD-3-Clause", 1)}),
        (GPL.format(":", "General", ",", "3"), {("GPL-3.0-or-later", 1)}),
        (GPL.format(";", "General", ";", "2"), {("GPL-2.0-or-later", 1)}),
        (GPL.format(";", "Lesser General", ";", "2.1"), {("LGPL-2.1", 1)}),
        (GPL.format(":", "Affero General", ",", "3"), {("AGPL-3.0", 1)}),
        ("Licensed under the terms of the GNU General\nPublic License version 2 as published by the Free Software Foundation.", {("GPL-2.0-only", 1)}),
        ("Licensed under the GNU General Public License version 2\nor any later version", {("GPL-2.0-or-later", 1)}),
        ("In no event shall we stop\nReleased under the MIT License\nor be liable for it\nAll rights reserved\nLicensed under CC BY 4.0", {("MIT", 1), ("All-Rights-Reserved", 1), ("CC-BY-4.0", 1)}),
        ("Released under the\n\nMIT License", set()),
        ("permission is hereby granted\n" * 3000, set()),
    ]
    got = {}
    for r in licenses.scan(docs([(i, t) for i, (t, _) in enumerate(texts)])).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.n))
    assert [got.get(i, set()) for i in range(len(texts))] == [w for _, w in texts]


def test_decontamination(docs, spark):
    rng = random.Random(6)
    question = "A train leaves Boston at 40 miles per hour and reaches Denver after 12 hours how far does the train from Boston travel"
    other = "A train leaves Madrid at 55 miles per hour and reaches Vienna after 31 hours how far does the train from Madrid travel"
    mixed = "A train leaves Madrid at 55 miles per hour and reaches Vienna after 31 hours how far does the train from Lisbon travel"
    items = spark.createDataFrame([(1, question, 0), (2, words(rng, 30), 0), (3, words(rng, 30), 0), (4, "two words", 0), (5, None, 0), (6, question, 0)], "item_id long, text string, doc_id int")
    two = items.where("item_id = 2").first().text
    rows = [(10, words(rng, 50) + " " + question + " " + words(rng, 50)), (11, "x " + other), (12, mixed), (13, words(rng, 200)), (14, None), (15, ""), (16, two.upper() + "!"), (16, two.upper() + "!"), (None, question)]
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.contaminated(docs(rows), items).collect()}
    assert {(10, 1, True), (11, 1, False), (16, 2, True)} <= got and {i for i, *_ in got} <= {10, 11, 12, 16}
    assert {r.n_items for r in decontaminate.contaminated(docs(rows), items).where("item_id = 1").collect()} == {2}
    assert {(r.item_id, r.question_id) for r in decontaminate.questions(items).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 1)}
    kept = {r.doc_id for r in decontaminate.clean(docs(rows), items).collect()}
    assert {13, 14, 15, None} <= kept and not kept & {10, 11, 16}


def test_decontamination_of_short_questions(docs, spark):
    items = spark.createDataFrame([(1, "What is 17 plus 25 times 3"), (2, "name the capital"), (3, "Why?"), (4, "how far is Paris from Rome"), (5, "!"), (6, "Is 5 odd")], "item_id long, text string")
    rows = [(10, "so: What is 18 plus 26 times 4 then"), (11, "what is 17 plus 25 times 3"), (12, "Name the CAPITAL, please"), (13, "and why not"), (14, "how far is Madrid from Oslo"), (15, "how far is Madrid from Madrid")]
    rows += [(16, "What is 18 plus 18 times 4"), (17, "What is 17 minus 25 times 3"), (18, "name a capital"), (19, "Is 7 odd"), (20, "is 5 odd"), (21, "! .")]
    got = {(r.doc_id, r.item_id, r.n_words, r.exact) for r in decontaminate.contaminated(docs(rows), items).collect()}
    assert got == {(10, 1, 7, False), (11, 1, 7, True), (12, 2, 3, True), (13, 3, 1, True), (14, 4, 6, False), (20, 6, 3, True)}


def test_digest_of_whole_texts():
    assert repeats.brute_force({1: b"x"})[1] == (0, 0, hashlib.sha256(b"x").hexdigest())
