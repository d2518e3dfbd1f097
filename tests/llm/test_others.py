"""Conversations, pages, vectors and the pipeline against brute force."""

import hashlib

import numpy as np

from loglathe.llm import chat, neighbours, warc


def test_chat_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok"
    talks = {1: [("user", "hi"), ("assistant", "a")], 2: [("user", "hi"), ("assistant", "a"), ("user", "b")], 3: [("user", "hi"), ("assistant", "a")], 4: [("user", nasty), ("assistant", nasty)], 5: [("assistant", "")], 6: [("us:er\\", "\n#<>\U0001f600")]}
    rows = [(c, t, r, x, 0) for c, turns in talks.items() for t, (r, x) in enumerate(turns)] + [(7, None, None, None, 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    talks[7] = [("", "")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for limit in (chat.PACK, 1):
        packs = chat.pack(table, limit)
        got = {r.conv_id: r for r in chat.read_back(packs).collect()}
        assert set(got) == set(talks)
        for c, turns in talks.items():
            learned = "".join(x for r, x in turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha(learned))
            assert got[c].formatted_chars == sum(len(chat.format_turn(*t)[0]) for t in turns)
    one = chat._Pack()
    for c in (1, 3, 2):
        one.add(c, talks[c])
    assert one.size == sum(len(chat.format_turn(*t)[0]) for t in talks[2])
    assert [(s["length"], s["position"]) for s in one.segments][1] == (0, one.segments[0]["length"])
    assert chat.pack(table.where("conv_id > 99")).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    long = "<html>" + "x" * 1200
    trap = "before " + warc.MAGIC + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + warc.MAGIC
    rows = [(1, "u", long), (2, "u\r\nX: y", long), (3, None, trap), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", long + trap), (8, "u", "é" * 700), (2, "u", long), (None, "u", "z")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = i == 1
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.where("page_id > 99")).count() == 0
    monkeypatch.setattr(warc, "bounded", lambda table: table.hint("merge"))  # as beyond the bound
    merged = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(merged, key=repr) == got


def test_pointer_jumping_rejects_what_no_chain_reaches():
    import pandas as pd

    frame = pd.DataFrame({"file": "f", "offset": [0, 10, 15, 40, 50], "successor": [10, 40, 50, 60, -1], "number": range(5), "place": range(5)})
    assert warc._jump(frame)["reached"].tolist() == [True, True, False, True, False]


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for _ in range(1500)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(2000 + i, vectors[0], 0) for i in range(30)] + [(3000, None, 0), (3050, [0.0] * 16, 0), (3100, [float("nan")] * 16, 0), (3150, [1.0, 2.0], 0), (3200, [None] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.nearest(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and len(v) == 16 and v[0] is not None and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v / np.linalg.norm(v) for _, v in good])
    hits = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        top = np.lexsort((ids, -np.round(s, 12)))[:5]
        hits += len(set(ids[top]) & {v for v, _ in got[q]})
        total += 5
    assert hits / total >= 0.9
    assert [v for v, _ in got[0]] == [2000, 2001, 2002, 2003, 2004] and not set(got) & {3000, 3050, 3100, 3150, 3200}
    assert neighbours.nearest(table.where("vec_id > 9999"), table).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    text = "the quick brown fox jumps over the lazy dog and runs into the deep green wood where nobody ever goes alone at night because of wolves " * 2
    rows = [(i, f"{text[i:]} number{i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", f"s{i % 2}", 0) for i in range(12)]
    rows += [(20, rows[3][1], "en", "s0", 0), (21, "12345 !!", None, "s1", 0), (22, None, None, None, 0), (23, "some question of the benchmark that nobody should ever have seen before the test", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        counts.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert not {21, 22} & set(counts[0]) and 20 not in counts[1] and 23 not in counts[3]
    assert counts[3] == counts[4] and set(range(12)) >= set(counts[4])


def test_pipeline_of_clashing_names_and_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    added = ["score", "lang_pred", "component_id", "component", "n_bytes", "kept", "repeats", "phrases", "hash", "size", "target", "taken", "copies", "rank", "block"]
    fields = ", ".join(f"{c} int" for c in added)
    words = lambda i: " ".join(f"word{chr(97 + i)}{chr(97 + k)} is" for k in range(25))
    rows = [(i, words(i), "en", "s", -1, *range(len(added))) for i in range(4)] + [(7, None, None, None, None, *[None] * len(added))]
    documents = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {fields}")
    items = spark.createDataFrame([(1, "who asks for a word that no one here has ever said at all", 0)], "item_id long, text string, doc_id int")
    for name, some, found in (("whole", documents, {0, 1, 2, 3}), ("none", documents.where("doc_id > 99"), set())):
        folder = str(tmp_path / name)
        some.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns[: len(documents.columns)] == documents.columns and {"mix_taken", "mix_size", "source_size"} <= set(got.columns)
        got = got.collect()
        assert {r.doc_id for r in got} == found
        assert all(tuple(r[c] for c in added) == tuple(range(len(added))) and r.mix_size == 50 and r.n_chars == len(r.text) for r in got)


def test_a_run_leaves_its_result_only(spark):
    from loglathe.llm import common

    before = common.cut(spark.range(2), "before")
    since = len(common.written())
    common.cut(spark.range(3), "way")
    result = common.cut(spark.range(4), "result")
    common.sweep(result, since)
    assert (before.count(), result.count()) == (2, 4) and common.written()[since - 1 :] == [before._loglathe_path, result._loglathe_path]


def test_warc_chains_cross_splits(spark, tmp_path):
    trap = "x" * 700 + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + warc.MAGIC + "y" * 900
    rows = [(i, "u", trap + f" {i}" if i % 3 else f"p{i}" * (1 + i * 7)) for i in range(60)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "archive"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "1000")
        assert warc.candidates(spark, str(tmp_path / "archive")).select("split").distinct().count() > 50
        got = warc.read(spark, str(tmp_path / "archive")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((int(r.record_id[10:-1]), bytes(r.payload).decode()) for r in got) == [(i, h) for i, _, h in rows]
