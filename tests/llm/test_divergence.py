"""Distances of sources against sums term by term."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import divergence


def corpus(rng):
    terms = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}é"[: 2 + i % 2] for i in range(90)] + ["ZEBRA", "Über", "word"]
    rows = [(" ".join(rng.choice(terms[i % 5 :: 1 + i % 3]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "x"]), rng.choice(["a", "B", "é", None, "d"])) for i in range(300)]
    rows += [(None, "en", "empty"), ("1 2 _ -", "en", "signs"), ("only once", "rare", "a"), (None, "rare", "b"), ("alone alone", "single", "s"), ("alone", "single", "s"), ("alone\x00alone", "single", "s")]
    return rows + rows[:40]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 2), ("CHUNK", 5), ("CHUNKS", 3), ("PIECE", 20), ("HELD", 10), ("TOP", 4)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(random.Random(2 + small))
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, part string")
    got = [tuple(r) for r in divergence.divergence(table).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert set(got) == divergence.brute_force(rows) and len(got) == len(set(got))
    assert {x[:4] for x in got} >= {("rare", "a", "pair", "b"), ("rare", "b", "pair", "a")}


def test_no_divergence(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        total, terms = rng.randrange(10 ** rng.randrange(1, 15) + 1), rng.randrange(1, 10 ** rng.randrange(1, 9))
        rows.append((rng.randrange(total + 1), total, terms))
    want = [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n long, t long, v long").select("i", divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p"))
    assert [r.p for r in got.orderBy("i").collect()] == want
    n, t, v = (np.array(x) for x in zip(*rows, strict=True))
    assert divergence._shares(n, t + v).tolist() == want
