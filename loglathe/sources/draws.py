"""Draws that need no memory of others: numbers that are distinct, and numbers that go together.

Distinct numbers are a keyed permutation of the row's number (a Feistel network), so that a billion rows
on any number of machines never draw one twice and nothing is looked up or tried again.  Numbers that go
together are a Gaussian copula: normal draws with a common part, each brought to its own range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .synthetic import TEMPLATES, filled

#: Rounds of the network: three are enough for a permutation that looks random, one more is usual.
ROUNDS = 4
#: Metrics of the vision domain: range, and how much of a record's quality they follow (fps falls as it rises).
METRICS = {"accuracy": (0.55, 1.0, 0.8), "precision": (0.55, 1.0, 0.8), "recall": (0.55, 1.0, 0.8), "iou": (0.5, 1.0, 0.7), "ap": (0.5, 1.0, 0.7), "ap50": (0.5, 1.0, 0.7), "map": (0.45, 1.0, 0.7), "fps": (20.0, 120.0, -0.3)}


def permuted(number: Column, count: int, seed: int) -> Column:
    """Another number for each from 0 to count - 1, all distinct, below the power of four that is count or
    the next one above it."""
    half = max(1, math.ceil(math.log2(max(count, 2)) / 2))
    mask = (1 << half) - 1
    left, right = F.shiftright(number, half), number.bitwiseAND(F.lit(mask))
    for i in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(i), right).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half).bitwiseOR(right)


def distinct_lines(spark: SparkSession, domain: str, count: int, seed: int = 12345) -> DataFrame:
    """Rows (_seq, ``@timestamp``, ``@message``) of synthetic lines of which no two are equal: those
    templates that have a number, each filled with a number that no other line has."""
    numbered = [t for t in TEMPLATES[domain] if "{n}" in t]
    number = permuted(F.col("id"), count, seed)
    pick = (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit("template")), F.lit(len(numbered))) + 1).cast("int")
    message = F.element_at(F.array(*(filled(t, seed, n=number.cast("string")) for t in numbered)), pick)
    moment = F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(count).select(F.col("id").alias("_seq"), moment.alias("@timestamp"), message.alias("@message"))


def _uniform(number: Column, what: str, seed: int) -> Column:
    """A number between 0 and 1, without the ends."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), number, F.lit(what)), 12).cast("double") + 0.5) / float(1 << 52)


def normal(number: Column, what: str, seed: int) -> Column:
    """A standard normal draw, by two uniform ones."""
    return F.sqrt(-2.0 * F.log(_uniform(number, what, seed))) * F.cos(2 * math.pi * _uniform(number, f"{what} turn", seed))


def vision_metrics(rows: DataFrame, number: str = "_seq", seed: int = 12345, digits: int = 4) -> DataFrame:
    """Rows with the METRICS and f1_score: within a record they follow one quality, so that records are good
    or bad as a whole.  f1_score is that of precision and recall."""
    n, common = F.col(number), normal(F.col(number), "quality", seed)
    for name, (low, high, weight) in METRICS.items():
        own = normal(n, name, seed) * math.sqrt(1 - abs(weight)) + common * math.copysign(math.sqrt(abs(weight)), weight)
        part = 1.0 / (1.0 + F.exp(-1.702 * own))  # near the normal distribution's share below a number
        rows = rows.withColumn(name, F.round(low + (high - low) * part, digits))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1_score", F.round(2 * p * r / (p + r), digits))
