"""From raw documents to a training mix: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import KEPT, cut, packed, sweep, unpacked, written
from loglathe.llm.decontaminate import clean
from loglathe.llm.language import UNDETERMINED, identified
from loglathe.llm.mixing import mix
from loglathe.llm.repeats import without_repeats
from loglathe.llm.similar import similar
from loglathe.llm.simhash import first_of_each

#: Share of a document's letters that its language must have.
MAIN_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those without a main language go (operator 6)."""
    own = ("doc_id", "text", "lang")
    found = identified(packed(docs, *own), keep=("doc_id", "lang", KEPT))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MAIN_LANGUAGE)).select(unpacked(docs.columns, *own))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies, linked at a Jaccard similarity of 0.8 over five-word shingles, the
    document with the smallest id stays: the index of fingerprints gives links, which whole sets confirm,
    and what fingerprints can't find is added (operator 3)."""
    own = ("doc_id", "text")
    return first_of_each(packed(docs, *own), similar(docs)).select(unpacked(docs.columns, *own))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier in the corpus go; documents with nothing left go (operator 5)."""
    own = ("doc_id", "text")
    found = without_repeats(packed(docs, *own), keep=(KEPT,), as_text=True)
    found = found.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", F.col("kept")).select(unpacked(docs.columns, *own))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold questions of the benchmark go (operator 10)."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the copies that the mix takes of it, and their shards (operator 2).  A column
    that the mix adds is called mix_... where the documents have one of its name."""
    own = ("doc_id", "source", "text")
    mixed = mix(packed(docs, *own), keep=("text", KEPT))
    taken = {c.lower() for c in docs.columns}
    added = [F.col(c).alias(f"mix_{c}" if c in taken else c) for c in mixed.columns if c not in (*own, KEPT)]
    return mixed.select(*unpacked(docs.columns, *own), *added)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

#: The rows follow a trained model and seeded draws, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(written())
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(docs, since)
    return docs
