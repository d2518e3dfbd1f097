"""A vocabulary of one's own: found, read, and taking effect in normalising and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from loglathe.functions.vocabulary import BUILT_IN, WORDS, Vocabulary
from loglathe.operators.contracts import CONTRACTS, with_words
from loglathe.plans.pipeline import Options, normalise, validate
from loglathe.sources import config

OWN = {"$defs": {"levels": {"enum": ["info", "error", "warn", "notice"]}, "outcomes": {"enum": ["success", "failure", "lost"]}}}


def test_where_a_vocabulary_is_found(tmp_path, monkeypatch):
    monkeypatch.delenv(config.VOCABULARY_VARIABLE, raising=False)
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert config.find_words(start=str(deep)) is None and config.load_vocabulary(start=str(deep)) == BUILT_IN
    file = tmp_path / config.VOCABULARY_FILE
    file.parent.mkdir()
    file.write_text(json.dumps(OWN))
    assert config.find_words(start=str(deep)) == str(file)
    named = tmp_path / "named.json"
    named.write_text(json.dumps({"vocabulary": {"levels": {"info": "plain", "error": "bad"}}}))
    monkeypatch.setenv(config.VOCABULARY_VARIABLE, str(named))
    assert config.load_vocabulary(start=str(deep)).words("level") == ("error", "info")
    assert config.find_words(str(file)) == str(file)
    with pytest.raises(FileNotFoundError):
        config.find_words(str(tmp_path / "none.json"))


def test_doubled_words_are_told(tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"$defs": {"level": {"enum": ["info", "INFO "]}}}))
    with pytest.raises(ValueError, match="doubled"):
        config.load_vocabulary(str(tmp_path / "v.json"))
    with pytest.raises(ValueError, match="no vocabulary"):
        Vocabulary.of({"colour": ["red"]})


def test_contracts_with_other_words():
    own = with_words(CONTRACTS, Vocabulary.of({"level": ["notice"]}))
    assert own["cv"]["properties"]["level"] == {"enum": ["notice"]} and own["cv"]["properties"]["outcome"] == {"enum": WORDS["outcome"]}
    assert own["llm"]["properties"]["safety_flags" if "safety_flags" in own["llm"]["properties"] else "category"]
    assert with_words(CONTRACTS, BUILT_IN) is CONTRACTS


def test_a_vocabulary_takes_effect(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps(OWN))
    words = config.load_vocabulary(str(tmp_path / "v.json"))
    rows = spark.createDataFrame([(0, "t", "[Data] opened level=Notice outcome=LOST fps=3")], "_seq long, `@timestamp` string, `@message` string")

    def run(vocabulary):
        options = Options(domain="cv", words=vocabulary)
        r = validate(normalise(rows, options), options).select(F.col("record")).first()["record"]
        return {k: json.loads(v) for k, v in r.items()}

    own, usual = run(words), run(BUILT_IN)
    assert own["level"] == "notice" and own.get("outcome") == "lost" and "unparsed_reason" not in own
    assert usual["unparsed_reason"] == "invalid_level_value" and "invalid_level_value" in usual["meta"]["parse"]["error"]
    assert own["meta"]["validation"] != usual["meta"]["validation"]
