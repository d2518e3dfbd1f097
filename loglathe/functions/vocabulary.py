"""The controlled vocabulary: case and white space around a word don't matter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import looked_up, strip

#: Words of each field (fixed values).
WORDS = {
    "level": "critical debug error info warn".split(),
    "category": "agentic core_api cv llm".split(),
    "sub_category": (
        "analytics auth build config data data_io dependency deployment embedding_service event inference infrastructure job kv_cache "
        "metrics model model_drift model_load network planner preproc quantization rag_timeout rate_limit reranker safety scheduler "
        "security service storage streaming system third_party tokenizer tool_call tracking ui user_input"
    ).split(),
    "outcome": "cancelled failure pending running success timeout".split(),
    "safety_flags": (
        "flag_bias flag_bias_visual flag_data_drift flag_hallucination flag_harassment flag_hate_speech flag_misclassification "
        "flag_nsfw_image flag_pii flag_privacy_violation flag_private_data flag_prompt_injection flag_security flag_sexual_content "
        "flag_tampering flag_toxicity flag_violence flag_violent_image none"
    ).split(),
    "error_code": (
        "ULOG-AUTH-001 ULOG-DATA-001 ULOG-DB-001 ULOG-MODEL-001 ULOG-NET-001 ULOG-SEC-001 ULOG-STORE-001 ULOG-SVC-001 ULOG-SYS-001 ULOG-TP-001"
    ).split(),
}
ERROR_CODE = r"^ULOG-[A-Z]{2,10}-[0-9]{3}$"


@dataclass(frozen=True)
class Vocabulary:
    """The words of each field; a field that isn't named has those of WORDS."""

    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def of(cls, words: dict[str, list[str]]) -> Vocabulary:
        if unknown := set(words) - set(WORDS):
            raise ValueError(f"no vocabulary for {sorted(unknown)}")
        return cls(tuple((k, tuple(v)) for k, v in sorted(words.items())))

    def words(self, name: str) -> tuple[str, ...]:
        return dict(self.fields).get(name, tuple(WORDS[name]))


BUILT_IN = Vocabulary()


def canonical(name: str, text: Column, vocabulary: Vocabulary = BUILT_IN) -> Column:
    """The vocabulary's word for a text, or SQL NULL."""
    return looked_up(F.lower(strip(text)), {w.strip().lower(): w for w in vocabulary.words(name)})


def canonical_flags(flags: Column, vocabulary: Vocabulary = BUILT_IN) -> Column:
    """The vocabulary's words for an array of texts, or SQL NULL if any is unknown."""
    words = F.transform(flags, lambda x: canonical("safety_flags", x, vocabulary))
    return F.when(~F.exists(words, lambda x: x.isNull()), words)
