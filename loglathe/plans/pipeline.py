"""The chain from raw lines to labelled records, one projection over the input.

Modes: ``strict`` keeps each line's text and how it was parsed in ``meta`` and reports what the
contract of its domain says; ``compat`` leaves ``meta`` to what the records bring, skips validation
where no parse is noted, and fails records with empty quoted values.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import field as at
from ..functions.literals import obj, overlay, parsed, put, quoted, record, text_of, word
from ..functions.vocabulary import BUILT_IN, Vocabulary
from ..operators import parsing, rules
from ..operators.contracts import CONTRACTS, check, with_words
from ..operators.embedded import generated_record
from ..operators.normalising import Defaults
from ..operators.normalising import normalise as normalised
from ..operators.records import envelope, is_normalised, merge_meta, parse_meta, parse_ok
from ..operators.routing import route


@dataclass(frozen=True)
class Options:
    mode: str = "strict"
    dialect: str = "production"
    domain: str | None = None
    validate: bool = True
    defaults: Defaults = field(default_factory=Defaults)
    patterns: parsing.Registry = parsing.BUILT_IN
    words: Vocabulary = BUILT_IN

    def __post_init__(self):
        if self.mode not in ("strict", "compat"):
            raise ValueError(f"unknown mode {self.mode!r}")


def _column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"].cast("string") if name in df.columns else F.lit(None).cast("string")


def fenced(rows: DataFrame, stage: str) -> DataFrame:
    """rows with a count of them among the run's observed metrics.  Filters above stay above: the
    optimiser would else copy a whole chain of expressions into each predicate over its results."""
    return rows.observe(f"loglathe-{stage}-{uuid.uuid4().hex}", F.count("*").alias("rows"))


def match(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds domain and pattern (SQL NULL where none matches) to lines with the column ``@message``, and
    the message as ``_line``."""
    routed = route(lines.withColumn("_line", _column(lines, "@message")), F.col("_line"), options.domain)
    return routed.withColumn("pattern", parsing.pattern_of(F.col("_line"), F.col("domain"), options.patterns))


def parse(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds domain, pattern, confidence, fields (a record, SQL NULL where no pattern matches) and ok
    to lines with the columns ``@timestamp`` and ``@message``."""
    message, matched = F.col("_line"), match(lines, options)
    found = matched.withColumn("fields", parsing.fields_of(message, F.col("pattern"), options.patterns)).withColumn("confidence", parsing.confidence_of(F.col("pattern"), options.patterns))
    found = found.withColumn("_text", text_of(at(F.col("fields"), "message"))).withColumn("_pairs", parsing.pairs_of(F.col("_text"), F.col("pattern"), options.patterns))
    found = found.withColumn("fields", parsing.with_pairs(F.col("fields"), F.col("_pairs"), F.col("pattern")))
    broken = parsing.breaks_compatibly(F.col("_text"), F.col("pattern"), F.col("fields"), options.patterns) if options.mode == "compat" else F.lit(False)
    return fenced(found.withColumn("broken", broken).withColumn("ok", F.col("fields").isNotNull() & ~F.col("broken")).drop("_line", "_text", "_pairs"), "parsed")


def unparsed(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """The lines that no pattern matches or that lack a timestamp or message, with their envelopes in
    record; what parsing does besides isn't done for them."""
    timestamp = _column(lines, "@timestamp")
    missing = (F.coalesce(timestamp, F.lit("")) == "") | (F.coalesce(F.col("_line"), F.lit("")) == "")
    failed = fenced(match(lines, options), "matched").withColumn("_missing", missing).where(F.col("_missing") | F.col("pattern").isNull())
    reason = F.when(F.col("_missing"), "missing_required_fields").otherwise("no_pattern_match")
    domain = F.when(F.col("_missing"), "core_api").otherwise(F.col("domain"))
    return failed.withColumn("record", envelope(timestamp, F.col("_line"), domain, reason, options.defaults)).drop("_line", "_missing")


def normalise(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds record, the normalised record or an envelope, for every line."""
    timestamp, message = _column(lines, "@timestamp"), _column(lines, "@message")
    missing = (F.coalesce(timestamp, F.lit("")) == "") | (F.coalesce(message, F.lit("")) == "")
    found = parse(lines, options).withColumn("record", F.when(F.col("ok") & ~missing, F.col("fields")))
    done = normalised(found, "record", "domain", options.defaults, options.words)
    stamped = put(F.col("record"), timestamp=quoted(timestamp))
    if options.mode == "strict":
        errors = F.get_json_object(at(F.col("record"), "meta"), "$.parse.error")
        stamped = overlay(stamped, record(meta=parse_meta(message, F.col("domain"), F.col("pattern"), F.col("confidence"), errors)))
    reason = F.when(missing, "missing_required_fields").when(F.col("broken"), "processing_error").otherwise("no_pattern_match")
    domain = F.when(missing | F.col("broken"), "core_api").otherwise(F.col("domain"))
    failed = envelope(timestamp, F.when(~F.col("broken"), message), domain, reason, options.defaults)
    return fenced(done.withColumn("record", F.when(F.col("record").isNotNull(), stamped).otherwise(failed)), "normalised")


def validate(records: DataFrame, options: Options = Options()) -> DataFrame:
    """Notes in meta.validation what a record's contract says, or that it was skipped."""
    if not options.validate:
        return records
    rec, skipped = F.col("record"), F.lit('{"skipped": true}')
    if options.mode == "compat":  # notes that a parse was validated, whatever the contract says
        known = F.coalesce(text_of(at(rec, "category")), rules.domain_of(rec))
        return records.withColumn("record", merge_meta(rec, "validation", F.when(parse_ok(rec), obj(schema=quoted(known), ok=F.lit("true"), errors=F.lit("[]"))).otherwise(skipped)))
    told = records.withColumn("_domain", F.coalesce(text_of(at(rec, "category")), rules.domain_of(rec)))
    checked = check(told, "record", F.col("_domain"), with_words(CONTRACTS, options.words))
    wrong = F.transform("failures", lambda x: F.concat(x["path"], F.lit(": "), x["keyword"]))
    note = obj(schema=quoted(F.col("_domain")), ok=(F.size("failures") == 0).cast("string"), errors=F.to_json(wrong))
    return checked.withColumn("record", merge_meta(rec, "validation", F.when(parse_ok(rec), note).otherwise(skipped))).drop("_domain", "failures")


def classify(records: DataFrame, options: Options = Options()) -> DataFrame:
    return fenced(rules.classify(records, "record", options.dialect), "labelled")


def classify_lines(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Raw lines to labelled records: the columns of lines, domain, pattern, ok, rule and record."""
    labelled = classify(validate(normalise(lines, options), options), options)
    return labelled.select(*lines.columns, "domain", "pattern", "ok", "rule", "record")


def classify_records(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Records given as JSON text (column value): normalised ones pass, raw ones are parsed, others
    become envelopes; all are labelled."""
    given = rows.withColumn("given", parsed(F.col("value")))
    get = lambda name: text_of(at(F.col("given"), name))
    raw = given.withColumn("@message", get("@message")).withColumn("@timestamp", F.coalesce(get("@timestamp"), get("timestamp"), F.lit("")))
    done = normalise(raw, options)
    timestamp = F.col("@timestamp")
    chosen = (
        F.when(is_normalised(F.col("given")), F.col("given"))
        .when(F.col("@message").isNotNull(), F.col("record"))
        .otherwise(envelope(timestamp, F.col("value"), F.lit("core_api"), F.lit("invalid_normalized_record"), options.defaults))
    )
    done = done.withColumn("record", chosen).select(*rows.columns, "record")
    return classify(validate(done, options), options)


def classify_generated(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """classify_lines() of lines of which some are records themselves, as JSON or written as text
    (``RAW_TXT name=<json> ...``): those are normalised as they are, in the domain given or the one that
    the line's text is routed to, and say so in meta.parse.  Columns: those of lines, domain, rule, record."""
    marked = lines.withColumn("_given", generated_record(_column(lines, "@message")))
    others = classify_lines(marked.where(F.col("_given").isNull()).drop("_given"), options)
    found = marked.where(F.col("_given").isNotNull()).withColumn("_line", _column(lines, "@message"))
    done = normalised(route(found, F.col("_line"), options.domain).withColumn("record", F.col("_given")), "record", "domain", options.defaults, options.words)
    parse = obj(parser_name=word("generator"), parser_version=word("0.0.0"), pattern_id=word("generated"), confidence=F.lit("1.0"), ok=F.lit("true"))
    meta = obj(raw_message=quoted(F.col("_line")), parse=parse)
    done = done.withColumn("record", put(overlay(F.col("record"), record(meta=meta)), timestamp=quoted(_column(found, "@timestamp"))))
    labelled = classify(validate(fenced(done, "generated"), options), options)
    columns = [*lines.columns, "domain", "rule", "record"]
    return others.select(columns).unionByName(labelled.select(columns))
