"""Redaction of the documents' texts, with SQL that finds and merges the intervals on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.redaction import DETECTORS, DIGITS, redact

KEY = b"a key for tests"


def redacted_documents(spark, sf_dir):
    """Each document with what was found in it, and a digest of the text that is left."""
    found = redact(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text", KEY)
    told = F.array_join(F.transform("redacted_spans", lambda x: F.concat_ws(" ", x["start"].cast("string"), x["end"].cast("string"), x["kind"], x["pseudonym"])), "; ")
    return found.select("doc_id", F.size("redacted_spans").alias("n"), told.alias("spans"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"redacted_documents": redacted_documents}


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    one = " union all ".join(f"select doc_id, text, string_split_regex(text, {text(x)}) as b, regexp_extract_all(text, {text(x)}) as m, {i} as rank from documents where regexp_matches(text, {text(x)})" for i, x in enumerate(DETECTORS.values()))
    block = KEY.ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in block) for pad in (0x36, 0x5C))
    kinds = " ".join(f"when {i} then '{k}'" for i, k in enumerate(DETECTORS))
    return f"""with f as ({one}),
      each as (select doc_id, rank, m[k] as match, list_sum(list_transform(b[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) as s from (select *, unnest(range(1, len(m) + 1)) as k from f)),
      o as (select doc_id, rank, s, s + length(match) as e from each),
      g as (select *, sum(case when s <= before then 0 else 1 end) over (partition by doc_id order by s, e, rank rows unbounded preceding) as grp
            from (select *, max(e) over (partition by doc_id order by s, e, rank rows between unbounded preceding and 1 preceding) as before from o)),
      i as (select doc_id, grp, min(s)::int as s, max(e)::int as e, case min(rank) {kinds} end as kind from g group by doc_id, grp),
      v as (select i.*, substr(text, s + 1, e - s) as value, text from i join documents using (doc_id)),
      p as (select *, substr(sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode(value)))), 1, {DIGITS}) as pseudonym,
              coalesce(lag(e) over (partition by doc_id order by s), 0) as prior from v),
      t as (select doc_id, count(*)::int as n, string_agg(s || ' ' || e || ' ' || kind || ' ' || pseudonym, '; ' order by s) as spans,
              string_agg(substr(text, prior + 1, s - prior) || '<' || kind || '#' || pseudonym || '>', '' order by s) || substr(any_value(text), max(e) + 1) as left_text from p group by doc_id)
      select doc_id, coalesce(n, 0)::int as n, coalesce(spans, '') as spans, sha256(coalesce(left_text, text)) as text_sha256 from documents left join t using (doc_id)"""


ORACLE_SQL = {"redacted_documents": _sql()}
