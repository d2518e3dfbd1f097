"""Queries over the training-data tables: each applies one operator, with production parameters,
to its whole table.  sf_dir is the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import scan_sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
CONTROL = (-7, "\\### Assistant: </turn> ok")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import pack, read_back

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(CONTROL[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL[1]).alias("text"))
    return read_back(pack(rows.unionByName(added)))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    found = without_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identified

    found = identified(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import without_passages

    return without_passages(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_read(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_mixing, op3_simhash, op4_chat, op5_repeats, op6_language, op7_warc, op8_neighbours, op9_licenses, op10_decontamination, op11_passages, op12_spelling, op13_divergence)
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages), d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
        m as (select h, n, max(page_id) as first from d where n >= 1000 group by h, n)
        select page_id, n as payload_bytes, h as payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
               case when first <> page_id then first end as refers_to
        from d left join m using (h, n)""",
    "op9_licenses": scan_sql(),
    "op11_passages": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        windows as (select doc_id, i, array_to_string(words[i : i + 49], ' ') as s from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)),
        again as (select doc_id, i from windows join (select s, min(doc_id) as first from windows group by s) using (s) where first < doc_id),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from again),
        each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as j from w),
        kept as (select doc_id, string_agg(word, ' ' order by j) as t, count(*) as n from each anti join gone using (doc_id, j) group by doc_id)
        select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""",
    # the checksum goes byte by byte through the table of all bytes' remainders
    "op12_spelling": r"""
        with recursive bits as (select list(list_reduce(range(8), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) order by i) as t from range(256) r(i)),
        runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
        many as (select doc_id, run, count(*) as n, hex(coalesce(doc_id::varchar, '') || ':' || run) as x from runs group by doc_id, run),
        sums as (select run, n, xor(list_reduce(list_transform(range(1, len(x) // 2 + 1), lambda k: ('0x' || substr(x, k * 2 - 1, 2))::bigint), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) as h from many, bits),
        words as (select word, sum(n)::bigint as n from (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from sums) where length(word) >= 7 group by word having sum(n) >= 2),
        less as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
        near as (select distinct a.word, a.n, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
                 union select l.word, l.n, w.word, w.n from less l join words w on l.rest = w.word union select w.word, w.n, l.word, l.n from less l join words w on l.rest = w.word),
        best as (select word, any_value(n) as n, count(*) as n_near, min((-other_n, other)) as b from near group by word),
        forms as (select word, n_near, case when -b[1] >= 10 * n then b[2] end as form, case when -b[1] >= 10 * n then -b[1] end as form_n from best),
        chain as (select word, form as root from forms where form is not null union all select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null),
        roots as (select word, root from chain c where not exists (select 1 from forms f where f.word = c.root and f.form is not null))
        select word, form, coalesce(root, word) as root, n, coalesce(n_near, 0)::bigint as n_near, form_n::bigint as form_n from words left join forms using (word) left join roots using (word)""",
    "op13_divergence": r"""
        with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        c as (select id, lang, source, term, count(*) as n from t group by all),
        kept as (select lang, term, sum(n) as n from c group by lang, term having count(*) >= 3),
        groups as (select distinct lang, source from d),
        counts as (select lang, source, term, coalesce(sum(c.n), 0) as n from groups join kept using (lang) left join c using (lang, source, term) group by all),
        p as (select *, 1 + (1000000000::hugeint * (n + 1)::hugeint) // (sum(n) over g + count(*) over g)::hugeint as p from counts window g as (partition by lang, source)),
        q as (select *, 1 + (1000000000::hugeint * (n + 1)::hugeint) // (sum(n) over g + count(*) over g)::hugeint as q from kept window g as (partition by lang)),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
                  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
        terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p join (select lang, term, q from q) using (lang, term) where p.n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (from pairs union all from terms))
        select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200""",
}
