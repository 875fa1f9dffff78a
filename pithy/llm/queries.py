"""Queries op1 to op10: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pithy.llm import bpe, decontaminate, html_text, id_files, language_id, lexicon, near_dup, quality, suffix_dedup, token_counts, toxicity
from pithy.llm.tables import shared_dir, table

WORD_VOCAB, BYTE_VOCAB, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.fold("doc_id", 4) == 2
    model = language_id.train(docs.where(~held))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "n_letters", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language_id.fold("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "prose-1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base-1")).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode_decode(docs, lexicon.default_path(WORD_VOCAB))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, lexicon.default_path(WORD_VOCAB))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids"
    id_files.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, lexicon.default_path(BYTE_VOCAB), END_ID)
    return id_files.digest(spark, path)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.src").alias("first_doc_id"), F.col("s.start").cast("long").alias("start_word"), F.col("s.end").cast("long").alias("end_word"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontaminate": op8_decontaminate,
    "op9_id_files": op9_id_files,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (
  select doc_id, unnest(generate_series(1, len(w) - 2)) as p, w from d where len(w) >= 3),
k as (
  select doc_id, p, count(*) over (partition by doc_id, w[p], w[p + 1], w[p + 2]) as n from g),
c as (
  select doc_id, count(distinct q) as n_repeat_words
  from (select doc_id, unnest([p, p + 1, p + 2]) as q from k where n >= 2) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•·]')))::bigint as n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$')))::bigint as n_ellipsis_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join c on d.doc_id = c.doc_id),
b as (
  select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > 3 * n_words)::int
    + 8 * (100 * n_dup_lines > 60 * n_lines)::int + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 20 * n_words)::int
    + 64 * (10 * n_bullet_lines > 9 * n_lines)::int + 128 * (10 * n_ellipsis_lines > 5 * n_lines)::int)::bigint as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from b
""",
    "op7_near_duplicates": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))
                               when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_n >= 85 * (x.n + y.n - both_n)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from documents union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select c.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on n.doc_id = c.doc_id
""",
    "op8_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
v as (
  select distinct item, size, array_to_string(w[p : p + size - 1], ' ') as s from (
    select item, w, least(10, len(w)) as size, unnest(range(1, greatest(2, len(w) - 8))) as p from i where len(w) > 0)),
k as (select distinct size from v),
x as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from d, k where len(w) >= size),
h as (select x.doc_id, x.p, x.size, v.item from x join v on v.size = x.size and v.s = array_to_string(x.w[x.p : x.p + x.size - 1], ' ')),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
""",
}
