"""Registered queries of the compressor, each over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pithy.config import CompressionConfig, NoiseConfig, RedundancyConfig, TrimConfig
from pithy.functions import patterns as P
from pithy.functions import text as X
from pithy.operators import dedup, findings, jsonshape, noise, phrases, rank, trim
from pithy.plans import compress as plan
from pithy.sources.documents import compress_documents, compress_nodes, shared_base
from pithy.streaming.compress import compress_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    """Registers a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


# --- texts made from events: 100 events are one document ---------------------------------------------


def made(spark: SparkSession, sf: str, lines) -> DataFrame:
    """(doc_id, text) of the lines of each event in order."""
    ev = table(spark, sf, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("doc_id"), F.col("event_id").alias("e"), "event_type", "user_id")
    each = ev.select("doc_id", "e", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("k", "line"))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


def log_text(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    main = F.concat(F.lit("2024-01-15 10:"), _two(e % 60), F.lit(":"), _two((e * 7) % 60), F.lit(" [INFO] "), "event_type", F.lit(" uid="), F.col("user_id").cast("string"))
    extra = [
        F.when(e % 4 == 0, "Connecting to upstream service..."),
        F.when(e % 9 == 0, F.concat(F.lit("[==========> ] "), ((e % 10) * 10).cast("string"), F.lit("%"))),
        F.when(e % 11 == 0, ""),
        F.when(e % 12 == 0, ""),
        F.when(e % 13 == 0, "INFO"),
        F.when(e % 17 == 0, "3 rows in set"),
        F.when(e % 19 == 0, "    at com.foo.Bar(x)"),
        F.when(e % 23 == 0, "-----"),
        F.when(e % 29 == 0, "2024-01-15 10:30:45"),
    ]
    return made(spark, sf, F.array(main, *extra))


def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    e, user, kind = F.col("e"), F.col("user_id").cast("string"), F.col("event_type")
    host = F.concat(F.lit("10.0."), F.floor(e / 250).cast("string"), F.lit("."), (e % 250).cast("string"))
    line = (
        F.when(kind == "click", F.concat(host, F.lit(" port 22 open")))
        .when(kind == "view", F.concat(F.lit("Reflected XSS at https://x.local/p?id="), user))
        .when(kind == "purchase", F.concat(F.lit("SQL injection https://x.local/i?id="), user, F.lit(" CVE-2024-"), (e % 50 + 1000).cast("string")))
        .when(kind == "signup", F.concat(F.lit("weak password for user "), user))
        .when(kind == "error", F.concat(F.lit("outdated component on "), host))
        .otherwise(F.concat(F.lit("note "), kind))
    )
    return made(spark, sf, F.array(line))


def step_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth event as a step of an agent: sentences that differ in a few words."""
    e = F.col("e")
    line = F.concat(F.lit("Step "), e.cast("string"), F.lit(": inspecting the "), "event_type", F.lit(" latency of this service and comparing it against the known baseline of last week."))
    return made(spark, sf, F.array(F.when(e % 10 == 0, line)))


def table_text(spark: SparkSession, sf: str) -> DataFrame:
    row = F.concat(F.lit("| "), F.col("user_id").cast("string"), F.lit(" | "), F.col("event_type"), F.lit(" |"))
    return made(spark, sf, F.array(F.when(F.col("e") % 20 == 7, F.concat(F.lit("plain "), "event_type")).otherwise(row)))


def json_text(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "value")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("text"))


def conversation_text(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("text is not null").groupBy(F.col("conv_id").alias("doc_id"))
    return turns.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), "\n").alias("text"))


_LOG_SQL = """
ev as (select event_id as e, event_type, user_id from events),
l as (
  select e // 100 as doc_id, e, unnest(range(10)) as k0,
         unnest([concat('2024-01-15 10:', lpad((e % 60)::varchar, 2, '0'), ':', lpad(((e * 7) % 60)::varchar, 2, '0'), ' [INFO] ', event_type, ' uid=', user_id),
           case when e % 4 = 0 then 'Connecting to upstream service...' end,
           case when e % 9 = 0 then concat('[==========> ] ', (e % 10) * 10, '%') end,
           case when e % 11 = 0 then '' end, case when e % 12 = 0 then '' end, case when e % 13 = 0 then 'INFO' end,
           case when e % 17 = 0 then '3 rows in set' end, case when e % 19 = 0 then '    at com.foo.Bar(x)' end,
           case when e % 23 = 0 then '-----' end, case when e % 29 = 0 then '2024-01-15 10:30:45' end]) as line
  from ev),
lines as (select doc_id, row_number() over (partition by doc_id order by e, k0) - 1 as pos, line from l where line is not null)"""
_TABLE_SQL = """
lines as (select event_id // 100 as doc_id, event_id % 100 as pos,
    case when event_id % 20 = 7 then concat('plain ', event_type) else concat('| ', user_id, ' | ', event_type, ' |') end as line from events)"""
_STEP_SQL = """
lines as (select event_id // 100 as doc_id, event_id % 100 as pos,
    concat('Step ', event_id, ': inspecting the ', event_type, ' latency of this service and comparing it against the known baseline of last week.') as line
  from events where event_id % 10 = 0)"""
_SCAN_SQL = """
h as (select *, concat('10.0.', event_id // 250, '.', event_id % 250) as host from events),
lines as (select event_id // 100 as doc_id, event_id % 100 as pos, case event_type when 'click' then concat(host, ' port 22 open')
    when 'view' then concat('Reflected XSS at https://x.local/p?id=', user_id)
    when 'purchase' then concat('SQL injection https://x.local/i?id=', user_id, ' CVE-2024-', event_id % 50 + 1000)
    when 'signup' then concat('weak password for user ', user_id)
    when 'error' then concat('outdated component on ', host) else concat('note ', event_type) end as line from h)"""
_DOC_LINES = """
x as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
lines as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from x)"""
_STRIP = lambda c: f"regexp_replace({c}, '^{P.WS}+|{P.WS}+$', '', 'g')"


def _case_sql(config: NoiseConfig) -> str:
    on = [(label, P.re2(p, fold_)) for label, key, fold_, p in P.NOISE if getattr(config, key)] + [(label, P.re2(p)) for p, label in config.extra_patterns]
    return "case " + " ".join(f"when regexp_matches(line, '{p}') then '{label}'" for label, p in on) + " end"


def _noise_sql(source: str, config: NoiseConfig) -> str:
    return f"""{source},
b as (select *, regexp_full_match(line, '{P.WS}*') as blank from lines),
p as (select *, coalesce(lag(blank) over (partition by doc_id order by pos), false) as before from b),
coded as (select doc_id, pos, line, case when blank then (case when before then 'blank_line' end) else {_case_sql(config)} end as code from p)"""


# --- lines and tokens ----------------------------------------------------------------------------------


@query
def line_explode_count(spark, sf):
    each = docs(spark, sf).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


ORACLE_SQL["line_explode_count"] = f"with {_DOC_LINES} select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars from lines group by doc_id"


@query
def line_roundtrip(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.unlines(X.lines(F.col("text")))).alias("digest"))


ORACLE_SQL["line_roundtrip"] = "select doc_id, md5(text) as digest from documents"


@query
def heuristic_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("n_tokens"), F.lit("heuristic").alias("backend"))


ORACLE_SQL["heuristic_tokens"] = f"select doc_id, len(regexp_extract_all(text, '{P.re2(P.TOKEN)}'))::bigint as n_tokens, 'heuristic' as backend from documents"


# --- noise ------------------------------------------------------------------------------------------------


def _noise_counts(df: DataFrame, config: NoiseConfig) -> DataFrame:
    done = noise.filter_noise(df, "text", "details", config)
    return done.select("doc_id", F.explode_outer("details").alias("label", "n")).where("label is not null")


def _noise_counts_sql(source: str, config: NoiseConfig) -> str:
    return f"with {_noise_sql(source, config)} select doc_id, code as label, count(*) as n from coded where code is not null group by all"


_EXTRA = NoiseConfig(extra_patterns=[(r"(?i)all rights reserved", "license"), (r"^[A-Z]", "capital")])
_LEVELS = NoiseConfig(drop_log_levels=True)
_NO_RULES = NoiseConfig(drop_timestamps=False, drop_progress_bars=False, drop_separators=False, drop_status_messages=False, drop_stack_trace_frames=False)


@query
def noise_label_counts(spark, sf):
    return _noise_counts(log_text(spark, sf), NoiseConfig())


ORACLE_SQL["noise_label_counts"] = _noise_counts_sql(_LOG_SQL, NoiseConfig())


@query
def noise_filter_text(spark, sf):
    return noise.filter_noise(log_text(spark, sf), "text", "details").select("doc_id", "text")


ORACLE_SQL["noise_filter_text"] = f"with {_noise_sql(_LOG_SQL, NoiseConfig())} select doc_id, string_agg(line, chr(10) order by pos) as text from coded where code is null group by doc_id"


@query
def noise_log_level_optin(spark, sf):
    return _noise_counts(log_text(spark, sf), _LEVELS)


ORACLE_SQL["noise_log_level_optin"] = _noise_counts_sql(_LOG_SQL, _LEVELS)


@query
def noise_extra_pattern(spark, sf):
    return _noise_counts(docs(spark, sf), _EXTRA)


ORACLE_SQL["noise_extra_pattern"] = _noise_counts_sql(_DOC_LINES, _EXTRA)


@query
def blank_run_collapse(spark, sf):
    return noise.filter_noise(log_text(spark, sf), "text", "details", _NO_RULES).select("doc_id", "text", F.coalesce(F.col("details")[noise.BLANK], F.lit(0)).alias("removed"))


ORACLE_SQL["blank_run_collapse"] = f"""
with {_LOG_SQL}, p as (select *, line = '' and coalesce(lag(line) over (partition by doc_id order by pos), 'x') = '' as gone from lines)
select doc_id, string_agg(line, chr(10) order by pos) filter (where not gone) as text, count(*) filter (where gone) as removed from p group by doc_id"""


# --- detail -------------------------------------------------------------------------------------------------


@query
def log_prefix_strip(spark, sf):
    return trim.strip_log_prefix(log_text(spark, sf), "text", "changed").select("doc_id", "text", "changed")


ORACLE_SQL["log_prefix_strip"] = f"""
with {_LOG_SQL}, c as (select *, regexp_replace(line, '{P.re2(P.LOG_PREFIX, True)}', '') as new from lines)
select doc_id, string_agg(new, chr(10) order by pos) as text, count(*) filter (where new <> line) as changed from c group by doc_id"""


@query
def table_run_trim(spark, sf):
    return trim.trim_tables(table_text(spark, sf), "text", "hidden", 12).select("doc_id", "text", "hidden")


ORACLE_SQL["table_run_trim"] = f"""
with {_TABLE_SQL}, r as (select *, regexp_matches(line, '{P.re2(P.TABLE_ROW)}') as is_row from lines),
g as (select *, pos - row_number() over (partition by doc_id, is_row order by pos) as island from r),
n as (select *, row_number() over (partition by doc_id, is_row, island order by pos) as k, count(*) over (partition by doc_id, is_row, island) as size from g),
o as (select doc_id, pos, case when is_row and k = 13 then concat('… (+', size - 12, ' more rows)') else line end as line from n where not is_row or k <= 13),
s as (select doc_id, sum(size - 12)::bigint as hidden from n where is_row and k = 13 group by doc_id)
select o.doc_id, string_agg(line, chr(10) order by pos) as text, coalesce(any_value(hidden), 0)::bigint as hidden from o left join s on o.doc_id = s.doc_id group by o.doc_id"""


@query
def long_string_trim(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    return trim.trim_literals(pages, "text", "trimmed", 10, 5).select("page_id", "text", "trimmed")


_LIT = P.LITERAL_RE2.replace("'", "''")
ORACLE_SQL["long_string_trim"] = f"""
with f as (select page_id, regexp_extract_all(html, '{_LIT}') as q, string_split(regexp_replace(html, '{_LIT}', chr(31), 'g'), chr(31)) as r from pages),
c as (select *, list_transform(q, lambda x: case when length(x) - 2 > 10 then concat('"', x[2:6], '… [+', length(x) - 7, ' chars]"') else x end) as n from f)
select page_id, array_to_string(list_transform(range(len(r)), lambda i: concat(r[i + 1], coalesce(n[i + 1], ''))), '') as text,
       len(list_filter(q, lambda x: length(x) - 2 > 10))::bigint as trimmed from c"""


# --- phrases --------------------------------------------------------------------------------------------------


@query
def phrase_split_stats(spark, sf):
    each = phrases.explode_phrases(docs(spark, sf), "doc_id", "text")
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_phrases"), F.count(F.when(F.length("norm") >= 20, 1)).alias("n_long"), F.sum(F.length("norm")).cast("long").alias("chars"))


_PHRASES = f"""
ph as (select doc_id, pos, string_split(regexp_replace(line, '({P.STOP}){P.WS}+', '\\1' || chr(31), 'g'), chr(31)) as a from lines where not regexp_full_match(line, '{P.WS}*')),
each as (select doc_id, pos, unnest(range(len(a))) as spos, unnest(a) as phrase from ph),
normed as (select doc_id, pos, spos, phrase, regexp_replace(lower({_STRIP('phrase')}), '{P.WS}+', ' ', 'g') as norm from each)"""
ORACLE_SQL["phrase_split_stats"] = f"with {_DOC_LINES},{_PHRASES} select doc_id, count(*) as n_phrases, count(*) filter (where length(norm) >= 20) as n_long, sum(length(norm))::bigint as chars from normed group by doc_id"

_CONV_LINES = """
x as (select conv_id as doc_id, string_split(string_agg(text, chr(10) order by turn, role, text), chr(10)) as a from conversations where text is not null group by conv_id),
lines as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from x)"""


@query
def phrase_exact_dedup(spark, sf):
    """First occurrences only, by a window: what the fold does where nothing merely resembles."""
    from pyspark.sql import Window

    each = phrases.explode_phrases(conversation_text(spark, sf), "doc_id", "text").where(F.length("norm") >= 20)
    first = F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy("pos", "spos"))
    return each.withColumn("k", first).groupBy("doc_id").agg(F.count(F.when(F.col("k") > 1, 1)).alias("removed"), F.count(F.when(F.col("k") == 1, 1)).alias("kept"))


ORACLE_SQL["phrase_exact_dedup"] = f"""
with {_CONV_LINES},{_PHRASES}, k as (select doc_id, row_number() over (partition by doc_id, norm order by pos, spos) as k from normed where length(norm) >= 20)
select doc_id, count(*) filter (where k > 1) as removed, count(*) filter (where k = 1) as kept from k group by doc_id"""


@query
def phrase_fuzzy_dedup(spark, sf):
    return phrases.remove_repeats(conversation_text(spark, sf), "text", "details").select("doc_id", "text", F.col("details")["phrases_removed"].alias("removed"))


@query
def near_pair_candidates(spark, sf):
    return phrases.candidate_pairs(step_text(spark, sf), "doc_id", "text")


ORACLE_SQL["near_pair_candidates"] = f"""
with {_STEP_SQL},{_PHRASES}, n as (select distinct doc_id, norm, list_distinct(string_split(norm, ' ')) as w, length(norm) as l from normed where length(norm) >= 20)
select a.doc_id, a.norm as first, b.norm as second from n a join n b on a.doc_id = b.doc_id and a.norm < b.norm
where abs(a.l - b.l) / greatest(a.l, b.l)::double <= 1.0::double - 0.9::double
  and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double >= 0.8::double"""


# --- duplicate lines -----------------------------------------------------------------------------------------


def _dedup_sql(annotate: bool) -> str:
    text = "case when k = '' then '' when n > 1 then concat(line, '  [x', n, ']') else line end" if annotate else "case when k = '' then '' else line end"
    return f"""
with {_DOC_LINES}, s as (select *, {_STRIP("line")} as k from lines),
c as (select *, count(*) over (partition by doc_id, k) as n, row_number() over (partition by doc_id, k order by pos) as r from s),
o as (select doc_id, pos, {text} as line, n, k from c where r = 1 or k = '')
select doc_id, string_agg(line, chr(10) order by pos) as text, sum(case when k = '' then 0 else n - 1 end)::bigint as removed from o group by doc_id"""


@query
def line_exact_dedup(spark, sf):
    return dedup.drop_exact(docs(spark, sf), "text", "removed").select("doc_id", "text", "removed")


@query
def line_exact_dedup_plain(spark, sf):
    return dedup.drop_exact(docs(spark, sf), "text", "removed", annotate=False).select("doc_id", "text", "removed")


ORACLE_SQL["line_exact_dedup"] = _dedup_sql(True)
ORACLE_SQL["line_exact_dedup_plain"] = _dedup_sql(False)


@query
def line_near_dedup(spark, sf):
    return dedup.drop_near(docs(spark, sf), "text", "removed").select("doc_id", "text", "removed")


# --- summaries --------------------------------------------------------------------------------------------------


@query
def term_frequency(spark, sf):
    return rank.document_terms(docs(spark, sf), "doc_id", "text")


_SENTENCES = f"""
sp as (select doc_id, string_split(regexp_replace(text, '([.!?。！？\\n]){P.WS}+', '\\1' || chr(31), 'g'), chr(31)) as a from documents where text is not null),
st as (select doc_id, list_filter(list_transform(a, lambda s: {_STRIP("s")}), lambda s: s <> '') as a from sp),
sents as (select doc_id, unnest(range(len(a))) as sid, unnest(a) as sentence from st),
words as (select doc_id, sid, lower(unnest(regexp_extract_all(sentence, '{P.WORD}'))) as term from sents),
tf as (select doc_id, sid, term, count(*) as tf from words where term not in ({", ".join(repr(w) for w in P.STOPWORDS)}) group by all)"""
ORACLE_SQL["term_frequency"] = f"with {_SENTENCES} select doc_id, term, sum(tf)::bigint as tf, count(*) as n_sentences from tf group by all"


@query
def sentence_cosine_edges(spark, sf):
    edges = rank.cosine_edges(docs(spark, sf), "doc_id", "text")
    return edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.floor(F.col("w") * 1000000 + 0.5)).alias("millionths"))


ORACLE_SQL["sentence_cosine_edges"] = f"""
with {_SENTENCES}, n as (select doc_id, sid, sqrt(sum(tf * tf)::double) as norm from tf group by all),
e as (select a.doc_id, a.sid as i, b.sid as j, sum(a.tf * b.tf)::double as dot from tf a join tf b on a.doc_id = b.doc_id and a.term = b.term and a.sid < b.sid group by all)
select e.doc_id, count(*) as n_edges, sum(floor(dot / (x.norm * y.norm) * 1000000 + 0.5)::bigint)::bigint as millionths
from e join n x on x.doc_id = e.doc_id and x.sid = i join n y on y.doc_id = e.doc_id and y.sid = j group by e.doc_id"""


@query
def textrank_scores(spark, sf):
    return rank.rank_scores(docs(spark, sf), "doc_id", "text").select("doc_id", F.col("sid").cast("long").alias("sid"), F.floor(F.col("score") * 1e9 + 0.5).alias("billionths"))


ORACLE_SQL["textrank_scores"] = f"""
with recursive {_SENTENCES}, nodes as (select doc_id, sid, count(*) over (partition by doc_id) as n from sents),
n as (select doc_id, sid, sqrt(sum(tf * tf)::double) as norm from tf group by all),
d as (select a.doc_id, a.sid as i, b.sid as j, sum(a.tf * b.tf)::double as dot from tf a join tf b on a.doc_id = b.doc_id and a.term = b.term and a.sid <> b.sid group by all),
w as (select d.doc_id, i, j, dot / (x.norm * y.norm) as w from d join n x on x.doc_id = d.doc_id and x.sid = i join n y on y.doc_id = d.doc_id and y.sid = j),
e as (select doc_id, i, j, w / sum(w) over (partition by doc_id, i) as share from w union all select doc_id, sid, sid, 0.0::double from nodes),
r as (
  select 0 as turn, doc_id, sid, 1.0::double / n as score from nodes
  union all
  select turn + 1, e.doc_id, e.j, (1 - 0.85::double) / any_value(n.n) + 0.85::double * sum(e.share * r.score)
  from r join e on e.doc_id = r.doc_id and e.i = r.sid join nodes n on n.doc_id = e.doc_id and n.sid = e.j where turn < 30 group by turn, e.doc_id, e.j)
select doc_id, sid::bigint as sid, floor(score * 1e9 + 0.5)::bigint as billionths from r where turn = 30"""


@query
def extractive_summary(spark, sf):
    return rank.summarize(docs(spark, sf), "text", 0.3)


# --- findings ---------------------------------------------------------------------------------------------------


@query
def finding_classify(spark, sf):
    return findings.classify(scan_text(spark, sf), "doc_id", "text").select("doc_id", "label", "severity", "count", F.col("first_pos").cast("long").alias("first_pos"))


_FOUND = f"""{_SCAN_SQL},
c as (select *, case {" ".join(f"when regexp_matches(line, '{P.re2(p, True)}') then '{label}'" for label, _, p in P.RISKS)} end as label from lines),
hits as (select *, case label {" ".join(f"when '{label}' then {sev}" for label, sev, _ in P.RISKS)} end as severity,
  left(coalesce(nullif(regexp_extract(line, '{P.re2(P.URL)}'), ''), nullif(regexp_extract(line, '{P.re2(P.HOST)}', 2), ''), {_STRIP("line")}), 100) as example from c where label is not null)"""
ORACLE_SQL["finding_classify"] = f"with {_FOUND} select doc_id, label, severity, count(*) as count, min(pos) as first_pos from hits group by all"


@query
def finding_examples(spark, sf):
    return findings.classify(scan_text(spark, sf), "doc_id", "text").select("doc_id", "label", F.array_join("examples", " ¦ ").alias("examples"))


ORACLE_SQL["finding_examples"] = f"""
with {_FOUND}, d as (select doc_id, label, example, min(pos) as pos from hits where example <> '' group by all),
r as (select *, row_number() over (partition by doc_id, label order by pos) as k from d)
select doc_id, label, string_agg(example, ' ¦ ' order by pos) as examples from r where k <= 3 group by all"""


@query
def finding_cves(spark, sf):
    each = findings.classify(scan_text(spark, sf), "doc_id", "text")
    return each.where(F.size("cves") > 0).select("doc_id", "label", F.size("cves").cast("long").alias("n_cves"), F.array_join(F.slice("cves", 1, 5), ",").alias("first_five"))


ORACLE_SQL["finding_cves"] = f"""
with {_FOUND}, v as (select distinct doc_id, label, upper(unnest(regexp_extract_all(line, '{P.re2(P.CVE, True)}'))) as cve from hits),
a as (select doc_id, label, list_sort(list(cve)) as l from v group by all)
select doc_id, label, len(l)::bigint as n_cves, array_to_string(l[1:5], ',') as first_five from a"""


@query
def scan_brief(spark, sf):
    return plan.compress_scan(scan_text(spark, sf), "text", 5).select("doc_id", F.col("compressed").alias("brief"))


_ICON = "case severity " + " ".join(f"when {k} then '{i}'" for k, (_, i) in P.SEVERITY.items()) + " end"
_NAME = "case severity " + " ".join(f"when {k} then '{n}'" for k, (n, _) in P.SEVERITY.items()) + " end"
ORACLE_SQL["scan_brief"] = f"""
with {_FOUND}, d as (select doc_id, label, example, min(pos) as pos from hits where example <> '' group by all),
r as (select *, row_number() over (partition by doc_id, label order by pos) as k from d),
x as (select doc_id, label, string_agg(concat(chr(10), '    ', k, '. ', example), '' order by k) as ex, count(*) as n from r where k <= 5 group by all),
v as (select doc_id, label, list_sort(list_distinct(list(cve))) as l from (select doc_id, label, upper(unnest(regexp_extract_all(line, '{P.re2(P.CVE, True)}'))) as cve from hits) group by all),
f as (select doc_id, label, severity, count(*) as n, min(pos) as first_pos from hits group by all),
s as (select f.doc_id, f.severity, f.n, f.first_pos, concat({_ICON}, ' ', f.label, ' [', {_NAME}, ']: ', f.n,
    case when v.l is null then '' else concat('  (', array_to_string(v.l[1:5], ', '), ')') end, coalesce(x.ex, ''),
    case when f.n > coalesce(x.n, 0) then concat(chr(10), '    … and ', f.n - coalesce(x.n, 0), ' more') else '' end) as section
  from f left join v on f.doc_id = v.doc_id and f.label = v.label left join x on f.doc_id = x.doc_id and f.label = x.label),
b as (select doc_id, concat('{findings.TITLE}', chr(10), chr(10), 'Detected ', sum(n)::bigint, ' findings across ', count(*), ' categories.', chr(10), chr(10),
    string_agg(section, chr(10) || chr(10) order by severity, n desc, first_pos), chr(10)) as brief from s group by doc_id)
select a.doc_id, coalesce(brief, concat('{findings.TITLE}', chr(10), 'No recognizable findings detected.')) as brief from (select distinct doc_id from lines) a left join b on a.doc_id = b.doc_id"""


# --- JSON -------------------------------------------------------------------------------------------------------


@query
def json_reshape(spark, sf):
    return jsonshape.reshape(json_text(spark, sf), "text", "ok", TrimConfig(max_list_items=5))


@query
def json_compress(spark, sf):
    return _flat(plan.compress_json(json_text(spark, sf)))


# --- the whole pipeline -----------------------------------------------------------------------------------------


def _flat(done: DataFrame, key: str = "doc_id") -> DataFrame:
    s = lambda c: F.col(f"stats.{c}").alias(c)
    names = F.array_join(F.transform("stats.stages", lambda x: F.concat(x["name"], F.lit(":"), x["chars_after"].cast("string"))), ",")
    return done.select(key, "compressed", s("original_chars"), s("compressed_chars"), s("original_tokens"), s("compressed_tokens"), s("reduction_pct"), names.alias("stages"))


@query
def compress_default(spark, sf):
    return _flat(plan.compress(docs(spark, sf)))


@query
def compress_aggressive(spark, sf):
    return _flat(plan.compress(docs(spark, sf), config=CompressionConfig.aggressive()))


@query
def compress_conservative(spark, sf):
    return _flat(plan.compress(docs(spark, sf), config=CompressionConfig.conservative()))


@query
def compress_rules_only_no_fuzzy(spark, sf):
    done = plan.compress(log_text(spark, sf), config=CompressionConfig(enable_pattern_remover=False))
    return done.select("doc_id", "compressed", F.col("stats.original_tokens").alias("original_tokens"), F.col("stats.compressed_tokens").alias("compressed_tokens"))


ORACLE_SQL["compress_rules_only_no_fuzzy"] = f"""
with {_noise_sql(_LOG_SQL, NoiseConfig())},
kept as (select doc_id, pos, regexp_replace(line, '{P.re2(P.LOG_PREFIX, True)}', '') as line from coded where code is null),
s as (select *, {_STRIP("line")} as k from kept),
c as (select *, count(*) over (partition by doc_id, k) as n, row_number() over (partition by doc_id, k order by pos) as r from s),
o as (select doc_id, string_agg(case when k = '' then '' when n > 1 then concat(line, '  [x', n, ']') else line end, chr(10) order by pos) as compressed from c where r = 1 or k = '' group by doc_id),
w as (select doc_id, string_agg(line, chr(10) order by pos) as text from lines group by doc_id)
select w.doc_id, coalesce(compressed, '') as compressed, len(regexp_extract_all(text, '{P.re2(P.TOKEN)}'))::bigint as original_tokens,
       len(regexp_extract_all(coalesce(compressed, ''), '{P.re2(P.TOKEN)}'))::bigint as compressed_tokens
from w left join o on w.doc_id = o.doc_id"""


@query
def stage_report(spark, sf):
    config = CompressionConfig(enable_pattern_remover=False, enable_detail_trim=False, redundancy=RedundancyConfig(annotate_duplicate_counts=False))
    each = plan.compress(docs(spark, sf), config=config).select("doc_id", F.explode_outer("stats.stages").alias("s"))
    return each.where("s is not null").select("doc_id", F.col("s.name").alias("stage"), F.col("s.chars_before").cast("long").alias("chars_before"), F.col("s.chars_after").cast("long").alias("chars_after"))


ORACLE_SQL["stage_report"] = f"""
with {_noise_sql(_DOC_LINES, NoiseConfig())},
n0s as (select doc_id, length(text) as n0 from documents where text is not null),
n1s as (select doc_id, sum(length(line)) + count(*) - 1 as n1 from coded where code is null group by doc_id),
s as (select doc_id, pos, line, {_STRIP("line")} as k from coded where code is null),
c as (select *, row_number() over (partition by doc_id, k order by pos) as r from s),
n2s as (select doc_id, sum(case when k = '' then 0 else length(line) end) + count(*) - 1 as n2 from c where r = 1 or k = '' group by doc_id),
e as (select n0s.doc_id, n0::bigint as n0, coalesce(n1, 0)::bigint as n1, coalesce(n2, 0)::bigint as n2 from n0s left join n1s on n0s.doc_id = n1s.doc_id left join n2s on n0s.doc_id = n2s.doc_id)
select doc_id, 'noise' as stage, n0 as chars_before, n1 as chars_after from e union all select doc_id, 'redundancy', n1, n2 from e"""


@query
def conversation_compress(spark, sf):
    return compress_nodes(table(spark, sf, "conversations"))


@query
def document_adapter_stats(spark, sf):
    done = compress_documents(table(spark, sf, "documents"))
    return done.select("doc_id", "lang", "source", F.col("compression.original_tokens").alias("original_tokens"), F.col("compression.compressed_tokens").alias("compressed_tokens"), F.col("compression.reduction_pct").alias("reduction_pct"))


@query
def stream_noise_filter(spark, sf):
    """Rows of the documents' files as a stream, compressed by the rules and written once to a table in the shared folder."""
    import uuid

    path = f"{sf}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)
    base = shared_base(spark)
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    config = CompressionConfig(enable_pattern_remover=False)
    rows = compress_stream(stream, config=config).select("doc_id", "compressed", F.col("stats.compressed_tokens").alias("compressed_tokens"))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(f"{out}-rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}-rows")


