import json
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pithy.config import CompressionConfig, TrimConfig
from pithy.functions import patterns as P
from pithy.operators import jsonshape, rank
from pithy.plans import queries as base
from tests.plain import compress, near_lines, tokens, without_repeats

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.compressed is not None and r.original_tokens >= 0 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_equals_oracle(spark, duck, name):
    got = base.QUERIES[name](spark, SF)
    want = duck.sql(base.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*cols).collect())))
    assert rows
    assert rows == sorted(map(repr, duck.sql(f"select {', '.join(cols)} from ({base.ORACLE_SQL[name]})").fetchall()))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def checked(got, texts, config):
    assert set(got) == set(texts)
    for i, r in got.items():
        text, stages = compress(texts[i], config)
        assert r.compressed == text
        assert (r.original_chars, r.compressed_chars, r.original_tokens, r.compressed_tokens) == (len(texts[i]), len(text), tokens(texts[i]), tokens(text))
        assert r.stages == ",".join(f"{name}:{n}" for name, n in stages)


def documents(spark):
    return {r.doc_id: r.text for r in base.docs(spark, SF).collect()}


@pytest.mark.parametrize(("name", "config"), [("compress_default", CompressionConfig()), ("compress_aggressive", CompressionConfig.aggressive()), ("compress_conservative", CompressionConfig.conservative())])
def test_compress_queries(spark, name, config):
    checked(by_id(base.QUERIES[name](spark, SF)), documents(spark), config)


def test_json_queries(spark):
    texts = {r.doc_id: r.text for r in base.json_text(spark, SF).collect()}
    small = TrimConfig(max_list_items=5)
    assert {i: (r.text, r.ok) for i, r in by_id(base.json_reshape(spark, SF)).items()} == {i: jsonshape.reshape_text(t, small) for i, t in texts.items()}
    assert any(len(json.loads(t)) > 5 for t in texts.values())
    checked(by_id(base.json_compress(spark, SF)), {i: jsonshape.reshape_text(t, TrimConfig())[0] for i, t in texts.items()}, CompressionConfig())


def test_fold_queries(spark):
    talks = {r.doc_id: r.text for r in base.conversation_text(spark, SF).collect()}
    assert {i: (r.text, r.removed) for i, r in by_id(base.phrase_fuzzy_dedup(spark, SF)).items()} == {i: without_repeats(t, 0.9, 20, 64) for i, t in talks.items()}
    assert {i: (r.text, r.removed) for i, r in by_id(base.line_near_dedup(spark, SF)).items()} == {i: near_lines(t, 0.92, 12) for i, t in documents(spark).items()}
    steps = {r.doc_id: r.text for r in base.step_text(spark, SF).collect()}
    assert sum(without_repeats(t, 0.9, 20, 64)[1] for t in steps.values()) > 0


def test_summary_query(spark):
    texts = documents(spark)
    for i, r in by_id(base.extractive_summary(spark, SF)).items():
        sents = rank.split(texts[i])
        score = rank.scores(sents) if sents else []
        best = sorted(sorted(range(len(sents)), key=lambda k: (-score[k], k))[: max(1, round(len(sents) * 0.3))])
        assert r.text == ("\n".join(sents[k] for k in best) if len(sents) > 2 else texts[i].strip())


def test_adapter_queries(spark):
    config, texts = CompressionConfig(), documents(spark)
    for i, r in by_id(base.document_adapter_stats(spark, SF)).items():
        before, after = tokens(texts[i]), tokens(compress(texts[i], config)[0])
        assert (r.original_tokens, r.compressed_tokens) == (before, after)
        assert math.isclose(r.reduction_pct, round((1 - (after / before if before else 1)) * 100, 1), abs_tol=1e-9)
    before = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    after = base.conversation_compress(spark, SF).collect()
    key = lambda r: (r.conv_id, r.turn, r.role, str(r.text))
    assert sorted((r.conv_id, r.turn, r.role, str(r.text and compress(r.text, config)[0])) for r in before) == sorted(map(key, after))
    narrow = CompressionConfig(enable_pattern_remover=False)
    for i, r in by_id(base.stream_noise_filter(spark, SF)).items():
        want = compress(texts[i], narrow)[0]
        assert (r.compressed, r.compressed_tokens) == (want, tokens(want))


def test_every_query_is_held_against_something():
    tested = {"compress_default", "compress_aggressive", "compress_conservative", "json_reshape", "json_compress", "phrase_fuzzy_dedup", "line_near_dedup", "extractive_summary", "document_adapter_stats", "conversation_compress", "stream_noise_filter"}
    assert set(base.QUERIES) == set(base.ORACLE_SQL) | tested


def test_user_patterns(spark):
    """Python's matches and those of the translated pattern, line by line."""
    lines = ["a b", "İx", "ÉCOLE", "x²", "\x1cz", "[a]&&", "foo_1", "é", "٣ 4", "a]b", "tab\there", "KELVIN K", ""]
    patterns = (r"\bb$", r"^\w+$", r"[\s\d]", r"[^\W\d]", re.compile("école", re.I), r"(?i)kelvin k", r"[[&]", r"\S\s\S", r"(?P<q>o)(?P=q)", r"[]]", re.compile("a . b", re.X), r"\d \d\Z", r"x\Bx|\BX")
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    got = rows.select("x", *[F.col("x").rlike(P.from_user(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for r in got:
        assert [*r][1:] == [bool(re.search(p, r.x)) for p in patterns], r.x
    for p in (re.compile(b"x"), re.compile("x", re.A), r"(a)?(?(1)b|c)"):
        with pytest.raises(ValueError):
            P.from_user(p)


def test_linear_plans(spark, capsys):
    """Each rule stands once in a plan, and a document of 20,000 lines is no matter of minutes."""
    import time

    from pithy.plans import compress as plan

    text = "\n".join(f"line {i % 37} of some text | a" if i % 3 else "" if i % 2 else "Connecting x" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for config in (CompressionConfig(enable_pattern_remover=False), CompressionConfig(enable_pattern_remover=False, enable_detail_trim=False)):
        done = plan.compress(docs, config=config)
        done.explain(True)
        optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        on = sum(getattr(config.noise, key) for _, key, _, _ in P.NOISE) + config.enable_detail_trim
        assert optimized.count("RLIKE") == on + 1  # and the one for blank lines
        start = time.perf_counter()
        assert done.first().stats.compressed_chars > 0
        assert time.perf_counter() - start < 60


def test_metadata_is_merged(spark):
    from pithy.sources.documents import compress_documents

    docs = spark.createDataFrame([("a\na", {"k": "v", "compression": "old"}), ("b", None), (None, {"k": "w"})], "text string, metadata map<string,string>")
    rows = compress_documents(docs).collect()
    assert rows[0].metadata["k"] == "v" and json.loads(rows[0].metadata["compression"])["original_tokens"] == 2
    assert set(rows[1].metadata) == {"compression"} and rows[2].metadata == {"k": "w"}
