from pyspark.sql import functions as F

import corpus_pipeline
from pithy.llm.tables import shared_dir, written
from tests.llm import test_decontaminate, test_near_dup, test_suffix_dedup
from tests.llm.helpers import odd_docs
from tests.llm.test_tokens import WORD, expected

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, SF), f"{folder}/{k}")
        if k < 4:
            assert docs.columns == before.columns
        steps[name] = (before.collect(), docs.collect())
    before, after = steps["language ID"]
    assert len(after) >= 0.99 * len(before)
    before, after = steps["MinHash near-dedup"]
    want = test_near_dup.brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, _, kept) in want.items() if kept)
    before, after = steps["suffix-array dedup"]
    late, _ = test_suffix_dedup.brute([(r.doc_id, r.text) for r in before])
    text = {r.doc_id: r.text for r in after}
    assert all(r.n_chars == len(r.text) for r in after)
    for r in before:
        if r.doc_id not in late:
            assert text[r.doc_id] == r.text
        elif r.doc_id in text:
            n = len(test_suffix_dedup.words(r.text))
            assert len(test_suffix_dedup.words(text[r.doc_id])) <= n - 0.9 * len(late[r.doc_id])
    before, after = steps["benchmark decontamination"]
    items = [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = test_decontaminate.brute([(r.doc_id, r.text) for r in before], items)
    assert sorted(r.doc_id for r in after) == sorted(i for i, x in hit.items() if not x[4])
    before, after = steps["BPE encoding and decoding"]
    before.sort(key=lambda r: r.doc_id)
    after.sort(key=lambda r: r.doc_id)
    assert [r.ids for r in after] == [e[0] for e in expected(WORD, [r.text for r in before])]


def test_odd_rows(spark):
    docs = odd_docs(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 14
    assert corpus_pipeline.identify_language(spark, odd_docs(spark).withColumn("lang", F.lit(None).cast("string")), SF).count() == 0


def test_cut_stage_exactly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    after = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    late, _ = test_suffix_dedup.brute(rows)
    for i, t in rows:
        left = [w for k, w in enumerate(test_suffix_dedup.words(t)) if k not in late.get(i, ())]
        if i in late and not left:
            assert i not in after
        else:
            assert test_suffix_dedup.words(after[i]) == left
