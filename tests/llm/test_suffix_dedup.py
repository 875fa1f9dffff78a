import random

import numpy as np
from pyspark.sql import functions as F

from pithy.llm import suffix_dedup as sd
from pithy.llm.queries import QUERIES
from tests.llm.helpers import ODD_TEXTS, odd_docs


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows, size=sd.MIN_WORDS):
    """Words of each document that lie in a run of ``size`` words which an earlier document has, and the words that any other has."""
    runs = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            runs.setdefault(tuple(w[p : p + size]), set()).add(i)
    late, any_ = {}, {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            ids = runs[tuple(w[p : p + size])]
            if min(ids) < i:
                late.setdefault(i, set()).update(range(p, p + size))
            if len(ids) > 1:
                any_.setdefault(i, set()).update(range(p, p + size))
    return late, any_


def found(df):
    out = {}
    for r in df.collect():
        for s in r.spans:
            out.setdefault(r.doc_id, set()).update(range(s.start, s.end))
            assert s.src < r.doc_id
    return out


def planted(seed, n=120, nested=True):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    shared = [[word() for _ in range(k)] for k in (49, 50, 51, 60, 90, 200)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1) if nested else rnd.choice((0, len(w)))
            w[at:at] = rnd.choice(shared)
        rows.append((i * 13 % 997, " ".join(w)))
    return [*rows, *[(2000 + i, rows[i][1]) for i in range(5)]]


def test_planted_passages(spark):
    for seed in (1, 2):
        rows = planted(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        late, _ = brute(rows)
        got = found(sd.passages(docs))
        assert got == late


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    late, any_ = brute(rows)
    got = {}
    for r in QUERIES["op10_suffix_dedup"](spark, sf).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert set(got) == set(late)
    assert all(got[i] <= any_[i] for i in got)
    lost = sum(len(late[i] - got[i]) for i in late)
    assert lost <= 0.01 * sum(map(len, late.values()))


def test_no_passage_is_lost(spark):
    rows = planted(3, nested=False)  # else a cut may join the halves of another passage
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    after = {r.doc_id: r.text for r in sd.cut_passages(docs).collect()}
    assert {w for _, t in rows for w in words(t)} == {w for t in after.values() for w in words(t)}
    left, _ = brute([(i, t) for i, t in after.items()])
    assert not left


def test_each_text_is_read_and_cut_once(spark, monkeypatch):
    plans, write = [], sd.written
    monkeypatch.setattr(sd, "written", lambda df, path: plans.append(df) or write(df, path))
    plans.append(sd.cut_passages(spark.createDataFrame(planted(3, nested=False), "doc_id long, text string")))
    calls = [df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [") for df in plans]
    assert calls.count(1) == 3 and max(calls) == 1  # anchors, merged spans, cut texts; a filter must not evaluate them again


def test_minimisers_cover_each_window():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    pos, _ = sd.minimisers(w)
    assert all(((pos >= p) & (pos <= p + sd.MIN_WORDS - sd.GRAM)).any() for p in range(len(w) - sd.MIN_WORDS + 1))


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("spans", F.lit(7))
    assert found(sd.passages(docs)) == {}
    assert {r.doc_id for r in sd.cut_passages(docs).collect()} == set(range(len(ODD_TEXTS)))
    long = " ".join(f"v{i}" for i in range(60))
    more = spark.createDataFrame([(1, long), (2, long.upper()), (None, long), (3, "x"), (4, "x")], "doc_id long, text string")
    assert found(sd.passages(more)) == {2: set(range(60))}
    assert sd.passages(docs.where("false")).count() == 0


def with_footer(seed, n=600):
    """A 20-word footer in most rows; some share the 34 words before it too, and what follows it differs."""
    rnd = random.Random(seed)
    some = lambda k: [f"w{rnd.randrange(10**6)}" for _ in range(k)]
    footer, shared = some(20), [some(34) for _ in range(60)]
    rows = []
    for i in range(n):
        w = some(rnd.randrange(20, 80))
        if rnd.random() < 0.8:
            w += (rnd.choice(shared) if rnd.random() < 0.4 else []) + footer + some(rnd.choice((0, 3, 60)))
        elif rnd.random() < 0.5:
            w += footer * rnd.randrange(2, 9) + some(3)
        rows.append((i * 7 % 4001, " ".join(w)))
    return rows


def test_grams_across_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for rows in (with_footer(1), planted(4)):
            got = found(sd.passages(spark.createDataFrame(rows, "doc_id long, text string")))
            assert got == brute(rows)[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_grams_of_many_records(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for rows in (with_footer(1), planted(5)):
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            assert found(sd.passages(docs, segment=8, group=16)) == brute(rows)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_whole_table_exactly(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {}
    for r in QUERIES["op10_suffix_dedup"](spark, sf).collect():
        assert r.first_doc_id < r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute(rows)[0]
