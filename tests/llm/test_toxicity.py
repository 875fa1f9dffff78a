import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pithy.llm import toxicity as tox
from pithy.llm.queries import QUERIES
from tests.llm.helpers import SF, odd_docs


def corpus(n, seed):
    rnd = random.Random(seed)
    calm = [a + b for a in ("ta", "ri", "mo", "len", "sor") for b in ("do", "ka", "nes", "vil", "gum", "pat")]
    out = []
    for i in range(n):
        words = [rnd.choice(calm) for _ in range(rnd.randint(5, 80))]
        if i % 3 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["grubworm", "Grubworms!", "blatherskite", "blatherskites,"]))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    return tox.fit(corpus(600, 1))


def test_held_out_and_unseen_misspellings(model):
    rows = corpus(300, 2)
    got = tox.Scorer(model).score([t for t, _ in rows])
    assert ((got >= 0.5) == np.array([y for _, y in rows])).mean() > 0.97
    bad = tox.Scorer(model).score([f"tado {w} rika monessor lenvil" for w in ("grubwormz", "grubw0rm", "blatherskyte", "BLATHERSKITE")])
    good = tox.Scorer(model).score([f"tado {w} rika monessor lenvil" for w in ("tavil", "sorgum")])
    assert bad.min() > good.max()


def test_best_windows_equal_brute_force():
    rng = np.random.default_rng(3)
    lens = rng.integers(0, 40, 50)
    lens[[0, 7, 49]] = 0
    values = rng.integers(-5, 5, lens.sum()).astype(float)
    best, first, width = tox.best_windows(values, lens)
    at = 0
    for i, n in enumerate(lens):
        part = values[at : at + n]
        w = min(n, tox.WINDOW)
        want = max((part[k : k + w].mean() for k in range(n - w + 1)), default=0.0) if n else 0.0
        assert abs(best[i] - want) < 1e-9
        if n:
            assert abs(values[first[i] : first[i] + width[i]].mean() - want) < 1e-9 and at <= first[i] <= at + n - w
        at += n


def test_odd_rows(spark, model):
    docs = odd_docs(spark).withColumn("SCORE", F.lit("clash"))
    rows = tox.score(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert tox.score(docs.where("false"), model).count() == 0
    one = tox.fit([("a b", 0)] * 3)
    assert tox.Scorer(one).score(["anything", ""]).max() < 1e-9


def test_training_rows(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, None), (3, ""), (4, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (4, 0), (4, None), (5, 7), (None, 1)], "doc_id long, toxic int")
    got = tox.sample(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", rows_per_class=10, max_bytes=100)
    assert got == [("z", 0), ("x y", 1), ("x y", 1)]
    assert tox.sample(docs, labels.where("false"), id_col="doc_id", text_col="text", label_col="toxic", rows_per_class=10, max_bytes=100) == []
    assert tox.fit([]).bias.tolist() == [50.0, -50.0]


def test_query(spark):
    got = QUERIES["op2_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_labels(spark):
    """Recall and precision on labelled rows that weren't learnt; the sample has 349 toxic rows, and 0.82 and 0.88 were measured."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r.predicted and r.toxic for r in got)
    assert caught >= 0.75 * sum(r.toxic for r in got)
    assert caught >= 0.8 * sum(r.predicted for r in got)
