import zlib

import numpy as np
from pyspark.sql import functions as F

from pithy.llm import language_id as lid
from pithy.llm.queries import QUERIES
from tests.llm.helpers import SF, odd_docs

ROWS = [("en", "the cat and the dog went to the house with the other one " * 3), ("de", "der hund und die katze gehen in das haus mit dem anderen " * 3)] * 12


def slow_prob(counts, letters):
    """Interpolated Kneser-Ney by the textbook over dictionaries; returns p(char, context)."""
    grams = [{} for _ in range(lid.ORDER + 1)]
    left = [{} for _ in range(lid.ORDER + 1)]
    for w, n in counts.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for k in range(1, min(lid.ORDER, i + 1) + 1):
                g = s[i - k + 1 : i + 1]
                if k == lid.ORDER or i - k + 1 == 0:
                    grams[k][g] = grams[k].get(g, 0) + n
                else:
                    left[k].setdefault(g, set()).add(s[i - k])
                    grams[k].setdefault(g, 0)
    for k in range(1, lid.ORDER + 1):
        for g, before in left[k].items():
            grams[k][g] += len(before)

    def p(char, context):
        k = len(context) + 1
        lower = 1 / letters if k == 1 else p(char, context[1:])
        mine = {g: c for g, c in grams[k].items() if g[:-1] == context}
        if not mine:
            return lower
        n1, n2 = (sum(1 for c in grams[k].values() if c == x) for x in (1, 2))
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        d_top = min(d, min(grams[k].values()))
        total = sum(mine.values())
        return max(mine.get(context + char, 0) - d, 0) / total + min(1.0, d_top * len(mine) / total) * lower

    return p


def test_word_scores_equal_textbook():
    counts = lid.bag([t for lang, t in ROWS if lang == "en"])
    letters = 20
    model = lid.Model(["en"], [lid.fit_language(counts, letters)], letters, np.zeros(1), np.ones(1))
    p = slow_prob(counts, letters)
    for word in ("the", "cat", "house", "zebra", "x", "theother"):
        s = f" {word} "
        want = sum(np.log(p(s[i], s[max(0, i - lid.ORDER + 1) : i])) for i in range(1, len(s)))
        got = lid.word_scores(model, ["dog", word, "dog"])[1]
        assert abs(got[0] - want) < 1e-9 and got[1] == len(word) + 1


def test_probabilities_sum_to_one():
    counts = lid.bag([t for lang, t in ROWS if lang == "en"])
    chars = sorted({c for w in counts for c in w} | {" "})
    p = slow_prob(counts, len(chars))
    for context in ("", " ", " t", "the", "zz"):
        assert abs(sum(p(c, context) for c in chars) - 1) < 0.05


def test_odd_rows(spark):
    model = lid.fit(ROWS)
    got = {r.doc_id: r for r in lid.identify(odd_docs(spark), model).collect()}
    for i in range(4):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[12].lang_pred in ("en", "de") and not [r for r in got.values() if not 0 <= r.score <= 1]
    assert got[10].rejected  # another script
    assert got[13].lang_pred == got[14].lang_pred
    assert lid.identify(odd_docs(spark).where("false"), model).count() == 0


def test_no_labels(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    model = lid.train(docs)
    assert {r.lang_pred for r in lid.identify(docs, model).collect()} == {"und"}


def test_sample_is_bounded_under_repeated_rows(spark):
    docs = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("the same row").alias("text"), F.lit("en").alias("lang"))
    assert len(lid.sample(docs, id_col="doc_id", text_col="text", lang_col="lang", rows_per_language=50, max_languages=4)) <= 50


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.97 * len(out)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert QUERIES["op1_language_id"](spark, SF).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
