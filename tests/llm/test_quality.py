import re
from collections import Counter

from pithy.llm import quality
from pithy.llm.queries import QUERIES
from tests.llm.helpers import SF, odd_docs


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_query_equals_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_quality_rules"](spark, SF).collect():
        n, chars, symbols, lines, rep = want = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.ledger(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.doc_id])
    assert quality.ledger(docs.where("false")).count() == 0


def test_policies_and_ablation(spark):
    led = quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    rows = led.collect()
    for policy, names in quality.POLICIES.items():
        want = quality.mask(policy)
        assert quality.apply_policy(led, policy).where("kept").count() == sum(not r.fail_bits & want for r in rows)
        for r in quality.ablation(led, policy).collect():
            bit = quality.BIT[r.rule]
            assert r.rule in names
            assert r.fails == sum(bool(x.fail_bits & bit) for x in rows)
            assert r.drops_alone == sum(x.fail_bits & want == bit for x in rows)
            assert r.kept_without == sum(not x.fail_bits & want & ~bit for x in rows)


def test_no_python_in_plan(spark, capsys):
    quality.ledger(odd_docs(spark)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
