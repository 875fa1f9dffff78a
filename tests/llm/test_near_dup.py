import random
import re
from itertools import combinations

import numpy as np
import pytest

from pithy.llm import near_dup
from pithy.llm.queries import QUERIES
from tests.llm.helpers import ODD_TEXTS, odd_docs


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_query_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.01",):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert result(QUERIES["op7_near_duplicates"](spark, sf)) == brute(rows)


def variants(seed, base_words, n, edits):
    """Texts around one base whose pairs lie on both sides of the threshold."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "edits"), [(120, 6), (12, 2), (40, 5)])
def test_large_group_of_variants(spark, words, edits):
    texts = variants(words, words, 400, edits) + variants(words + 1, words, 60, 2 * edits)
    rows = [(i * 7 % 4001, t) for i, t in enumerate(texts)]
    assert result(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_odd_rows(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(100, "One two"), (101, "one\ttwo "), (102, "one"), (103, "ONE")]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(rows[len(ODD_TEXTS) :], "doc_id long, text string"))
    assert result(near_dup.near_duplicates(docs)) == brute(rows)
    assert near_dup.near_duplicates(docs.where("false")).count() == 0


def test_compressed_registers():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> rng.integers(0, 40, 500).astype(np.uint64)
    for x, got in zip(v.tolist(), near_dup.compress(v).tolist(), strict=True):
        bits = f"{x:064b}"
        zeros = min(len(bits) - len(bits.lstrip("0")), 53)
        rest = (bits[zeros + 1 :] + "0" * 64)[: near_dup.MANTISSA]
        assert got == (zeros << near_dup.MANTISSA) + int(rest, 2)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    for n, j in ((2000, 0.85), (60, 0.85), (2000, 0.0)):
        errors = []
        for _ in range(60):
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - both : 2 * n - both])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree = np.array([(near_dup.sketch_of(a) == near_dup.sketch_of(b)).mean()])
            errors.append(near_dup.estimate(agree, np.array([float(len(a))]), np.array([float(len(b))]))[0] - true)
        assert abs(np.mean(errors)) < 0.02


def test_repeated_and_null_ids_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(7, long), (7, "quite another text of one document"), (9, long + " more"), (8, "Quite another text of one document"), (None, long), (3, "alone here"), (3, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as KEPT", "'x' as component_id", "2 as id", "'s' as sketch")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(0, 0, False), (3, 3, True), (3, 3, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


def test_links_of_blocks_are_a_forest():
    rnd = random.Random(3)
    texts = variants(5, 90, 60, 6)
    sh = near_dup.Shingler()
    sets = [sh.shingles(t.encode()) for t in texts]
    members = [{"id": i, "comp": i, "sketch": near_dup.sketch_of(s).tobytes(), "shingles": s.tobytes()} for i, s in enumerate(sets)]
    rnd.shuffle(members)
    got = [(x["a"], x["b"]) for band in range(near_dup.BANDS) for x in near_dup.links_of(members, members, band)]
    assert all(near_dup.linked(sets[a], sets[b]) for a, b in got)
    top = list(range(60))
    for a, b in got:
        x, y = sorted((top[a], top[b]))
        top = [x if t == y else t for t in top]
    want = brute(list(enumerate(texts)))
    assert top == [want[i][1] for i in range(60)]
