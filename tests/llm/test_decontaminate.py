import gc
import hashlib
import random
import re
import weakref

from pyspark.sql import functions as F

from pithy.llm import decontaminate
from pithy.llm.queries import QUERIES
from tests.llm.helpers import SF, odd_docs


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    lens = {len(k) for k in wins}
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
        items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
        want = brute(docs, items)
        got = {r.doc_id: tuple(r)[1:6] for r in QUERIES["op8_decontaminate"](spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
        assert got == want


def test_odd_rows_and_short_items(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(99, "x, É-Foo bar; foo BAR, baz é", 0, "z")], "doc_id long, text string, N_tokens int, kept string"))
    rows = [("a", "foo bar"), ("a", "Foo  bar"), ("b", "bar foo bar"), ("c", ""), (None, "x"), ("d", None), ("e", "!!"), ("f", "a a a a a a a a a a a")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    for block in (1 << 20, 80):
        found = decontaminate.find_contamination(docs, items, max_block_bytes=block)
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(found).collect()}
        assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [r for r in rows if r[0] and r[1]])
        spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found.collect()}
        assert [docs.where("doc_id = 99").first().text[a:b] for a, b in spans[99]] == ["Foo bar; foo BAR"]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id string, text string")
    assert {r.contaminated for r in decontaminate.digest(decontaminate.find_contamination(odd_docs(spark), items)).collect()} == {False}
    assert decontaminate.find_contamination(odd_docs(spark).where("false"), items).count() == 0


def test_many_blocks_one_automaton(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(300)}é"
    items = [(f"i{k}", " ".join(word() for _ in range(rnd.choice((1, 4, 10, 14, 30))))) for k in range(120)]
    texts = []
    for k in range(150):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w) + 1) : 0] = rnd.choice(items)[1].upper().split()
        texts.append((k, "; ".join(w)))
    docs = spark.createDataFrame([*texts, (200, None)], "doc_id long, text string").withColumn("SPANS", F.lit(1))
    bench = spark.createDataFrame(items, "item_id string, text string")
    alive, most, build = set(), [], decontaminate.load_block

    def one(*args):
        gc.collect()
        most.append(sum(1 for x in alive if x() is not None))
        block = build(*args)
        alive.add(weakref.ref(block))
        return block

    whole = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "load_block", one)
    size = sum(10 * len(t.encode()) + 64 for _, t in items)
    got = decontaminate.find_contamination(docs, bench, max_block_bytes=size // 20)
    assert len(most) >= 20 and max(most) <= 1
    assert {r.doc_id: (r.n_words, r.spans, r["items"]) for r in got.collect()} == whole
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(got).collect()} == brute([*texts, (200, None)], items)
