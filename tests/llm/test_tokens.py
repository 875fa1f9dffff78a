import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pithy.llm import bpe, lexicon, token_counts
from pithy.llm.queries import QUERIES
from tests.llm.helpers import ODD_TEXTS, SF, odd_docs, plain

WORD, BYTE, PIECE = (lexicon.default_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def expected(path, texts):
    lib = Tokenizer.from_file(path)
    enc = lib.encode_batch([plain(t) for t in texts], add_special_tokens=False)
    return [(e.ids, lib.decode(e.ids, skip_special_tokens=False)) for e in enc]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_decode_equals_library(spark, path):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path).collect()}
    for i, (ids, text) in enumerate(expected(path, ODD_TEXTS)):
        assert got[i].ids == ids, ODD_TEXTS[i][:40]
        assert got[i].decoded == text
    assert got[0].kept == "clash"


def test_encoder_given_back(spark):
    docs = odd_docs(spark).repartition(3)
    kept, given = ({r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(docs, WORD, keep=k).collect()} for k in (True, False))
    assert kept == given


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pair_index_on_random_text(path):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aab eé'st1\n ") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    b = bpe.Bpe(path)
    assert [[i for ids in row for i in ids] for row in b.encode(texts)] == [e[0] for e in expected(path, texts)]


def test_many_small_indices_equal_library(spark, monkeypatch):
    b, sizes = bpe.Bpe(WORD), []
    run = b.index.run
    monkeypatch.setattr(b.index, "run", lambda start: sizes.append(int((start == -1).sum())) or run(start))
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}word\u00e9" for k in range(5000)]
    texts = ["", " ".join(words), "caf\u00e9, <|endoftext|>x \u1e9e'S a\u0301 12", None, " ".join(["again", *words[::-1]])]
    flat, size = b.encode_flat([plain(t) for t in texts])
    want = [ids for ids, _ in expected(WORD, texts)]
    assert [r.tolist() for r in bpe.np.split(flat, bpe.np.cumsum(size)[:-1])] == want
    assert sum(sizes) > 5000 and max(sizes) <= bpe.INDEX_TOKENS  # many indices, each near the processor
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode_decode(docs, WORD).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in got] == expected(WORD, texts)


def test_decode_column(spark):
    docs = odd_docs(spark)
    back = docs.withColumn("ids", bpe.encode_column(docs, BYTE)).withColumn("back", bpe.decode_column(BYTE, F.col("ids"))).collect()
    assert [r.back for r in back] == [plain(r.text) for r in back]


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_counts(spark, path):
    got = [r.n for r in token_counts.count_tokens(odd_docs(spark), path, out_col="n").orderBy("doc_id").collect()]
    lib, _ = lexicon.load(path)
    if path.endswith(".model"):
        assert got == [len(lib.encode(plain(t))) for t in ODD_TEXTS]
    else:
        assert got == [len(e[0]) for e in expected(path, ODD_TEXTS)]


def test_clashing_name_is_replaced(spark):
    out = token_counts.count_tokens(odd_docs(spark), WORD)
    assert [c for c in out.columns if c.lower() == "n_tokens"] == ["n_tokens"]


def test_empty_table(spark):
    assert token_counts.count_tokens(odd_docs(spark).where("false"), WORD).count() == 0
    assert bpe.encode_decode(odd_docs(spark).where("false"), WORD).count() == 0


def test_queries_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = expected(WORD, [d.text for d in docs])
    op5 = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, SF).collect()}
    op6 = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, (ids, text) in zip(docs, want, strict=True):
        assert (op5[d.doc_id].n_tokens, op5[d.doc_id].ids_sha256, op5[d.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
        assert (op6[d.doc_id].n_bytes, op6[d.doc_id].n_tokens) == (len(plain(d.text).encode()), len(ids))
        assert op6[d.doc_id].over_limit == (len(ids) > 2048)
