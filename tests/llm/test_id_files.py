import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from pithy.llm import id_files, lexicon
from pithy.llm.queries import QUERIES
from pithy.llm.tables import shared_dir
from tests.llm.helpers import SF, odd_docs, plain
from tests.llm.test_tokens import BYTE, expected


def round_trip(blocks):
    blocks = sorted((np.asarray(b, np.int64) for b in blocks), key=lambda b: -len(b))
    back = id_files.decode_blocks(id_files.encode_blocks(blocks), np.array([len(b) for b in blocks]))
    return all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.sampled_from([0, 1, 7, 65535])), min_size=1, max_size=80), min_size=1, max_size=6))
def test_round_trip(blocks):
    assert round_trip(blocks)


def test_long_blocks_and_compression():
    rng = np.random.default_rng(3)
    skewed = rng.zipf(1.5, 4096).clip(0, 50000)
    repeated = np.tile(rng.integers(0, 50000, 37), 120)[:4096]
    assert round_trip([skewed, repeated, np.zeros(4096), np.full(3000, 65535), rng.integers(0, 65536, 4096)])
    sizes = [len(p) for p in id_files.encode_blocks([skewed, repeated])]
    assert sizes[0] < 2 * 4096 and sizes[1] < 0.3 * 2 * 4096
    assert id_files.encode_blocks([]) == [] and id_files.decode_blocks([], np.zeros(0)) == []
    with pytest.raises(ValueError):
        id_files.encode_blocks([np.array([65536])])


def test_joined_crc():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 50))), rng.bytes(int(rng.integers(0, 5000)))
        assert id_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_powers_of_a_length_are_made_once(monkeypatch):
    calls, times = [], id_files._times
    monkeypatch.setattr(id_files, "_times", lambda a, b: calls.append(1) or times(a, b))
    for k in range(200):
        first, second = b"%d" % k, bytes(3996) + b"%04d" % k
        assert id_files.joined_crc(zlib.crc32(first), zlib.crc32(second), 4000) == zlib.crc32(first + second)
    assert len(calls) < 250  # one product for each join


def test_common_pieces_are_not_learnt_again():
    enc = id_files.Encoder(lexicon.default_path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k:x}" for k in range(at, at + 2000)) for at in range(0, 450_000, 2000)]
    first = enc.encode(texts[:1])
    for at in range(0, len(texts), 25):
        enc.encode(texts[at : at + 25])
    enc.learn = lambda pieces: {} if not pieces else pytest.fail("a known piece is learnt again")
    assert enc.encode(texts[:1]) == first and enc.encode(texts[-1:])


def brute(rows):
    out, start = {}, 0
    ids = expected(BYTE, [t for _, t in rows])
    for (i, _), (some, _) in sorted(zip(rows, ids, strict=True), key=lambda x: x[0][0]):
        some = [*some, 2]
        out[i] = (start, len(some), zlib.crc32(np.array(some, "<u4").tobytes()))
        start += len(some)
    return out


def test_query_equals_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_id_files"](spark, SF).collect()}
    assert got == brute(rows)


def test_odd_rows_and_reading_back(spark):
    docs = odd_docs(spark).repartition(3)
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    path = f"{shared_dir(spark)}/ids"
    id_files.write_ids(docs, path, lexicon.default_path("byte_bpe_50k.json"), 2)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in id_files.digest(spark, path).collect()} == brute(rows)
    back = {r.doc_id: r.ids for r in id_files.read_ids(spark, path).collect()}
    want = expected(BYTE, [t for _, t in rows])
    assert back == {i: [*ids, 2] for (i, _), (ids, _) in zip(rows, want, strict=True)}
    broken = f"{path}-broken"
    spark.read.parquet(path).withColumn("crc32", F.col("crc32") + 1).write.parquet(broken)
    with pytest.raises(PythonException):
        id_files.digest(spark, broken).collect()
    empty = f"{path}-empty"
    id_files.write_ids(docs.where("false"), empty, lexicon.default_path("byte_bpe_50k.json"), 2)
    assert id_files.digest(spark, empty).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(5, "b"), (5, "a"), (None, "y"), (None, None), (5, "a"), (1, "c")]
    path = f"{shared_dir(spark)}/ids"
    id_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, lexicon.default_path("byte_bpe_50k.json"), 2)
    ordered = sorted(rows, key=lambda r: (r[0] or -1, r[1] or ""))
    want, start = [], 0
    for (i, _), (ids, _) in zip(ordered, expected(BYTE, [t or "" for _, t in ordered]), strict=True):
        some = [*ids, 2]
        want.append((i, start, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
        start += len(some)
    assert sorted(map(tuple, id_files.digest(spark, path).collect()), key=lambda r: r[1]) == want


def test_pieces_are_learnt_together():
    enc = id_files.Encoder(lexicon.default_path("byte_bpe_50k.json"))
    calls, library = [], enc.ids

    def counted(some):
        calls.append(len(some))
        return library(some)

    enc.ids = counted
    texts = [" ".join(f"wörd{k}a{k % 7}<|endoftext|>" if k % 50 == 0 else f"word{k * 7919}," for k in range(3000)), "  two  blanks \n x \x1c y\x85 z", " lead", "", "漢 字\u3000か な "]
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    assert got == [ids for ids, _ in expected(BYTE, texts)]
    assert sum(calls) < 20  # not one call for each of 3,000 pieces
    enc.width[:] += 1  # ends that don't meet: pieces are encoded one by one, not wrongly cut
    enc.known = lexicon.Table(100)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == got


def test_full_lanes_and_steps_between_models():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3000, 50).repeat(3)
    assert round_trip([np.resize(text, 4096), *[rng.zipf(1.3, n).clip(0, 65535) for n in (4096, 3583, 513, 512, 129, 128, 127, 33, 32, 31, 1)]])
    steps, at = [], 0
    for _ in range(6):
        steps.append(at := id_files._after(at))
    assert steps == [32, 128, 512, 1536, 2560, 3584]  # models of a block of 4,096 are made this often, not for each id
