"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

A block holds at most ``BLOCK`` ids and is coded alone from a reset model, so any block can be read
without the others. Each id is one symbol of 16, and an offset for the last 14:

- 0: the id that followed the last two ids before (order 2), 1: the id that followed the last one
  (order 1), both looked up in small hashed tables with a confidence of 0 to 3;
- 2 to 15: a range of ids; the place in the range follows as plain bits.

Three distributions predict the symbol: order 0 (none), order 1 (range of the id before and
confidence), order 2 (both confidences and whether both tables agree). They are made anew from all
symbols of the block so far at steps that grow apart (32, 128, 512, then every 1,024), the higher
orders resting on order 0 where little was seen, and mixed with weights that follow how well each has
predicted since the last such step. Between two steps they stand still, so the decoder adds two rows of
bounds for each id, and the encoder works on many ids at once. The mixture drives a range coder with
32-bit words. All arithmetic is on integers, so every machine decodes alike. Many blocks are coded in
lockstep, one numpy lane each.

The file format is a table (Parquet, so writing is atomic for each task and any store works) of rows
(shard, block, docs, n_ids, crc32, payload): shards are ranges of ascending document ids, blocks
follow each other in a shard, ``docs`` lists the documents in a block with the number of their ids in
it, ``crc32`` is of the ids as little-endian 32-bit integers and is checked at each reading.

Defined cases: null text is the empty text and has only the end id; rows that repeat an id
follow each other in the order of their texts, and rows without an id come first, so a repeated task
writes the same file; ids of 65,536 and above raise ``ValueError`` (the vocabularies at hand have none);
an empty table gives an empty file; a damaged block raises ``ValueError``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import release, small_batches, text_column, texts
from pithy.llm.lexicon import Table, cutter, load

BLOCK = 4096
#: Blocks coded together; bounds a task's memory at about 35 MB for the models and 45 MB for ids and words.
LANES = 1024
SLOTS = 2048
TABLE_PIECES = 400_000
#: Pieces that the library gets at a time.
JOINED_PIECES = 4096
KEPT_CHARS = 64

# First ids of the 14 ranges; each range's size is a power of two.
EDGES = np.array([0, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 12288, 16384, 24576, 32768, 49152, 65536], np.int64)
BITS = np.concatenate([[0, 0], np.log2(np.diff(EDGES)).astype(np.int64)]).astype(np.uint64)
_ONE_UP = np.concatenate([[0, 0], EDGES[:-1] + 1]).astype(np.uint64)  # first id of a symbol's range, and one
TOTAL, LEAST, WEIGHTS, TRUST = 15, 32, 252, 12  # WEIGHTS << 7 and 16 * LEAST make 1 << TOTAL
_RANGE = np.concatenate([[0], np.searchsorted(EDGES, np.arange(EDGES[-1]), side="right")])  # of an id and one: 1 to 14, 0 for none
_RANGE4, _SYMBOL = (_RANGE * 4).astype(np.int64), (_RANGE + 1).astype(np.int64)
_AGAIN = np.array([1, 2, 3, 3, 0], np.uint32)  # next confidence of a follower that came again, 0 for another
_U = np.uint64
_TOP, _KEEP = _U(1 << 30), _U((1 << 30) - 1)
#: Steps whose symbols are counted together, and blocks whose distributions are made together.
STEPS, GROUP = 128, 64
_BYTES = _U(0x0101010101010101)

ROWS = "shard int, block int, docs array<struct<doc_id:bigint,ord:int,n:int>>, n_ids int, crc32 bigint, payload binary"


def _after(step: int) -> int:
    """The step at which distributions are made next: 32, then four times as far, then every 1,024."""
    return 32 if step < 32 else min(4 * step, step + 1024)


class Model:
    """Predictions for some lanes; encoder and decoder drive it alike. Ids are held with one added, 0 is none."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.follower = np.zeros(2 * lanes * SLOTS, np.uint32)  # order 1, then order 2
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * SLOTS
        self.base1, self.base2 = (np.arange(lanes, dtype=np.int64) * n for n in (64, 32))
        self.seen = [np.zeros((lanes, n, 16), np.int32) for n in (1, 64, 32)]
        self.new = [np.zeros((lanes, n, 16), np.int32) for n in (64, 32)]
        self.new1, self.new2 = (n.reshape(-1) for n in self.new)
        self.odds = [np.full((lanes, n, 16), 1 << TOTAL - 4, np.int32) for n in (1, 64, 32)]
        # lower bounds of symbols, already weighted: orders 0 and 1, order 2
        self.flat1, self.flat2 = (np.zeros(lanes * n * 16 + 1, np.uint16) for n in (64, 32))
        self.rows1, self.rows2 = self.flat1[:-1].reshape(-1, 16), self.flat2[:-1].reshape(-1, 16)
        self.learn()

    def slots(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Places in ``follower`` for the last id and the one before (order 1, order 2)."""
        h = np.empty((2, *p1.shape), np.uint32)
        np.multiply(p1, np.uint32(0x9E3779B1), out=h[0])
        np.multiply(p2, np.uint32(0x85EBCA6B), out=h[1])
        h[1] += h[0]
        h[1] ^= h[1] >> np.uint32(15)
        h[1] *= np.uint32(0x9E3779B1)
        at = (h >> np.uint32(21)).astype(np.int64)
        at += self.base[:, : p1.shape[-1]] if p1.ndim == 1 else self.base[:, None]
        return at

    def follow(self, at: np.ndarray, held: np.ndarray, ids: np.ndarray) -> None:
        """The followers ``held`` at ``at`` become ``ids``."""
        now = ids << np.uint32(2)
        self.follower[at] = now + _AGAIN.take(np.minimum(held - now, np.uint32(4)))

    def contexts(self, p1: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of bounds for order 1 and order 2, and the followers."""
        sure, guess = (held & np.uint32(3)).astype(np.int64), held >> np.uint32(2)
        k = p1.shape[-1]
        one = self.base1[:k] + _RANGE4.take(p1) + sure[0]
        two = self.base2[:k] + sure[1] * 8 + sure[0] * 2 + (guess[0] == guess[1])
        return one, two, guess

    def count(self, one: np.ndarray, two: np.ndarray) -> None:
        """A symbol seen in each lane, as places in the flattened counts."""
        self.new1[one] += 1
        self.new2[two] += 1

    def learn(self) -> None:
        """New distributions from all counts, weighted by the chance that the old ones gave to the symbols counted since."""
        for at in range(0, self.lanes, GROUP):
            some = slice(at, at + GROUP)
            odds, seen, new = ([x[some] for x in xs] for xs in (self.odds, self.seen, self.new))
            new = [new[0].sum(1, dtype=np.int32, keepdims=True), *new]
            skill = np.stack([np.einsum("lcs,lcs->l", a, b, dtype=np.int64) for a, b in zip(new, odds, strict=True)]) + 1
            skill *= skill
            part = (WEIGHTS * skill // skill.sum(0)).astype(np.int32)[:, :, None, None]
            prior = np.full((1, 1, 16), 1 << TOTAL - 4, np.int32)
            for n, old, add in zip(seen, odds, new, strict=True):
                n += add
                old[:] = ((n << TOTAL) + TRUST * prior) // (n.sum(2, dtype=np.int32, keepdims=True) + TRUST)
                prior = odds[0]
            for flat, n, mixed in ((self.rows1, 64, LEAST + ((part[0] * odds[0] + part[1] * odds[1]) >> 8)), (self.rows2, 32, (part[2] * odds[2]) >> 8)):
                rows = flat[at * n : (at + GROUP) * n]
                np.cumsum(mixed.reshape(-1, 16)[:, :15], axis=1, out=rows[:, 1:], dtype=np.uint16)
        for n in self.new:
            n[:] = 0

    def bounds(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds and sizes of symbols, given by their places in the flattened rows."""
        lo = self.flat1.take(one) + self.flat2.take(two)
        size = (self.flat1.take(one + 1) + self.flat2.take(two + 1) - lo) & np.uint16((1 << TOTAL) - 1)
        return lo.astype(np.uint64), size.astype(np.uint64)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of ids (below 65,536), longest first."""
    lanes = len(blocks)
    lens = np.array([len(b) for b in blocks])
    if (np.diff(lens) > 0).any():
        raise ValueError("blocks must be ordered from long to short")
    wide = int(lens[0]) if lanes else 0
    if wide >= 1 << 16:
        raise ValueError("blocks have at most 65,535 ids")
    if any(len(b) and b.max() >= EDGES[-1] for b in blocks):
        raise ValueError("ids of 65,536 and above have no range")
    if not wide:
        return [b""] * lanes
    ids = np.zeros((wide + 2, lanes), np.uint32)  # one added; two rows of none before
    for j, b in enumerate(blocks):
        ids[2 : len(b) + 2, j] = b
        ids[2 : len(b) + 2, j] += np.uint32(1)
    model = Model(lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 62, np.uint64)
    out, at = np.zeros((lanes, wide * 13 // 16 + 5), np.uint64), np.zeros(lanes, np.int64)  # 26 bits an id are enough
    step, turn = 0, _after(0)
    while step < wide:
        end = min(step + STEPS, turn, wide)
        last, now = ids[step + 1 : end + 1], ids[step + 2 : end + 2]
        slots = model.slots(last, ids[step:end])
        held = np.empty(slots.shape, np.uint32)
        for s in range(end - step):
            spot = slots[:, s]
            held[:, s] = model.follower[spot]
            model.follow(spot, held[:, s], now[s])
        one, two, guess = model.contexts(last, held)
        sym = _SYMBOL.take(now)
        sym[now == guess[0]] = 1
        sym[now == guess[1]] = 0
        one = one * 16 + sym
        two = two * 16 + sym
        lo, size = model.bounds(one, two)
        bits = BITS.take(sym)
        off = np.where(sym > 1, now - _ONE_UP.take(sym), _U(0))
        for s in range(end - step):
            k = int(np.searchsorted(-lens, -(step + s), side="left"))
            part, edge = rng[:k] >> _U(TOTAL), low[:k]
            edge += part * lo[s, :k]
            part *= size[s, :k]
            part >>= bits[s, :k]
            edge += part * off[s, :k]
            rng[:k] = part
            model.count(one[s, :k], two[s, :k])
            few = np.flatnonzero(part < _TOP)
            if len(few):
                some, spot = low[few], at[few]
                out[few, spot] = some >> _U(30)
                at[few] = spot + 1
                low[few] = (some & _KEEP) << _U(32)
                rng[few] <<= _U(32)
        step = end
        if step == turn < wide:
            model.learn()
            turn = _after(step)
    every = np.arange(lanes)
    for _ in range(2):
        out[every, at] = low >> _U(30)
        at += 1
        low = (low & _KEEP) << _U(32)
    for c in range(int(at.max()) - 1, 0, -1):  # carries
        out[:, c - 1] += out[:, c] >> _U(32)
    words = out.astype("<u4")
    return [words[j, : at[j]].tobytes() for j in range(lanes)]


def decode_blocks(payloads: list[bytes], lens: np.ndarray) -> list[np.ndarray]:
    """Ids of payloads, longest first."""
    lanes = len(payloads)
    if not lanes:
        return []
    words = np.zeros((lanes, max(map(len, payloads)) // 4 + 3), np.uint32)
    for j, p in enumerate(payloads):
        words[j, : len(p) // 4] = np.frombuffer(p[: len(p) // 4 * 4], "<u4")
    model = Model(lanes)
    rest = (words[:, 0].astype(np.uint64) << _U(30)) | (words[:, 1] >> np.uint32(2)).astype(np.uint64)
    words = (words[:, 1:-1] << np.uint32(30)) | (words[:, 2:] >> np.uint32(2))  # what follows those 62 bits
    final = words.shape[1] - 1
    rng, at = np.full(lanes, 1 << 62, np.uint64), np.zeros(lanes, np.int64)
    wide = int(lens[0])
    ids = np.zeros((wide + 2, lanes), np.uint32)  # one added; two rows of none before
    row = np.arange(lanes, dtype=np.int64) * 16
    step, turn = 0, _after(0)
    while step < wide:
        end = min(turn, wide)
        for s in range(end - step):
            k = int(np.searchsorted(-lens, -(step + s), side="left"))
            last = ids[step + s + 1, :k]
            slots = model.slots(last, ids[step + s, :k])
            held = model.follower[slots]
            first, second, guess = model.contexts(last, held)
            rows = np.empty(k * 16 + 1, np.uint16)
            rows[-1] = 0
            table = rows[:-1].reshape(k, 16)
            np.add(model.rows1.take(first, axis=0), model.rows2.take(second, axis=0), out=table)
            part = rng[:k] >> _U(TOTAL)
            code = rest[:k]
            place = np.minimum(code // part, _U((1 << TOTAL) - 1)).astype(np.uint16)
            below = (table <= place[:, None]).view(np.uint64)
            sym = (((below[:, 0] + below[:, 1]) * _BYTES) >> _U(56)).astype(np.int64) - 1
            spot = row[:k] + sym
            lo = rows.take(spot)
            size = (rows.take(spot + 1) - lo) & np.uint16((1 << TOTAL) - 1)
            code -= part * lo
            part *= size
            bits = BITS.take(sym)
            part >>= bits
            off = np.minimum(code // part, (_U(1) << bits) - _U(1))
            code -= part * off
            now = (_ONE_UP.take(sym) + off).astype(np.uint32)
            np.copyto(now, guess[1], where=sym == 0)
            np.copyto(now, guess[0], where=sym == 1)
            rng[:k] = part
            ids[step + s + 2, :k] = now
            model.follow(slots, held, now)
            model.count(first * 16 + sym, second * 16 + sym)
            few = np.flatnonzero(part < _TOP)
            if len(few):
                spot = at[few]
                rest[few] = (rest[few] << _U(32)) | words[few, np.minimum(spot, final)]
                at[few] = spot + 1
                rng[few] <<= _U(32)
        step = end
        if step == turn < wide:
            model.learn()
            turn = _after(step)
    ids -= np.uint32(1)
    return [ids[2 : n + 2, j].copy() for j, n in enumerate(lens)]


class Encoder:
    """Ids by the library, piece by safe piece, with a bounded table of pieces.

    New pieces that begin with a blank are encoded as texts of many, which the library does in less time than one by
    one; the bytes that each id stands for tell where a piece ends.
    """

    def __init__(self, path: str):
        self.lib, self.kind = load(path)
        self.cut = cutter(self.kind)
        self.known = Table(TABLE_PIECES)
        if self.kind == "blanks":  # one character of a token's name is one byte
            self.width = np.zeros(self.lib.get_vocab_size() + 1, np.int64)
            for name, i in self.lib.get_vocab().items():
                self.width[i] = len(name)
            for i, special in self.lib.get_added_tokens_decoder().items():
                self.width[i] = len(special.content.encode())

    def ids(self, some: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces as little-endian 32-bit integers."""
        out, rest, joined = {}, [], []
        for p in pieces:
            inner = self.kind == "blanks" and len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()
            (joined if inner else rest).append(p)
        for at in range(0, len(joined), JOINED_PIECES):
            some = joined[at : at + JOINED_PIECES]
            (ids,) = self.ids(["".join(some)])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)))
            reached = np.cumsum(self.width[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if len(reached) != cuts[-1] or (reached[cuts - 1] != ends).any():  # an id over an end: one by one
                rest += some
                continue
            flat, cuts = ids.tobytes(), (4 * cuts).tolist()
            out.update(zip(some, map(flat.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        for at in range(0, len(rest), JOINED_PIECES):
            some = rest[at : at + JOINED_PIECES]
            out.update(zip(some, (i.tobytes() for i in self.ids(some)), strict=True))
        return out

    def encode(self, many: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        cut = [self.cut(t) for t in many]
        new = list(self.known.missing(set().union(*cut)))
        table = self.known.young
        table.update(self.learn(new))
        out = [b"".join(map(table.__getitem__, p)) for p in cut]
        for piece in [p for p in new if len(p) > KEPT_CHARS]:
            del table[piece]
        return out


_HELD: dict[str, Encoder] = {}


def _writer(vocab: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocab not in _HELD:
            _HELD.clear()
            _HELD[vocab] = Encoder(vocab)
        enc, shard = _HELD[vocab], TaskContext.get().partitionId()
        held: list[bytes] = []  # ids that wait, with their documents
        owners: list[tuple] = []
        size, number, order = 0, 0, 0
        end = np.array(end_id, "<u4").tobytes()

        def flush(last: bool):
            nonlocal held, owners, size, number
            flat = np.frombuffer(b"".join(held), "<u4")
            cut = len(flat) if last else len(flat) // BLOCK * BLOCK
            docs, blocks, pos = [], [], 0
            for at in range(0, cut, BLOCK):
                blocks.append(flat[at : min(at + BLOCK, cut)])
                docs.append([])
            rest = []
            for doc, o, n in owners:
                while n and pos < cut:
                    take = min(n, BLOCK - pos % BLOCK, cut - pos)
                    docs[pos // BLOCK].append({"doc_id": doc, "ord": o, "n": take})
                    pos += take
                    n -= take
                if n:
                    rest.append((doc, o, n))
            held, owners, size = ([flat[cut:].tobytes()] if cut < len(flat) else []), rest, len(flat) - cut
            if blocks:
                made = encode_blocks(blocks)
                crc = [zlib.crc32(b) for b in blocks]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.struct([("doc_id", pa.int64()), ("ord", pa.int32()), ("n", pa.int32())])), pa.int32(), pa.int64(), pa.binary()]
                cols = [[shard] * len(blocks), list(range(number, number + len(blocks))), docs, [len(b) for b in blocks], crc, made]
                number += len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in ("shard", "block", "docs", "n_ids", "crc32", "payload")])

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part["doc"].to_pylist(), enc.encode(texts(part["text"])), strict=True):
                    held.append(ids + end)
                    owners.append((doc, order, len(held[-1]) // 4))
                    order += 1
                    size += owners[-1][2]
                if size >= LANES * BLOCK:
                    yield from flush(False)
        yield from flush(True)

        release()

    return run


def write_ids(docs: DataFrame, path: str, vocab: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Ids of each text and the end id, in ascending order of the documents' ids, as a file at ``path``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_column(docs, text_col).alias("text"))
    rows.repartitionByRange("doc").sortWithinPartitions("doc", "text").mapInArrow(_writer(vocab, end_id), ROWS).write.mode("overwrite").parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, block, doc_id, ord, ids) of each document's part of each block, decoded in lockstep and checked."""
    held: list[dict] = []

    def flush():
        rows = sorted(held, key=lambda r: -r["n_ids"])
        held.clear()
        out = []
        for row, ids in zip(rows, decode_blocks([r["payload"] for r in rows], np.array([r["n_ids"] for r in rows])), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
                raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
            at = 0
            for d in row["docs"]:
                out.append((row["shard"], row["block"], d["doc_id"], d["ord"], ids[at : at + d["n"]].astype("<u4").tobytes()))
                at += d["n"]
        return out

    def emit(rows):
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        cols = list(zip(*[(*r[:4], len(r[4]) // 4, zlib.crc32(r[4])) for r in rows], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "block", "doc_id", "ord", "n", "crc"])

    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == LANES:
                yield emit(flush())
    if held:
        yield emit(flush())
    release()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ord, doc_id, ids) of each document, decoded from the file; documents are put together from their parts."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            rows.sort(key=lambda r: -r["n_ids"])
            out = []
            for at in range(0, len(rows), LANES):
                some = rows[at : at + LANES]
                for row, ids in zip(some, decode_blocks([r["payload"] for r in some], np.array([r["n_ids"] for r in some])), strict=True):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
                        raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
                    start = 0
                    for d in row["docs"]:
                        out.append((row["shard"], row["block"], d["doc_id"], d["ord"], ids[start : start + d["n"]].astype(np.int32).tolist()))
                        start += d["n"]
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "block", "doc_id", "ord", "ids"])

    parts = spark.read.schema(ROWS).parquet(path).mapInArrow(run, "shard int, block int, doc_id bigint, ord int, ids array<int>")
    whole = parts.groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("p"))
    return whole.select("shard", "ord", "doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reversed."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(BLOCK)  # a part of a document has at most BLOCK ids
def _power(n_bytes: int) -> int:
    """x^8 to the power of a number of bytes."""
    power, square = 0x80000000, 0x00800000  # 1 and x^8
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, square)
        square = _times(square, square)
        n_bytes >>= 1
    return power


def joined_crc(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two byte strings in a row from the crc32 of each and the length of the second."""
    return _times(_power(n_bytes), first) ^ second


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the decoded blocks, without moving the ids.

    Only documents that span blocks have several parts; their checksums are joined arithmetically.
    Starts are sums over the shards before, and over the documents before within the shard.
    """
    small_batches(spark)
    parts = spark.read.schema(ROWS).parquet(path).mapInArrow(_pieces, "shard int, block int, doc_id bigint, ord int, n bigint, crc bigint")
    kind = T.ArrayType(T.LongType())

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for some in rows.to_pylist():
            crc = some[0]["crc"]
            for p in some[1:]:
                crc = joined_crc(crc, p["crc"], 4 * p["n"])
            out.append([sum(p["n"] for p in some), crc])
        return pa.array(out, type=pa.list_(pa.int64()))

    sums = parts.groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("p"))
    each = sums.select("shard", "ord", "doc_id", F.arrow_udf(run, kind)("p").alias("s")).select("shard", "ord", "doc_id", F.col("s")[0].alias("n_tokens"), F.col("s")[1].alias("ids_crc32"))
    sizes = spark.read.schema(ROWS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("size"))  # one row for each shard
    before = sizes.select("shard", F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("inner", inner).join(before, "shard").select("doc_id", (F.col("base") + F.col("inner")).cast("long").alias("start"), "n_tokens", "ids_crc32")
