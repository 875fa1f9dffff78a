"""Token counts: Arrow functions that encode batches and return lengths only.

A text is split at safe boundaries (see ``lexicon``), so that no call to the library ever gets more
than a piece of a long text. The distinct new pieces of a slice are dealt into calls of at most
``CALL_BYTES`` bytes each and encoded together; their lengths are kept in a bounded table, so that a
piece that comes again costs one look-up. Only numbers leave the worker.

Defined cases: null and empty texts have 0 bytes and 0 tokens; broken UTF-8 counts as U+FFFD.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import map_slices, struct_type, text_column, texts, with_struct
from pithy.llm.lexicon import cutter, load

CALL_BYTES = 256 << 10
TABLE_PIECES = 400_000
#: Pieces above this many characters are encoded but not kept.
KEPT_CHARS = 64

RESULT = struct_type(n_tokens=T.LongType())


class Counter:
    """Counts tokens of texts with one library object."""

    def __init__(self, path: str):
        self.lib, kind = load(path)
        self.cut = cutter(kind)
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        if hasattr(self.lib, "encode_batch_fast"):
            return [len(e) for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        if hasattr(self.lib, "encode_batch"):
            return [len(e) for e in self.lib.encode_batch(pieces, add_special_tokens=False)]
        return [len(e) for e in self.lib.encode(pieces, num_threads=1)]

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Lengths of new pieces, encoded in calls balanced by bytes."""
        out: dict[str, int] = {}
        call: list[str] = []
        size = 0
        for piece in sorted(pieces, key=len):
            n = 4 * len(piece)
            if call and size + n > CALL_BYTES:
                out.update(zip(call, self.lengths(call), strict=True))
                call, size = [], 0
            call.append(piece)
            size += n
        if call:
            out.update(zip(call, self.lengths(call), strict=True))
        return out

    def count(self, many: list[str]) -> list[int]:
        cut = [self.cut(t) for t in many]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > TABLE_PIECES:
            self.known.clear()
            new = set().union(*cut)
        table = self.known
        learnt = self.learn(new)
        long = {p: n for p, n in learnt.items() if len(p) > KEPT_CHARS}
        table.update(learnt)
        out = [sum(map(table.__getitem__, pieces)) for pieces in cut]
        for p in long:
            del table[p]
        return out


def count_tokens(df: DataFrame, vocab: str, *, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text, as the library for ``vocab`` gives them."""
    held: dict = {}

    def counter():
        if "c" not in held:
            held["c"] = Counter(vocab)
        return held["c"]

    def run(part: pa.Array, c: Counter) -> pa.Array:
        return pa.array(c.count(texts(part)), type=pa.int64())

    udf = map_slices(run, T.LongType(), counter)
    return with_struct(df, F.struct(udf(text_column(df, text_col)).alias("n")), {out_col: "n"})
