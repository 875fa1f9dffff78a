"""BPE encoding and decoding by a pair occurrence index.

The distinct new pre-tokens of a slice are laid out, ``INDEX_TOKENS`` at a time, as one linked list of symbols. The index
maps each adjacent pair that has a rank to all its positions; active ranks are taken in ascending
order, all positions of the pair are merged from left to right, and only the pairs beside a merged
position are entered anew. The result equals merging each piece alone, because a merge in one piece
never touches another and the lowest active rank is always taken next.

Cutting, normalising and pre-tokenising follow the vocabulary file; special strings inside texts
become their own ids. Decoding without a decoder in the file joins the tokens with one blank, as
the library does; with a byte-level decoder bytes are put together and read as UTF-8.

Defined cases: null is the empty text; it has no ids and decodes to the empty text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from pithy.llm.arrow import SLICE_ROWS, map_slices, struct_array, struct_type, text_column, texts, with_struct
from pithy.llm.lexicon import Table, cutter, kind_of

#: Pieces and pre-tokens kept with their ids in each generation of a worker's tables.
TABLE_PIECES, TABLE_TOKENS = 80_000, 100_000
KEPT_CHARS = 64
#: Pre-tokens of one index, so that it stays near the processor.
INDEX_TOKENS = 2048
#: Rows encoded together: a larger slice meets fewer of its pieces again in the next one.
BATCH_ROWS = 512
#: Between pre-tokens; no byte of UTF-8.
WALL = b"\xff"
#: Pairs of ids below this are looked up in an array.
FEW = 513
#: Letters that are composed, stay one letter in lower case and form one pre-token, with ASCII marks behind them.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_EASY = re.compile(f"([{_LATIN}]+)([!-&(-/:-@\\[-`{{-~]*)")

RESULT = struct_type(ids=T.ArrayType(T.IntegerType(), False), decoded=T.StringType())


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndex:
    """Merges many pieces at once. A rank stands for its pair."""

    def __init__(self, merges: Iterable[tuple[int, int, int]]):
        self.pairs = list(merges)  # left, right, merged: by rank
        self.behind: dict[int, dict[int, int]] = {}  # left -> right -> rank
        self.ahead: dict[int, dict[int, int]] = {}  # right -> left -> rank
        self.first = np.full((FEW, FEW), -1, np.int32)  # ranks of pairs of small ids, a wall is 0
        for rank, (left, right, _) in enumerate(self.pairs):
            self.behind.setdefault(left, {})[right] = rank
            self.ahead.setdefault(right, {})[left] = rank
            if max(left, right) + 1 < FEW:
                self.first[left + 1, right + 1] = rank

    def enter(self, start: np.ndarray) -> dict[int, list[int]]:
        """The positions of each pair that has a rank, from left to right."""
        if start.max(initial=-1) + 1 < FEW:
            ranks = self.first[start[:-1] + 1, start[1:] + 1]
        else:
            ranks = np.array([self.behind.get(a, {}).get(b, -1) for a, b in pairwise(start.tolist())], np.int32)
        at = np.flatnonzero(ranks >= 0)
        ranks = ranks[at]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order].tolist(), ranks[order]
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(at)]
        return {rank: at[i:j] for rank, (i, j) in zip(ranks[cuts[:-1]].tolist(), pairwise(cuts), strict=True)} if at else {}

    def run(self, start: np.ndarray) -> list[tuple[int, ...]]:
        """Ids of pieces, given as the ids of their letters with a wall (-1) behind each."""
        sym: list[int] = start.tolist()
        n = len(sym)
        sym.append(-1)  # before the first and after the last position
        count = list(range(-1, n + 2))
        after, before = count[2:], count[: n + 1]
        places = self.enter(start)
        active = list(places)  # ascending
        pairs, behind, ahead, none = self.pairs, self.behind, self.ahead, {}
        while active:
            rank = heappop(active)
            left, right, new = pairs[rank]
            to_right, to_left = behind.get(new, none), ahead.get(new, none)
            for at in sorted(places.pop(rank)):
                nxt = after[at]
                if sym[at] != left or sym[nxt] != right:
                    continue
                sym[at], sym[nxt] = new, -2
                after[at] = far = after[nxt]
                before[far] = at
                found = to_right.get(sym[far])
                if found is not None:
                    if found in places:
                        places[found].append(at)
                    else:
                        places[found] = [at]
                        heappush(active, found)
                near = before[at]
                found = to_left.get(sym[near])
                if found is not None:
                    if found in places:
                        places[found].append(near)
                    else:
                        places[found] = [near]
                        heappush(active, found)
        left_over = np.array(sym[:n], np.int32)
        left_over = left_over[left_over != -2]
        walls = np.flatnonzero(left_over == -1).tolist()
        flat = tuple(left_over.tolist())
        return [flat[i + 1 : j] for i, j in pairwise([-1, *walls])]


class Bpe:
    """Encodes and decodes as the library does for a vocabulary file, with merges of its own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        lib = Tokenizer.from_file(path)
        self.normalizer, self.pre = lib.normalizer, lib.pre_tokenizer
        self.cut = cutter(kind_of(spec))
        self.lower_ascii = bool(spec.get("normalizer")) and kind_of(spec) == "words"
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.index = PairIndex((self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([self.token_of.get(i, "") for i in range(1 + max(self.token_of))], type=pa.large_string())
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.letter = np.array([self.vocab[c] for c in letters], np.int32)
        self.last_letter = np.array([self.vocab[c + self.suffix] for c in letters], np.int32)
        self.known, self.tokens = Table(TABLE_PIECES), Table(TABLE_TOKENS)

    def pre_tokens(self, part: str) -> list[bytes]:
        """Pre-tokens, as bytes, of a part without special strings."""
        if self.lower_ascii and (easy := _EASY.fullmatch(part)):
            word, marks = easy.groups()
            return [word.lower().encode(), marks.encode()] if marks else [word.lower().encode()]
        norm = self.normalizer.normalize_str(part) if self.normalizer else part
        return [bytes(map(self.byte_of.__getitem__, t)) for t, _ in self.pre.pre_tokenize_str(norm) if t]

    def merge(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens, merged over one index for each ``INDEX_TOKENS`` of them."""
        out = []
        for at in range(0, len(tokens), INDEX_TOKENS):
            data = np.frombuffer(WALL.join([*tokens[at : at + INDEX_TOKENS], b""]), np.uint8)
            walls = np.flatnonzero(data == WALL[0])
            start = self.letter[data]
            start[walls - 1] = self.last_letter[data[walls - 1]]
            start[walls] = -1
            out += self.index.run(start)
        return out

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces; only their new pre-tokens are merged."""
        words, plans = {}, {}
        for piece in pieces:
            if self.lower_ascii and piece.isascii() and piece.isalpha():
                words[piece] = piece.lower().encode()
                continue
            if self.cut_special and "<" in piece:
                plan: list = []
                for part in self.cut_special.split(piece):
                    if part in self.special:
                        plan.append(self.special[part])
                    elif part:
                        plan += self.pre_tokens(part)
            else:
                plan = self.pre_tokens(piece)
            if len(plan) == 1 and plan[0].__class__ is bytes:
                words[piece] = plan[0]
            else:
                plans[piece] = plan
        new = list(self.tokens.missing({*words.values(), *(t for t in chain.from_iterable(plans.values()) if t.__class__ is bytes)}))
        table = self.tokens.young
        table.update(zip(new, self.merge(new), strict=True))
        out = dict(zip(words, map(table.__getitem__, words.values()), strict=True))
        for piece, plan in plans.items():
            out[piece] = tuple(chain.from_iterable((x,) if x.__class__ is int else table[x] for x in plan))
        for token in [t for t in new if len(t) > KEPT_CHARS]:
            del table[token]
        return out

    def encode_flat(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and the number of ids of each text. Ids are laid out once for each distinct piece."""
        cut = [self.cut(t) for t in many]
        names = list(set().union(*cut))
        new = list(self.known.missing(set(names)))
        table = self.known.young
        table.update(self.learn(new))
        held = list(map(table.__getitem__, names))
        for piece in [p for p in new if len(p) > KEPT_CHARS]:
            del table[piece]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        number = np.fromiter(map(dict(zip(names, range(len(names)), strict=True)).__getitem__, chain.from_iterable(cut)), np.int32, int(count.sum()))
        del cut, names, new
        size = np.fromiter(map(len, held), np.int64, len(held))
        flat = np.fromiter(chain.from_iterable(held), np.int32, int(size.sum()))
        each = size[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat((np.cumsum(size) - size)[number] - ends[:-1], each)
        place += np.arange(len(place))
        return flat[place], np.diff(ends[np.concatenate([[0], np.cumsum(count)])])

    def encode(self, many: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text its ids, as one tuple."""
        flat, size = self.encode_flat(many)
        ids = tuple(flat.tolist())
        return [[ids[j - n : j]] for j, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]

    def decode(self, ids) -> str:
        """The text of ids, special ids included; ids outside the vocabulary are left out."""
        tokens = [self.token_of[i] for i in ids if i in self.token_of]
        if not self.byte_level:
            return " ".join(tokens)
        # special strings are plain text here, all other tokens are letters for bytes
        data = b"".join(t.encode() if t in self.special else bytes(map(self.byte_of.__getitem__, t)) for t in tokens)
        return data.decode("utf-8", "replace")


def ids_array(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """A list<int32> array of ids in a row and the number of ids of each text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))


#: One encoder for each vocabulary in a worker; it lives across tasks, and so do its tables.
_HELD: dict[str, Bpe] = {}


def _held(vocab: str, keep: bool = True):
    def bpe() -> Bpe:
        if not keep:
            _HELD.clear()
            return Bpe(vocab)
        if vocab not in _HELD:
            _HELD.clear()
            _HELD[vocab] = Bpe(vocab)
        return _HELD[vocab]

    return bpe


def encode_column(df: DataFrame, vocab: str, text_col: str = "text") -> Column:
    """Ids of each text."""
    kind = T.ArrayType(T.IntegerType(), False)
    return map_slices(lambda part, b: ids_array(*b.encode_flat(texts(part))).cast(pa.list_(pa.field("element", pa.int32(), False))), kind, _held(vocab))(text_column(df, text_col))


def decode_column(vocab: str, ids: Column) -> Column:
    """Texts of arrays of ids; null stays null."""
    return map_slices(lambda part, b: pa.array([None if x is None else b.decode(x) for x in part.to_pylist()], type=pa.string()), T.StringType(), _held(vocab))(ids)


def encode_decode(df: DataFrame, vocab: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: bool = True) -> DataFrame:
    """``df`` with the ids of each text and the text decoded from exactly those ids, in one pass.

    Where decoding joins tokens, Arrow joins their names. Without ``keep`` a worker gives its encoder and tables back at
    the end of each task: Spark hands tasks to its waiting workers in turn, so after operators that
    had several workers on a core each of them would hold an encoder.
    """

    def run(part: pa.Array, b: Bpe) -> pa.Array:
        ids = ids_array(*b.encode_flat(texts(part)))
        if b.byte_level:
            decoded = [b.decode(r) for r in ids.to_pylist()]
        else:  # ids of an encoder are all in its vocabulary
            decoded = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, b.names.take(ids.values)), pa.scalar(" ", b.names.type))
        return struct_array(RESULT, ids, decoded)

    return with_struct(df, map_slices(run, RESULT, _held(vocab, keep), BATCH_ROWS if keep else SLICE_ROWS)(text_column(df, text_col)), {ids_col: "ids", decoded_col: "decoded"})
