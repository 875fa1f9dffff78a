"""Decisions that depend on earlier decisions: which phrases or lines of a document resemble one that was kept.

They run in Arrow functions over single rows (no shuffle). A document is first cut into records; an
index of the kept records proposes the few earlier ones that may be near enough; the matcher decides;
the text is put together from the mask of kept records. The index and the bounds tried before the
matcher can only propose too many, so results equal those of the matcher alone.
"""

from __future__ import annotations

import ctypes
import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHRASE_END = re.compile(r"(?<=[.!?。！？])\s+")
_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
_ARROW = pa.struct([("text", pa.string()), ("n", pa.int64())])


#: Bytes of an Arrow batch between the JVM and a worker: long texts come in smaller batches.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of the session of ``df``, and with them the memory of workers."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives free memory back to the system at the end of a task; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def arrow_text(fn: Callable, returns: T.DataType, arrow: pa.DataType) -> Callable[..., Column]:
    """An Arrow function of a text (and more columns) that passes null through; batches are taken in small slices.

    Call ``small_batches`` where it is used.
    """

    def run(batches):
        for batch in batches:
            cols = batch if isinstance(batch, tuple) else (batch,)
            made = []
            for at in range(0, len(cols[0]), 64):
                parts = [cols[0].slice(at, 64).cast(pa.binary()).to_pylist(), *[c.slice(at, 64).to_pylist() for c in cols[1:]]]
                rows = [None if t is None else fn(t.decode("utf-8", "replace"), *more) for t, *more in zip(*parts, strict=True)]
                made.append(pa.array(rows, type=arrow))
            yield pa.concat_arrays(made) if made else pa.array([], type=arrow)
            del batch, cols, made
        release()

    def one(*columns: Column) -> Column:
        kind = pa.Array if len(columns) == 1 else tuple[(pa.Array,) * len(columns)]
        run.__annotations__ = {"batches": Iterator[kind], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, returns).asNondeterministic()(*columns)  # else the optimizer may copy the call into each use

    return one


def text_fold(df: DataFrame, text: str, count: str, fn: Callable[[str], tuple[str, int]]) -> DataFrame:
    """``text`` and ``count`` by a fold over each document."""
    udf = arrow_text(lambda t: dict(zip(("text", "n"), fn(t), strict=True)), _RESULT, _ARROW)
    small_batches(df)
    step = df.withColumn("__fold", udf(F.col(text)))
    return step.withColumn(count, F.col("__fold.n")).withColumn(text, F.col("__fold.text")).drop("__fold")


def lengths_differ(a: int, b: int, threshold: float) -> bool:
    return abs(a - b) / max(a, b, 1) > (1 - threshold)


#: Characters of texts for which the longest common subsequence is found before the matcher's blocks are.
SHORT = 4096


def _places(text: str) -> dict[str, int]:
    """For each character a number with the bits of its places."""
    bits: dict[str, int] = defaultdict(int)
    for k, c in enumerate(text):
        bits[c] |= 1 << k
    return bits


def _common(other: str, bits: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``other`` and a text of n characters with these places."""
    full = left = (1 << n) - 1
    for c in other:
        if met := left & bits.get(c, 0):
            left = (left + met | left - met) & full
    return n - left.bit_count()


def _reaches(matcher: SequenceMatcher, a: int, b: int, threshold: float) -> bool:
    """Whether the matcher's ratio of texts of a and b characters reaches the threshold.

    Its blocks are found one by one, until those yet to be found can't change the answer.
    """
    if not a + b:
        return 1.0 >= threshold
    sure, possible, parts = 0, min(a, b), [(0, a, 0, b)]
    while 2.0 * sure / (a + b) < threshold <= 2.0 * possible / (a + b):
        alo, ahi, blo, bhi = parts.pop()
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        possible -= min(ahi - alo, bhi - blo)
        if k:
            sides = [(lo, hi, lo2, hi2) for lo, hi, lo2, hi2 in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if lo < hi and lo2 < hi2]
            sure, possible = sure + k, possible + k + sum(min(hi - lo, hi2 - lo2) for lo, hi, lo2, hi2 in sides)
            parts += sides
    return 2.0 * sure / (a + b) >= threshold


class Near:
    """Whether a text resembles one of some earlier ones: the matcher's ratio of (earlier, text) reaches the threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def any(self, text: str, earlier: Iterable[str]) -> bool:
        matcher = bits = None
        b = len(text)
        for other in earlier:
            a = len(other)
            if a + b and 2.0 * min(a, b) / (a + b) < self.threshold:
                continue
            if a + b and max(a, b) <= SHORT:  # the matcher's blocks are a common subsequence
                bits = bits or _places(text)
                if 2.0 * _common(other, bits, b) / (a + b) < self.threshold:
                    continue
            matcher = matcher or SequenceMatcher(None, "", text)  # what it learns of its second text serves all comparisons
            matcher.set_seq1(other)
            if (max(a, b) <= SHORT or matcher.quick_ratio() >= self.threshold) and _reaches(matcher, a, b, self.threshold):
                return True
        return False


def similar(first: str, second: str, threshold: float) -> bool:
    """Whether the matcher's ratio of (first, second), in this order, reaches the threshold."""
    return Near(threshold).any(second, (first,))


class PhraseIndex:
    """Kept phrases by their rarest words.

    Two word sets with a Jaccard similarity of ``gate`` have one of their first n - ceil(gate n) + 1
    words in common, in any fixed order of words; with rare words first these lists are short. With
    a gate of 0 every kept phrase is proposed.
    """

    def __init__(self, bags: list[frozenset[str]], gate: float):
        self.bags, self.gate = bags, gate
        self.rank = {w: k for k, (w, _) in enumerate(sorted(Counter(chain.from_iterable(bags)).items(), key=itemgetter(1)))}
        self.rare = [sorted(bag, key=self.rank.__getitem__)[: len(bag) - math.ceil(gate * len(bag) - 1e-9) + 1] for bag in bags] if gate > 0 else []
        self.holders: dict[str, list[int]] = defaultdict(list)
        self.order: list[int] = []  # kept phrases, oldest first

    def near(self, i: int, window: int) -> list[int]:
        """Of the last ``window`` kept phrases those whose words are near enough to those of phrase i."""
        recent = self.order[max(0, len(self.order) - window) :] if window > 0 else []
        if not recent or self.gate <= 0:
            return recent
        oldest, met = recent[0], set()
        for word in self.rare[i]:
            for k in reversed(self.holders.get(word, ())):
                if k < oldest:
                    break
                met.add(k)
        if not met:
            return []
        mine = self.bags[i]
        return [k for k in sorted(met) if len(mine & self.bags[k]) / len(mine | self.bags[k]) >= self.gate]

    def keep(self, i: int) -> None:
        self.order.append(i)
        if self.gate > 0:
            for word in self.rare[i]:
                self.holders[word].append(i)


def fresh_phrases(norms: list[str], threshold: float, window: int) -> list[bool]:
    """For each phrase whether it stays: it equals no kept phrase, and resembles none of the last ``window`` kept ones."""
    near, index = Near(threshold), PhraseIndex([frozenset(x.split()) for x in norms], max(0.0, 2 * threshold - 1))
    kept: set[str] = set()
    mask = []
    for i, norm in enumerate(norms):
        some = [] if norm in kept else [norms[k] for k in index.near(i, window) if not lengths_differ(len(norms[k]), len(norm), threshold)]
        stays = norm not in kept and not (some and near.any(norm, some))
        mask.append(stays)
        if stays:
            kept.add(norm)
            index.keep(i)
    return mask


def without_repeats(text: str, threshold: float = 0.9, min_length: int = 20, window: int = 64) -> tuple[str, int]:
    """A text without phrases that repeat an earlier one, and how many went. Kept phrases of a line are joined by one blank; a line of which none is kept vanishes."""
    pieces = [(PHRASE_END.split(line) if line.strip() else None, line) for line in text.split("\n")]
    norms = [[" ".join(p.lower().split()) for p in parts or ()] for parts, _ in pieces]
    judged = iter(mask := fresh_phrases([n for some in norms for n in some if len(n) >= min_length], threshold, window))
    lines = []
    for (parts, line), some in zip(pieces, norms, strict=True):
        left = None if parts is None else [p for p, n in zip(parts, some, strict=True) if len(n) < min_length or next(judged)]
        if left is None or left:
            lines.append(line if left is None else " ".join(left))
    return "\n".join(lines), mask.count(False)


#: Characters are counted in so many bins; a sum of smaller counts over bins can only be too high.
BINS = 48


class LineIndex:
    """Kept lines by length, with their characters counted in bins."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.lines: dict[int, list[str]] = defaultdict(list)
        self.bins: dict[int, np.ndarray] = {}
        self.last: tuple[str | None, np.ndarray | None] = None, None

    def count(self, line: str) -> np.ndarray:
        """Characters in bins; those of the last line are at hand, as it is often kept next."""
        if line != self.last[0]:
            self.last = line, self._count(line)
        return self.last[1]

    @staticmethod
    def _count(line: str) -> np.ndarray:
        return np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, minlength=BINS).astype(np.int32)

    def near(self, line: str) -> Iterator[str]:
        """Kept lines whose length and characters allow the ratio."""
        n, mine = len(line), self.count(line)
        slack = 1 - self.threshold
        low, high = (n - math.ceil(slack * n) - 1, math.ceil(n / self.threshold) + 1) if self.threshold > 0 else (0, max(self.lines, default=0))
        for size in range(low, high + 1) if high - low < len(self.lines) else sorted(self.lines):
            if size in self.lines and not lengths_differ(size, n, self.threshold):
                some = self.lines[size]
                common = np.minimum(self.bins[size][: len(some)], mine).sum(1)
                yield from (some[k] for k in np.flatnonzero(2.0 * common / max(size + n, 1) >= self.threshold))

    def keep(self, line: str) -> None:
        some = self.lines[len(line)]
        held = self.bins.get(len(line))
        if held is None or len(held) == len(some):  # room for twice as many
            more = np.zeros((2 * len(some) + 2, BINS), np.int32)
            more[: len(some)] = 0 if held is None else held
            self.bins[len(line)] = held = more
        held[len(some)] = self.count(line)
        some.append(line)


def near_lines(text: str, threshold: float, min_length: int) -> tuple[str, int]:
    """A text without lines that resemble an earlier kept one, and how many went."""
    lines = text.split("\n")
    index, near, mask = LineIndex(threshold), Near(threshold), []
    for bare in map(str.strip, lines):
        long = len(bare) >= min_length
        mask.append(not (long and near.any(bare, index.near(bare))))
        if long and mask[-1]:
            index.keep(bare)
    return "\n".join(line for line, stays in zip(lines, mask, strict=True) if stays), mask.count(False)
