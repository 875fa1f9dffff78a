"""Extractive summaries: sentences, terms, similarities, ranks.

Terms and similarities never leave a document: rows of a document are brought together and read as a
stream, so only texts are shuffled, once. The rank iteration adds doubles in ascending sentence order;
it runs in one Arrow function per document over sparse rows, with the same order of additions and so
the same bits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.functions import patterns as P
from pithy.operators.fold import arrow_text, release, small_batches

_END = re.compile(r"(?<=[.!?。！？\n])\s+")
_WORD = re.compile(r"\w+")
_STOP = frozenset(P.STOPWORDS)


def split(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _END.split(text)) if s]


#: Term counts of a document that are held before those of its rows are added up.
HELD_TERMS = 1 << 20


class Terms:
    """Term counts of a document's sentences, without stopwords; rows of it are added one after the other."""

    def __init__(self, sents: list[str] | None = None):
        self.place: dict[str, int] = defaultdict(count().__next__, dict.fromkeys(_STOP, -1))  # number of each term
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # (sentence << 32 | term, count)
        self.held = 0
        if sents is not None:
            self.add(sents)

    def add(self, sents: list[str]) -> None:
        """Counts a row's sentences; those with equal numbers are one."""
        words = [_WORD.findall(s.lower()) if s.isascii() else [*map(str.lower, _WORD.findall(s))] for s in sents]
        sizes = [*map(len, words)]
        number = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        key = np.repeat(np.arange(len(words)), sizes) << 32 | number
        key, many = np.unique(key[number >= 0], return_counts=True)
        self.parts.append((key, many))
        self.held += len(key)
        if self.held > HELD_TERMS:
            self.held = 2 * len(self.table()[0]) - HELD_TERMS  # the next time when there are as many more

    def names(self) -> list[str]:
        """Terms by number."""
        return [*self.place][len(_STOP) :]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, term, count), by sentence, then term."""
        if len(self.parts) > 1:
            key, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(key, np.bincount(at, np.concatenate([c for _, c in self.parts])).astype(np.int64))]
        key, many = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 2
        return key >> 32, key & 0xFFFFFFFF, many


#: Rows of a batch of results.
BATCH_ROWS = 1 << 14


def by_document(df: DataFrame, id_col: str, text: str, columns: str, fn: Callable[[Terms], Iterator[tuple[pa.Array, ...]]]) -> DataFrame:
    """(id, *columns) of what ``fn`` yields for each document. Rows with equal ids are one document."""

    def run(batches):
        ready, rows = [], 0
        for key, terms in _documents(batches):
            for made in fn(terms):
                ready.append((pa.repeat(key, len(made[0])), *made))
                rows += len(made[0])
                if rows >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*ready, strict=True)], names=names)
                    ready, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*ready, strict=True)], names=names)
        release()

    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL(columns)])
    names = kind.names
    small_batches(df)
    some = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")).where(F.col(f"`{text}`").isNotNull())
    return some.repartition(F.col(f"`{id_col}`")).sortWithinPartitions(F.col(f"`{id_col}`")).mapInArrow(run, kind)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Terms]]:
    """(id, its terms) of rows that are sorted by id."""
    key = terms = None
    for batch in batches:
        for at, t in enumerate(batch.column(1).cast(pa.binary())):
            mine = batch.column(0)[at]
            if key is None or mine != key:
                if key is not None:
                    yield key, terms
                key, terms = mine, Terms()
            terms.add(split(t.as_py().decode("utf-8", "replace")))
    if key is not None:
        yield key, terms


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sid, term, tf)."""

    def counts(terms):
        sid, term, tf = terms.table()
        yield pa.array(sid.astype(np.int32)), pa.array(terms.names(), pa.string()).take(pa.array(term)), pa.array(tf)

    return by_document(df, id_col, text, "sid int, term string, tf long", counts)


def document_terms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, n_sentences): how often a document has a term, and in how many sentences."""

    def counts(terms):
        _, term, tf = terms.table()
        names = pa.array(terms.names(), pa.string())
        n = len(names)
        yield names, pa.array(np.bincount(term, tf, n).astype(np.int64)), pa.array(np.bincount(term, minlength=n).astype(np.int64))

    return by_document(df, id_col, text, "term string, tf long, n_sentences long", counts)


def cosine_edges(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, i, j, w) for each pair of sentences i < j of a document with a common term; a row without an id is in none."""

    def edges(terms):
        for row, col, w in Similarities(terms).blocks():
            up = col > row
            yield pa.array(row[up].astype(np.int32)), pa.array(col[up].astype(np.int32)), pa.array(w[up])

    return by_document(df.where(F.col(f"`{id_col}`").isNotNull()), id_col, text, "i int, j int, w double", edges)


#: Similarities of a document that are kept between rounds (with more, rows are made anew in each round), cells of a
#: block of rows, and products of terms in a block.
KEPT_EDGES, CELLS, PRODUCTS = 4_000_000, 1 << 18, 1 << 20


class Similarities:
    """The cosine matrix of sentences, without its diagonal, in blocks of rows; only pairs that share a term are held.

    Dot products are sums of whole numbers, so their order doesn't matter. Memory follows the terms
    of the document and one block, not the square of its sentences.
    """

    def __init__(self, terms: Terms, sentences: int | None = None):
        self.sentence, self.term, many = terms.table()
        self.n = n = sentences if sentences is not None else int(self.sentence[-1]) + 1 if len(many) else 0
        sizes = np.bincount(self.sentence, minlength=n)
        self.count = many.astype(np.float64)
        self.norm = np.sqrt(np.bincount(self.sentence, self.count * self.count, n))
        by_term = np.argsort(self.term, kind="stable")
        self.owner, self.weight = self.sentence[by_term], self.count[by_term]  # one term after the other
        self.many = np.bincount(self.term, minlength=len(terms.place) - len(_STOP))
        self.first = np.cumsum(self.many) - self.many
        self.at = np.concatenate([[0], np.cumsum(sizes)])

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, similarity) of all pairs, by ascending row, then column."""
        n, j = self.n, 0
        work = np.concatenate([[0], np.cumsum(self.many[self.term])])[self.at]
        while j < n:
            end = max(j + 1, min(n, j + CELLS // n, int(np.searchsorted(work, work[j] + PRODUCTS, side="right")) - 1))
            some = slice(self.at[j], self.at[end])
            many = self.many[self.term[some]]
            total = int(many.sum())
            pick = np.arange(total) + np.repeat(self.first[self.term[some]] - (np.cumsum(many) - many), many)
            cell = np.repeat((self.sentence[some] - j) * n, many) + self.owner[pick]
            dots = np.bincount(cell, self.weight[pick] * np.repeat(self.count[some], many), (end - j) * n)
            dots[np.arange(end - j) * (n + 1) + j] = 0.0
            cell = np.flatnonzero(dots > 0)
            row, col = cell // n + j, cell % n
            yield row, col, dots[cell] / (self.norm[row] * self.norm[col])
            j = end


def scores(sents: list[str], damping: float = 0.85, rounds: int = 30) -> np.ndarray:
    """Rank of each sentence by iteration over cosine similarities of term counts.

    Every sum of doubles runs over sentences in ascending order (``bincount`` adds one after the
    other), so scores equal those of plain loops bit for bit.
    """
    alike = Similarities(Terms(sents), len(sents))
    n = alike.n
    rank = np.full(n, 1.0 / n)
    kept, edges = [], 0

    def shares():
        """(edges of each row, column, similarity as a part of its row's sum) of blocks."""
        for row, col, w in alike.blocks():
            yield np.bincount(row, minlength=n), col, w / np.bincount(row, w, n)[row]

    for many, col, part in shares():
        edges += len(col)
        if edges > KEPT_EDGES:
            kept = []
            break
        kept.append((many, col.astype(np.int32), part))
    if kept:
        kept = [(sum(k[0] for k in kept), *(np.concatenate([k[c] for k in kept]) for c in (1, 2)))]
    every = np.arange(n)
    for _ in range(rounds):
        if kept:
            ((many, col, part),) = kept
            acc = np.bincount(col, part * np.repeat(rank, many), n)
        else:
            acc = np.zeros(n)
            for many, col, part in shares():
                acc = np.bincount(np.concatenate([every, col]), np.concatenate([acc, part * np.repeat(rank, many)]), n)
        rank = (1 - damping) / n + damping * acc
    return rank


def summarize_text(text: str, ratio: float = 0.3, max_sentences: int | None = None, damping: float = 0.85, rounds: int = 30) -> str:
    """The most central sentences in their order."""
    sents = split(text)
    if len(sents) <= 2:
        return text.strip()
    most = max(1, round(len(sents) * ratio))
    if max_sentences is not None:
        most = min(most, max_sentences)
    order = np.argsort(-scores(sents, damping, rounds), kind="stable")
    return "\n".join(sents[i] for i in sorted(order[:most]))


def summarize(df: DataFrame, text: str, ratio=0.3, max_sentences: int | None = None, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """``text`` summarized; ``ratio`` is a number or a column, where it is null the text stays."""
    udf = arrow_text(lambda t, r: t if r is None else summarize_text(t, r, max_sentences, damping, rounds), T.StringType(), pa.string())
    small_batches(df)
    part = ratio if not isinstance(ratio, (int, float)) else F.lit(float(ratio))
    return df.withColumn(text, udf(F.col(text), part))


def rank_scores(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sid, score) of each sentence."""
    kind = T.ArrayType(T.DoubleType())
    udf = arrow_text(lambda t: scores(s).tolist() if (s := split(t)) else [], kind, pa.list_(pa.float64()))
    small_batches(df)
    return df.select(id_col, F.posexplode(udf(F.col(text))).alias("sid", "score"))
