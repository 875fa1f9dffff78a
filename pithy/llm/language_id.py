"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has, for every order 1 to 5, a sorted array of 64-bit hashes of its n-grams with
their discounted probabilities, and one of its contexts with their back-off mass; a look-up is a
binary search. Words are runs of letters, lower-cased, with a blank on both sides; contexts never
leave a word, so the score of a word is a constant and is kept in a bounded table of the worker.
A text gets the language of lowest cross-entropy per character over the whole text.

Fitting uses a bounded, documented sample of labelled rows: at most ``rows_per_language`` rows
(chosen by a hash of the id) of each of the ``max_languages`` most frequent values. A fifth of the
sample is held back to calibrate the temperature of the score and, for each language, its usual
cross-entropy and how far one may lie above it for a text of its length. A text is rejected if it
lies beyond that and also nearer to letters drawn evenly than ``REJECT_SHARE`` allows, so that
clean texts with some digits, names or foreign passages stay.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected; rows
without label are never learnt from; with no labelled rows every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import map_slices, struct_array, struct_type, text_column, texts, with_struct

ORDER = 5
TABLE_WORDS = 300_000
KEPT_CHARS = 48
#: A text is alien if its cross-entropy lies this far on the way from the language's usual one to that of letters drawn evenly.
REJECT_SHARE = 0.6
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

RESULT = struct_type(lang=T.StringType(), score=T.DoubleType(), cross_entropy=T.DoubleType(), n_letters=T.LongType(), rejected=T.BooleanType())


def char_codes(words: list[str]) -> np.ndarray:
    """Code points of the words, each with a blank before it, and one blank at the end."""
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each position its distance to the last blank before it, and the hashes of the 1- to ORDER-grams that end there."""
    c = codes.astype(np.uint64)
    mixed = (c + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    blank = codes == 32
    last = np.maximum.accumulate(np.where(blank, np.arange(len(codes)), -1))
    last = np.concatenate([[-1], last[:-1]])
    depth = np.arange(len(codes)) - last  # a blank that ends a word still sees the word
    out = [mixed]
    for _ in range(1, ORDER):
        prev = out[-1]
        h = np.empty_like(prev)
        h[0] = 0
        h[1:] = prev[:-1] * _BASE + mixed[1:]
        out.append(h)
    return depth, out


@dataclass
class Level:
    """One order of one language."""

    grams: np.ndarray
    mass: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    """All languages; ``usual`` and ``beyond`` calibrate rejection, ``sharpness`` the score."""

    langs: list[str]
    levels: list[list[Level]]
    letters: int
    usual: np.ndarray
    beyond: np.ndarray
    sharpness: float = 1.0


def fit_language(counts: Counter, letters: int) -> list[Level]:
    """Interpolated Kneser-Ney over a bag of words: raw counts at the top and for n-grams that begin a word, continuation counts below."""
    words = list(counts)
    codes = char_codes(words)
    depth, hashes = gram_hashes(codes)
    is_blank = codes == 32
    word_no = np.cumsum(is_blank) - 1
    weight = np.array([counts[w] for w in words], np.float64)
    w_of = weight[np.clip(np.where(is_blank, word_no - 1, word_no), 0, len(words) - 1)]
    levels: list[Level] = []
    for k in range(1, ORDER + 1):
        ok = np.flatnonzero(depth >= k - 1)
        ok = ok[ok > 0]
        gram = hashes[k - 1][ok]
        top = (k == ORDER) | (depth[ok] == k - 1)  # no character stands before these
        keys, inverse = np.unique(gram, return_inverse=True)
        raw = np.bincount(inverse[top], w_of[ok][top], len(keys))
        rest = ok[~top]
        more = np.zeros(len(keys))
        if len(rest):
            pairs = np.unique(np.stack([inverse[~top].astype(np.uint64), hashes[k][rest]]), axis=1)
            more = np.bincount(pairs[0].astype(np.int64), minlength=len(keys)).astype(np.float64)
        count = raw + more
        context = np.zeros(len(ok), np.uint64) if k == 1 else hashes[k - 2][ok - 1]
        first = np.full(len(keys), len(ok), np.int64)
        np.minimum.at(first, inverse, np.arange(len(ok)))
        ctx_keys, ctx_of = np.unique(context[first], return_inverse=True)
        total = np.bincount(ctx_of, count, len(ctx_keys))
        kinds = np.bincount(ctx_of, minlength=len(ctx_keys))
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        levels.append(Level(keys, np.maximum(count - discount, 0) / total[ctx_of], ctx_keys, np.minimum(1.0, np.minimum(discount, count.min()) * kinds / total) if len(keys) else total))
    return levels


class Index:
    """The arrays of all languages for look-ups: for each order the union of their sorted hashes, with a row of values for each language."""

    def __init__(self, model: Model):
        self.letters, self.langs = model.letters, len(model.langs)
        self.grams = [self._union([(lv[k].grams, lv[k].mass) for lv in model.levels], 0.0) for k in range(ORDER)] if model.levels else []
        self.contexts = [self._union([(lv[k].contexts, lv[k].backoff) for lv in model.levels], 1.0) for k in range(ORDER)] if model.levels else []

    @staticmethod
    def _union(parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and the values with a last column for hashes that no language has."""
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        values = np.full((len(parts), len(keys) + 1), default)
        for row, (k, v) in zip(values, parts, strict=True):
            row[np.searchsorted(keys, k)] = v
        return keys, values


def find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places of ``want`` in a sorted hash array, its length where they are absent; equal hashes are searched once, in order."""
    some, of = np.unique(want, return_inverse=True)
    at = np.searchsorted(keys, some)
    if len(keys):
        at[keys[np.minimum(at, len(keys) - 1)] != some] = len(keys)
    return at[of]


def word_scores(model: Model, words: list[str], index: Index | None = None) -> np.ndarray:
    """For each word the log-probability of its characters and its end in each language, and the number of characters."""
    index = index or Index(model)
    codes = char_codes(words)
    depth, hashes = gram_hashes(codes)
    at = np.arange(1, len(codes))
    word_no = (np.cumsum(codes == 32) - 1)[at]
    word_no = np.where(codes[at] == 32, word_no - 1, word_no)
    out = np.zeros((len(words), index.langs + 1))
    p = np.full((index.langs, len(at)), 1.0 / index.letters)
    for k, ((grams, mass), (contexts, backoff)) in enumerate(zip(index.grams, index.contexts, strict=True), 1):
        ok = np.flatnonzero(depth[at] >= k - 1)
        here = at[ok]
        gram = find(grams, hashes[k - 1][here])
        context = find(contexts, np.zeros(len(here), np.uint64) if k == 1 else hashes[k - 2][here - 1])
        for j in range(index.langs):
            p[j, ok] = mass[j, gram] + backoff[j, context] * p[j, ok]
    for j in range(index.langs):
        out[:, j] = np.bincount(word_no, np.log(np.maximum(p[j], 1e-12)), len(words))
    out[:, -1] = np.bincount(word_no, minlength=len(words))
    return out


class Scorer:
    """Cross-entropies of texts, with a bounded table of chunks between spaces."""

    def __init__(self, model: Model):
        self.model, self.index = model, Index(model)
        self.row: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs) + 1))

    def _clear(self):
        self.row, self.rows = {}, np.zeros((0, len(self.model.langs) + 1))

    def _learn(self, chunks: list[str]) -> None:
        parts = [_LETTERS.findall(c) for c in chunks]
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        place = {w: i for i, w in enumerate(words)}
        scores = word_scores(self.model, words, self.index) if words else self.rows[:0]
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(p) for p in parts])
        rows = np.zeros((len(chunks), scores.shape[1]))
        for j in range(rows.shape[1]):
            rows[:, j] = np.bincount(owner, scores[flat, j], len(chunks)) if len(flat) else 0
        base = len(self.rows)
        self.rows = np.concatenate([self.rows, rows])
        self.row.update(zip(chunks, range(base, base + len(chunks)), strict=True))

    def totals(self, many: list[str]) -> np.ndarray:
        """Per text: log-probability in each language and number of scored characters."""
        cut = [t.lower().split() for t in many]
        new = set().union(*cut).difference(self.row)
        if len(self.row) + len(new) > TABLE_WORDS:
            self._clear()
            new = set().union(*cut)
        if new:
            self._learn(list(new))
        lens = np.array([len(c) for c in cut])
        flat = np.fromiter(map(self.row.__getitem__, chain.from_iterable(cut)), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(cut)), lens)
        out = np.stack([np.bincount(owner, self.rows[flat, j], len(cut)) for j in range(self.rows.shape[1])], axis=1) if len(flat) else np.zeros((len(cut), len(self.model.langs) + 1))
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del self.row[w]
        return out

    def predict(self, many: list[str]) -> tuple[list, list, list, list, list]:
        m = self.model
        sums = self.totals(many)
        n = sums[:, -1]
        if not m.langs:
            return ["und"] * len(many), [0.0] * len(many), [0.0] * len(many), [0] * len(many), [True] * len(many)
        h = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        odds = np.exp(-m.sharpness * (h - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None])
        score = np.where(n > 0, 1 / odds.sum(1), 0.0)
        far = (low - m.usual[best]) * np.sqrt(np.maximum(n, 1))
        alien = m.usual[best] + REJECT_SHARE * (np.log(m.letters) - m.usual[best])
        rejected = (n == 0) | ((far > m.beyond[best]) & (low > alien))
        lang = [m.langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
        return lang, score.tolist(), np.where(n > 0, low, 0.0).tolist(), n.astype(np.int64).tolist(), rejected.tolist()


def bag(many: list[str]) -> Counter:
    """Counts of the words of texts."""
    chunks = Counter()
    for t in many:
        chunks.update(t.lower().split())
    out = Counter()
    for chunk, n in chunks.items():
        for w in _LETTERS.findall(chunk):
            out[w] += n
    return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """A calibrated model of (language, text) rows; every fifth row of a language only calibrates."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        if text and lang is not None and _LETTERS.search(text):
            by.setdefault(lang, []).append(text)
    bags, kept = {}, {}
    for lang in sorted(by):
        some = by[lang]
        kept[lang] = some[::5] if len(some) >= 10 else some
        bags[lang] = bag([t for i, t in enumerate(some) if i % 5 or len(some) < 10])
    letters = len({c for b in bags.values() for w in b for c in w}) + 2
    langs = list(bags)
    model = Model(langs, [fit_language(bags[k], letters) for k in langs], letters, np.zeros(len(langs)), np.full(len(langs), np.inf))
    scorer = Scorer(model)
    tests = []
    for j, lang in enumerate(langs):
        sums = scorer.totals(kept[lang])
        n = sums[:, -1]
        h = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        model.usual[j] = np.median(h[:, j])
        model.beyond[j] = 1.5 * max(2.0, float(((h[:, j] - model.usual[j]) * np.sqrt(n)).max()))
        tests.append((j, h, n))
    best = np.inf
    for sharp in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
        loss = 0.0
        for j, h, n in tests:
            z = -sharp * h * np.sqrt(n)[:, None]
            loss -= float((z[:, j] - np.logaddexp.reduce(z, axis=1)).mean())
        if loss < best - 1e-9:
            best, model.sharpness = loss, sharp
    return model


def sample(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows_per_language: int, max_languages: int) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows, chosen by a hash of the id."""
    lang = F.col(f"`{lang_col}`").cast("string")
    counts = labelled.where(lang.isNotNull()).groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return []
    span = 1 << 20
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(span, -(-span * rows_per_language // r.n)))])
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(span))
    rows = labelled.select(lang.alias("lang"), text_column(labelled, text_col).alias("text"), draw.alias("draw"))
    rows = rows.where((F.col("draw") < F.element_at(share, F.col("lang"))) & F.col("text").isNotNull())
    got = rows.limit(2 * rows_per_language * len(counts)).collect()
    got.sort(key=lambda r: (r.lang, r.draw, r.text))
    seen: Counter = Counter()
    out = []
    for r in got:
        seen[r.lang] += 1
        if seen[r.lang] <= rows_per_language:
            out.append((r.lang, r.text))
    return out


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400, max_languages: int = 64) -> Model:
    """The model of a bounded sample of labelled rows."""
    return fit(sample(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col, rows_per_language=rows_per_language, max_languages=max_languages))


def identify(df: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy, n_letters and rejected (names after ``prefix``)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def scorer() -> Scorer:
        if "s" not in held:
            held["s"] = Scorer(sent.value)
        return held["s"]

    udf = map_slices(lambda part, s: struct_array(RESULT, *s.predict(texts(part))), RESULT, scorer)
    names = {f"{prefix}lang_pred": "lang", f"{prefix}score": "score", f"{prefix}cross_entropy": "cross_entropy", f"{prefix}n_letters": "n_letters", f"{prefix}rejected": "rejected"}
    return with_struct(df, udf(text_column(df, text_col)), names)


def fold(id_col: str, parts: int) -> Column:
    """The held-out fold of a row: crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(parts))
