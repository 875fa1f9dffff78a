"""Toxicity: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word (the characters between spaces, lower-cased, outer punctuation off) is the mean of the
embeddings of its character 3- to 5-grams, with blanks at both ends; grams are hashed into
``BUCKETS`` rows. Of a text, each distinct word counts once. A window of ``WINDOW`` such words is their mean and goes through a softmax
over two classes; a text scores as its most toxic window, so that length doesn't dilute a score.
Embeddings and softmax learn together by Adam on the cross-entropy of the texts' labels. An unseen
misspelling shares most grams, and so most of its vector, with the word it hides.

For scoring, a word is one number per class (its vector times the softmax), kept in a bounded table.

How much weights decay is chosen on a fifth of the sample that is held back (``fit_checked``), since few
labelled rows are soon learnt by heart; the model is then fitted on all of it.

Fitting uses a bounded, documented sample: at most ``rows_per_class`` labelled rows of each class,
chosen by a hash of the id, among texts of at most ``max_bytes``; each text is used whole.

Defined cases: null, empty and wordless texts get the score of the prior alone; labels that are
null or neither 0 nor 1 are ignored; with fewer than two classes every score is next to 0.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import map_slices, text_column, texts, with_struct
from pithy.llm.language_id import char_codes, gram_hashes

BUCKETS, DIM, WINDOW = 1 << 16, 8, 8
TABLE_WORDS = 300_000
KEPT_CHARS = 48
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def cut(text: str) -> list[str]:
    """The distinct lower-cased words between spaces, in the order of their first use: a word that is repeated at length weighs once."""
    return list(dict.fromkeys(text.lower().split()))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of all words in one array, and the number of them per word (1 at least)."""
    bare = [_EDGE.sub("", w).replace(" ", "") or "." for w in words]
    codes = char_codes(bare)
    depth, hashes = gram_hashes(codes)
    at = np.arange(len(codes))
    word = np.cumsum(codes == 32) - 1
    word = np.where(codes == 32, word - 1, word)
    owner, found = [], []
    for k in (3, 4, 5):
        ok = at[(depth >= k - 1) & (at > 0)]
        h = hashes[k - 1][ok] * np.uint64(0x94D049BB133111EB) + np.uint64(k)
        owner.append(word[ok])
        found.append((h >> np.uint64(48)).astype(np.int64) % BUCKETS)
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return found[order], counts


@dataclass
class Model:
    """Embeddings, softmax weights and biases of the two classes."""

    table: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def word_logits(self, words: list[str]) -> np.ndarray:
        """Per word the part of each class's logit."""
        per_gram = self.table @ self.weight
        found, counts = grams(words)
        owner = np.repeat(np.arange(len(words)), counts)
        return np.stack([np.bincount(owner, per_gram[found, c], len(words)) / np.maximum(counts, 1) for c in (0, 1)], axis=1)


def best_windows(values: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ``lens`` values the largest mean of a window, its first index and its length; empty runs get 0, 0, 0."""
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    width = np.minimum(lens, WINDOW)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    owner = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(values))
    fits = at + width[owner] <= starts[owner] + lens[owner]
    means = np.where(fits, (total[np.minimum(at + width[owner], len(values))] - total[at]) / np.maximum(width[owner], 1), -np.inf)
    best, first = np.zeros(len(lens)), np.zeros(len(lens), np.int64)
    full = np.flatnonzero(lens > 0)
    if len(full):
        best[full] = np.maximum.reduceat(means, starts[full])
        hit = np.flatnonzero(means == best[owner])
        own, at_first = np.unique(owner[hit], return_index=True)
        first[own] = hit[at_first]
    return best, first, width


def fit(rows: list[tuple[str, int]], *, steps: int = 60, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """A model of (text, 0 or 1) rows."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2))
    y = np.array([c for _, c in rows], np.float64)
    if len({*y.tolist()}) < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.array([50.0, -50.0]))
    place: dict[str, int] = {}
    per_text = [np.fromiter((place.setdefault(w, len(place)) for w in cut(t)), np.int64) for t, _ in rows]
    lens = np.array([len(p) for p in per_text])
    flat = np.concatenate(per_text)
    found, counts = grams(list(place))
    owner = np.repeat(np.arange(len(place)), counts)
    share = 1.0 / np.maximum(counts, 1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    some = counts > 0
    state = {k: (np.zeros_like(v, np.float64), np.zeros_like(v, np.float64)) for k, v in (("table", model.table), ("weight", model.weight), ("bias", model.bias))}
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, steps + 1):
        vectors = np.zeros((len(place), DIM))
        vectors[some] = np.add.reduceat(model.table[found], starts[some], axis=0)
        vectors *= share[:, None]
        logits = vectors @ model.weight
        margin = (logits[:, 1] - logits[:, 0])[flat]
        best, first, width = best_windows(margin, lens)
        p = 1 / (1 + np.exp(-(best + model.bias[1] - model.bias[0])))
        g = balance * (p - y) / len(y)
        per_word = np.zeros(len(place))
        for k in range(WINDOW):  # the words of each text's best window
            on = width > k
            np.add.at(per_word, flat[first[on] + k], (g / np.maximum(width, 1))[on])
        touched = np.flatnonzero(per_word)
        both = np.outer(per_word[touched], (-1.0, 1.0))
        grad_weight = vectors[touched].T @ both
        grad_word = np.zeros((len(place), DIM))
        grad_word[touched] = both @ model.weight.T * share[touched, None]
        live = np.isin(owner, touched) if len(touched) < len(place) // 2 else slice(None)
        rows_of, grams_of = owner[live], found[live]
        grad_table = np.stack([np.bincount(grams_of, grad_word[rows_of, d], BUCKETS) for d in range(DIM)], axis=1)
        for name, grad in (("table", grad_table + decay * model.table), ("weight", grad_weight), ("bias", np.array([-g.sum(), g.sum()]))):
            m, v = state[name]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            now = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            setattr(model, name, (getattr(model, name) - now).astype(getattr(model, name).dtype))
    return model


class Scorer:
    """Scores texts with a bounded table of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.values = np.zeros(0)

    def score(self, many: list[str]) -> np.ndarray:
        words = [cut(t) for t in many]
        new = set().union(*words).difference(self.row)
        if len(self.row) + len(new) > TABLE_WORDS:
            self._clear()
            new = set().union(*words)
        if new:
            some = list(new)
            logits = self.model.word_logits(some)
            self.row.update(zip(some, range(len(self.values), len(self.values) + len(some)), strict=True))
            self.values = np.concatenate([self.values, logits[:, 1] - logits[:, 0]])
        lens = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((self.row[w] for part in words for w in part), np.int64, int(lens.sum()))
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del self.row[w]
        best, _, _ = best_windows(self.values[flat], lens)
        return 1 / (1 + np.exp(-np.clip(best + self.model.bias[1] - self.model.bias[0], -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows_per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts; the labels drawn are few enough to broadcast."""
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), label.alias("__y")).where("__y in (0, 1) and __id is not null")
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    span = 1 << 20
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(span, -(-span * rows_per_class // n)))])
    drawn = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(span)) < F.element_at(share, F.col("__y"))).limit(2 * rows_per_class * len(counts))
    drawn = drawn.groupBy("__id").agg(F.max("__y").alias("__y"))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text_column(docs, text_col).alias("__t")).where(F.octet_length("__t").between(1, max_bytes))
    got = rows.join(F.broadcast(drawn), "__id").limit(2 * rows_per_class * len(counts)).collect()
    got.sort(key=lambda r: (str(r["__id"]), r["__t"]))
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        out += [(r["__t"], y) for r in got if r["__y"] == y][:rows_per_class]
    return out


#: (weight decay, steps) that are tried in turn: little decay for many labelled rows, much for few; with a held-back
#: loss below ``GOOD`` the rest aren't tried.
FITS, GOOD = ((1e-5, 60), (3e-3, 100)), 0.1


def fit_checked(rows: list[tuple[str, int]]) -> Model:
    """The model of all rows, with the decay that has the least balanced loss on a fifth of them, held back by a hash of the text."""
    part = [zlib.crc32(t.encode("utf-8", "replace")) % 5 == 0 for t, _ in rows]
    learn, back = ([r for r, p in zip(rows, part, strict=True) if p == side] for side in (False, True))
    best = FITS[0]
    if min(len({y for _, y in some}) for some in (learn, back)) == 2 and len(back) >= 50:
        y, least = np.array([c for _, c in back]), np.inf
        for decay, steps in FITS:
            p = np.clip(Scorer(fit(learn, steps=steps, decay=decay)).score([t for t, _ in back]), 1e-6, 1 - 1e-6)
            loss = -np.log(p[y == 1]).mean() - np.log(1 - p[y == 0]).mean()
            if loss < least:
                best, least = (decay, steps), loss
            if least < GOOD:
                break
    return fit(rows, decay=best[0], steps=best[1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 2500, max_bytes: int = 16 << 10) -> Model:
    """The model of a bounded sample of labelled rows."""
    return fit_checked(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows_per_class=rows_per_class, max_bytes=max_bytes))


def score(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score", label_col: str = "predicted") -> DataFrame:
    """``df`` with the score (0 to 1) and the label at 0.5 of each text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def scorer() -> Scorer:
        if "s" not in held:
            held["s"] = Scorer(sent.value)
        return held["s"]

    udf = map_slices(lambda part, s: pa.array(s.score(texts(part)), type=pa.float64()), T.DoubleType(), scorer)
    out = with_struct(df, F.struct(udf(text_column(df, text_col)).alias("s")), {score_col: "s"}, drop=(label_col,))
    return out.withColumn(label_col, (F.col(score_col) >= 0.5).cast("int"))
