"""Repeated passages by sparse suffix arrays.

Words are split at ASCII white space and A-Z lower-cased. Of each window of ``MIN_WORDS`` words the
smallest hash among its ``GRAM``-word grams is its minimiser (the first if equal), so two passages of
``MIN_WORDS`` equal words always share a minimiser position. Only suffixes at those positions are
retained, and of them only those whose gram occurs again anywhere (counted over all documents).

The retained suffixes are range-sorted by (gram, following words, document, position); with the
document in the key no gram, however frequent, must stay in one task. Of the suffixes of a gram that
a task holds together (up to ``GROUP``), all windows of ``MIN_WORDS`` words around the gram are
compared. Where a partition or a group ends and its gram may go on beyond, each window that can reach
over the border (equal windows have equal words to the right, so the border's record has them too)
leaves the task once, with the first document that has it. The windows of a record leave in few rows,
one for each range of ``EDGES`` that their words left of the gram fall in, under a hash of the words
that all windows of the row have left of the gram. Equal windows have equal such words, so only rows
whose hash another document has too are laid out window by window, and these are grouped by hash.
So the result doesn't depend on ``SEGMENT``, ``GROUP``, ``EDGES`` or the partitions.

Of two equal passages the one with the smaller (document, position) stays, so the first occurrence
of any passage is never cut. Equal whole texts are one class; only the smallest id is sorted, and a
copy of at least ``MIN_WORDS`` words is one passage from first to last word.

Matches inside one document don't count. Defined cases: null, empty and shorter texts have no
passages; ids must be unique, rows with a null id have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import evaluated_once, map_slices, raw, release, struct_array, struct_type, text_column, with_struct
from pithy.llm.near_dup import Shingler, mix
from pithy.llm.tables import shared_dir, with_class, written

MIN_WORDS, GRAM = 50, 8
WINDOW = MIN_WORDS - GRAM + 1
_U = np.uint64

ANCHORS = struct_type(n_words=T.LongType(), pos=T.ArrayType(T.IntegerType()), gram=T.ArrayType(T.LongType()))
SUFFIX = "gram long, after binary, before binary, id long, pos int"
FOUND = "id long, start int, end int, src long, gram long, context long, starts array<int>, ends array<int>, windows array<long>"
#: Words left of the gram at which the rows of open windows begin.
EDGES = (0, 1, 2, *range(4, WINDOW, 4))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    n = len(words) - GRAM + 1
    h = mix(words[:n] + _U(17))
    for k in range(1, GRAM):
        h = mix(h + words[k : k + n])
    return h


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the minimisers of all windows."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(words)
    best = []
    for at in range(0, len(h) - WINDOW + 1, 1 << 16):  # pieces of long texts, to bound memory
        part = h[at : at + (1 << 16) + WINDOW - 1]
        best.append(at + np.arange(len(part) - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(part, WINDOW).argmin(1))
    pos = np.unique(np.concatenate(best))
    return pos, h[pos]


def _anchor_slice(part: pa.Array, shingler: Shingler) -> pa.Array:
    n, pos, gram = [], [], []
    for text in raw(part):
        w = shingler.words(text)
        p, g = minimisers(w)
        n.append(len(w))
        pos.append(p.astype(np.int32))
        gram.append(g.view(np.int64))
    return struct_array(ANCHORS, n, pos, gram)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix records of (id, text, pos list): words after and before each position as big-endian 32-bit hashes."""
    shingler = Shingler()
    names = ["gram", "after", "before", "id", "pos"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            out: list[list] = [[], [], [], [], []]
            for i, text, places in zip(part["id"].to_pylist(), raw(part["text"]), part["pos"].to_pylist(), strict=True):
                w = shingler.words(text)
                h = gram_hashes(w).view(np.int64)
                short = (w >> _U(32)).astype(">u4")
                back = np.ascontiguousarray(short[::-1])
                fore, rear, n = short.tobytes(), back.tobytes(), len(w)
                for p in places:
                    out[0].append(int(h[p]))
                    out[1].append(fore[4 * p : 4 * (p + MIN_WORDS)])
                    out[2].append(rear[4 * (n - p) : 4 * (n - p + WINDOW - 1)])
                    out[3].append(i)
                    out[4].append(p)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=names)
    del shingler
    release()


def _matrix(values: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 32-bit words, padded, and their lengths."""
    lens = np.array([len(v) // 4 for v in values], np.int64)
    return np.frombuffer(b"".join(v.ljust(4 * wide, b"\0") for v in values), np.uint32).reshape(-1, wide), lens


class Records:
    """Suffix records of a batch."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.gram = np.array([r[0] for r in rows], np.int64)
        self.after, self.n_after = _matrix([r[1] for r in rows], MIN_WORDS)
        self.before, self.n_before = _matrix([r[2] for r in rows], WINDOW - 1)
        self.id = np.array([r[3] for r in rows], np.int64)
        self.pos = np.array([r[4] for r in rows], np.int64)

    def common(self, i: np.ndarray, border: int) -> np.ndarray:
        """Equal words to the right of records i and of one more."""
        same = self.after[i] == self.after[border]
        run = np.where(same.all(1), MIN_WORDS, same.argmin(1))
        return np.minimum(run, np.minimum(self.n_after[i], self.n_after[border]))


class Marks:
    """For each record the passage around it that an earlier document has too."""

    def __init__(self, recs: Records):
        n = len(recs.rows)
        self.recs, self.lo, self.hi, self.src = recs, np.full(n, 1 << 40), np.full(n, -1), np.full(n, np.iinfo(np.int64).max)

    def add(self, late, start, end, src) -> None:
        np.minimum.at(self.lo, late, start)
        np.maximum.at(self.hi, late, end)
        np.minimum.at(self.src, late, src)

    def rows(self) -> list[tuple]:
        hit = np.flatnonzero(self.hi >= 0)
        return list(zip(self.recs.id[hit].tolist(), self.lo[hit].tolist(), self.hi[hit].tolist(), self.src[hit].tolist(), strict=True))


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row."""
    out = np.zeros((m.shape[1] + 1, len(m)), np.uint64)
    for k in range(m.shape[1]):
        out[k + 1] = mix(out[k] + m[:, k].astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    return out


def _windows(marks: Marks, reach: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Exact check among records that are at hand together: all windows of MIN_WORDS words around each gram.

    All windows containing the gram lie in one interval, so their union is again one passage.

    ``reach``: how many words to the right a record shares with one at an open border. Yields (id,
    start, end, gram, context, window) of the windows within reach, each as its first document here has
    it (places that touch are one); the others that have it are marked.
    """
    r = marks.recs
    order = np.lexsort((r.pos, r.id))  # then the first of equal windows is the earliest
    before, after, gram = _prefixes(r.before[order]), _prefixes(r.after[order]), mix(r.gram[order].view(np.uint64))
    ids, pos, n_before, n_after = r.id[order], r.pos[order], r.n_before[order], r.n_after[order]
    for left in range(WINDOW):
        right = MIN_WORDS - left
        ok = np.flatnonzero((n_before >= left) & (n_after >= right))
        if not len(ok):
            continue
        key = mix(before[left][ok] ^ gram[ok]) + after[right][ok]
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        head = ok[first[of]]
        late = ids[head] != ids[ok]
        at = ok[late]
        marks.add(order[at], pos[at] - left, pos[at] + right, ids[head[late]])
        out = ~late & (reach[order[ok]] >= right)
        at = ok[out]
        if not len(at):
            continue
        by = np.argsort(key[out], kind="stable")
        at, key, start = at[by], key[out][by], pos[at[by]] - left
        cut = np.flatnonzero((key[1:] != key[:-1]) | (start[1:] > start[:-1] + MIN_WORDS))  # a line that repeats overlaps itself
        head, tail = np.append(0, cut + 1), np.append(cut, len(at) - 1)
        edge = max(e for e in EDGES if e <= left)
        context = mix(before[edge][at[head]] + _U(edge + 1))
        yield ids[at[head]], start[head], start[tail] + MIN_WORDS, r.gram[order[at[head]]], context.view(np.int64), key[head].view(np.int64)


def _packed(open_: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Open windows by (id, gram, context): these three of each row, where the rows begin, and (start, end, window) in the order of rows."""
    ids, start, end, gram, context, window = (np.concatenate(c) for c in zip(*open_, strict=True))
    by = np.lexsort((context, gram, ids))
    ids, gram, context = ids[by], gram[by], context[by]
    new = np.append(True, (ids[1:] != ids[:-1]) | (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
    begin = np.flatnonzero(new)
    return [ids[begin], gram[begin], context[begin]], np.append(begin, len(ids)).astype(np.int32), [start[by].astype(np.int32), end[by].astype(np.int32), window[by]]


def _reach(recs: Records, low: bool, high: bool) -> np.ndarray:
    """Words to the right that records share with the first or last one, where the stream may go on beyond it with the same gram."""
    reach = np.zeros(len(recs.rows), np.int64)
    for border, is_open in ((0, low), (len(recs.rows) - 1, high)):
        if is_open:
            at = np.flatnonzero(recs.gram == recs.gram[border])
            reach[at] = np.maximum(reach[at], recs.common(at, border))
    return reach


#: Records that are compared together, and the most of one gram.
SEGMENT, GROUP = 4096, 1 << 15


def segments(batches: Iterator[list[tuple]], segment: int = SEGMENT, group: int = GROUP) -> Iterator[tuple[list[tuple], bool, bool]]:
    """Rows of a sorted stream, cut between grams where the rows of a gram are at most ``group``; and whether the first or the last gram may go on outside them."""
    held: list[tuple] = []
    low = True
    for rows in batches:
        held += rows
        while len(held) > segment:
            at = len(held) - 1
            while at > 0 and held[at][0] == held[at - 1][0]:
                at -= 1
            if at == 0:
                if len(held) < group:
                    break
                at = group
            if at == len(held):
                break
            within = held[at - 1][0] == held[at][0]
            yield held[:at], low, within
            held, low = held[at:], within
    if held:
        yield held, low, True


def compare_sorted(batches: Iterator[list[tuple]], segment: int = SEGMENT, group: int = GROUP) -> Iterator[tuple[list[tuple], list[tuple[np.ndarray, ...]]]]:
    """Passages (id, start, end, src) found in a sorted stream of suffix records, and windows (id, start, end, gram, context, window) that may be found beyond a border too."""
    for rows, low, high in segments(batches, segment, group):
        recs = Records(rows)
        marks = Marks(recs)
        open_ = list(_windows(marks, _reach(recs, low, high)))
        yield marks.rows(), open_


def _neighbours(batches: Iterator[pa.RecordBatch], segment: int, group: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in FOUND.split(", ")]
    batch_of = lambda cols, n: pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def rows():
        for batch in batches:
            for at in range(0, len(batch), segment):
                part = batch.slice(at, segment)
                yield list(zip(*[part[c].to_pylist() for c in ("gram", "after", "before", "id", "pos")], strict=True))

    for found, open_ in compare_sorted(rows(), segment, group):
        if found:
            yield batch_of([*zip(*found, strict=True), None, None, None, None, None], len(found))
        if open_:
            (ids, gram, context), begin, values = _packed(open_)
            lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(v)) for v in values]
            yield batch_of([ids, None, None, None, gram, context, *lists], len(ids))
    release()


def _merged(spans: pa.Array) -> pa.Array:
    """Unions of overlapping or touching spans (start, end, src), with the smallest source."""
    out = []
    for row in spans.to_pylist():
        merged: list[dict] = []
        for s in sorted(row, key=lambda s: (s["start"], s["end"], s["src"])):
            if merged and s["start"] <= merged[-1]["end"]:
                merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                merged[-1]["src"] = min(merged[-1]["src"], s["src"])
            else:
                merged.append(dict(s))
        out.append(merged)
    return pa.array(out, type=spans.type)


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """(id_col, spans, n_words) for each document with passages to cut: spans of words (start, end) with src, a document that has them earlier."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(docs, text_col).alias("text")).where("id is not null and text is not null")
    keyed = base.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    classes = written(keyed.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), f"{folder}/classes")
    firsts = written(classes.select(F.col("first").alias("id")), f"{folder}/firsts")
    anchors = written(with_struct(base, map_slices(_anchor_slice, ANCHORS, Shingler, once=True)(F.col("text")), {"n_words": "n_words", "pos": "pos", "gram": "gram"}, drop=("text",)).where(f"n_words >= {MIN_WORDS}").join(firsts, "id", "left_semi"), f"{folder}/anchors")
    each = anchors.select("id", F.explode(F.arrays_zip("pos", "gram")).alias("a")).select("id", "a.pos", "a.gram")
    again = written(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), f"{folder}/again")
    places = written(each.join(again, "gram", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("pos")), f"{folder}/places")
    suffixes = written(base.join(places, "id").select("id", "text", "pos").mapInArrow(_suffixes, SUFFIX), f"{folder}/suffixes")
    order = ["gram", "after", "id", "pos"]
    found = written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _neighbours(batches, segment, group), FOUND), f"{folder}/found")
    rows = found.where("src is null").select("id", "gram", "context", "starts", "ends", "windows")
    contexts = rows.groupBy("gram", "context").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    contexts = written(contexts.select("gram", "context", "n", F.lit(True).alias("again")), f"{folder}/contexts")
    laid = with_class(rows, contexts, ["gram", "context"], "n").where("again").select("id", "gram", F.explode(F.arrays_zip("starts", "ends", "windows")).alias("w"))
    open_ = written(laid.select("id", "gram", F.col("w.starts").alias("start"), F.col("w.ends").alias("end"), F.col("w.windows").alias("window")), f"{folder}/open")
    shared = written(open_.groupBy("gram", "window").agg(F.min("id").alias("src"), F.max("id").alias("last")).where("src < last").drop("last"), f"{folder}/shared")
    beyond = open_.join(shared, ["gram", "window"]).where("id > src")
    hits = found.where("src is not null").select("id", "start", "end", "src").unionByName(beyond.select("id", "start", "end", "src"))
    span = F.struct("start", "end", "src")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("src", T.LongType())]))
    _merged.__annotations__ = {"spans": pa.Array, "return": pa.Array}
    merged = hits.groupBy("id").agg(F.collect_set(span).alias("s")).select("id", F.arrow_udf(_merged, kind)("s").alias("spans"))
    sizes = anchors.select("id", "n_words")
    cut = merged.join(sizes, "id")
    # copies of whole texts: every id but the first of its class
    long = written(classes.where("copies > 1").join(sizes.select(F.col("id").alias("first"), "n_words"), "first").select("k1", "k2", "first", "n_words", "copies"), f"{folder}/long")
    copies = with_class(keyed, long, ["k1", "k2"], "copies").where("first is not null and id <> first")
    whole = copies.select("id", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), F.col("first").alias("src"))).alias("spans"), "n_words")
    return cut.select("id", "spans", "n_words").unionByName(whole).withColumnRenamed("id", id_col)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans; white space before a cut passage goes with it."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    out = []
    for text, cuts in zip(raw(texts), spans.to_pylist(), strict=True):
        if text is None or not cuts:
            out.append(text)
            continue
        places = [m.span() for m in word.finditer(text)]
        kept, at = [], 0
        for s in cuts:
            kept.append(text[at : places[s["start"]][0]].rstrip(b" "))
            at = places[s["end"] - 1][1]
        kept.append(text[at:])
        out.append(b"".join(kept))
    return pa.array(out, type=pa.binary()).cast(pa.string())


def cut_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text; documents of which no word is left are dropped."""
    spark = docs.sparkSession
    found = written(passages(docs, id_col=id_col, text_col=text_col), f"{shared_dir(spark)}/passages").select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    _cut.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    joined = docs.join(found, docs[id_col].cast("long") == found["__id"], "left")
    after = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(evaluated_once(F.arrow_udf(_cut, T.StringType()))(text_col, "__spans"))
    done = joined.withColumn(text_col, after).where(F.col("__spans").isNull() | F.col(text_col).rlike(r"[^ \t-\r]"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
