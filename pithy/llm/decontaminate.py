"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Texts are normalised on their UTF-8 bytes: A-Z become a-z and every ASCII byte that is neither a
digit nor a letter separates words, so bytes of other scripts always belong to words. An item
gives all its windows of ``window`` consecutive words; an item with fewer words (but not none) is
one window. Each text is normalised and scanned once; every match marks the words it covers, and
marked runs are mapped back to character offsets in the original text.

The automaton is broadcast, so its size is proven first, by the bytes of all windows. A benchmark
whose windows take at most ``max_block_bytes`` is one automaton, and rows are scanned in one narrow
stage. A larger one is dealt by a hash into blocks of that size, and each block has a pass over the
rows of its own: it is collected, broadcast, scanned and given up before the next one, and leaves
only the marks of the rows that it hits. Driver and workers never hold more than one block.

Defined cases: null or empty text has no words and no hits; items without id or without words are
ignored; repeated items or ids count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import map_slices, raw, struct_array, struct_type, text_column, with_struct
from pithy.llm.tables import shared_dir, written

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SPAN = struct_type(first_word=T.LongType(), end_word=T.LongType(), start=T.LongType(), end=T.LongType())
RESULT = struct_type(n_words=T.LongType(), spans=T.ArrayType(SPAN), items=T.ArrayType(T.StringType()))


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of UTF-8 bytes."""
    return text.translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Block:
    """Patterns of one block: normalised window, its number of words, the ids of its items."""

    patterns: tuple[tuple[str, int, tuple[str, ...]], ...]

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for text, n, items in self.patterns:
            auto.add_word(text, (n, items))
        if len(auto):
            auto.make_automaton()
        return auto


def build_block(rows: list[tuple[str, bytes]], window: int) -> Block:
    """Windows of (id, text) items; equal windows of several items are one pattern."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in rows:
        words = words_of(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            part = words[at : at + window]
            key = " " + b" ".join(part).decode("latin-1") + " "
            found.setdefault(key, (len(part), set()))[1].add(item)
    return Block(tuple((k, n, tuple(sorted(ids))) for k, (n, ids) in sorted(found.items())))


def scan(text: bytes | None, autos: list) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
    """Number of words, marked runs with character offsets, sorted ids of the items that occur."""
    words = words_of(text)
    if not words:
        return 0, [], []
    hay = " " + b" ".join(words).decode("latin-1") + " "
    ends: list[tuple[int, int]] = []
    items: set[str] = set()
    for auto in autos:
        if len(auto):
            for end, (n, ids) in auto.iter(hay):
                ends.append((end, n))
                items.update(ids)
    if not ends:
        return len(words), [], []
    ends.sort()
    runs: list[list[int]] = []
    word, seen = 0, 0
    for end, n in ends:
        word += hay.count(" ", seen, end)  # spaces before the closing one: words that have ended, plus one
        seen = end
        last = word
        if runs and last - n <= runs[-1][1]:
            runs[-1][0] = min(runs[-1][0], last - n)
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([last - n, last])
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    places = [m.span() for m in _WORD.finditer(text)]
    spans, byte, char = [], 0, 0
    for a, b in merged:  # one walk over the text; words begin and end at ASCII bytes
        marks = []
        for end in (places[a][0], places[b - 1][1]):
            char += len(text[byte:end].decode("utf-8", "replace"))
            byte = end
            marks.append(char)
        spans.append((a, b, *marks))
    return len(words), spans, sorted(items)


def item_rows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), text_column(benchmark, text_col).alias("text"))
    return rows.where("item is not null and text is not null")


def block_count(rows: DataFrame, window: int, max_block_bytes: int) -> int:
    """Number of blocks whose windows take at most about ``max_block_bytes``: a text gives windows of ``window`` times its bytes at most."""
    total = rows.agg(F.sum(F.octet_length("text") * window + 64)).first()[0] or 0
    return -(-total // max_block_bytes)


def load_block(rows: DataFrame, k: int, n: int, window: int) -> Block:
    """Block k of n, collected alone."""
    some = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
    return build_block([(r.item, r.text.encode()) for r in some.toLocalIterator()], window)


def _scanned(docs: DataFrame, text: Column, sent) -> DataFrame:
    """``docs`` with n_words, spans and items by the automaton of a broadcast block."""
    held: dict = {}

    def automata():
        if "autos" not in held:
            held["autos"] = [sent.value.automaton()]
        return held["autos"]

    def run(part: pa.Array, autos) -> pa.Array:
        out = [scan(t, autos) for t in raw(part)]
        spans = [[dict(zip(("first_word", "end_word", "start", "end"), s, strict=True)) for s in o[1]] for o in out]
        return struct_array(RESULT, [o[0] for o in out], spans, [o[2] for o in out])

    return with_struct(docs, map_slices(run, RESULT, automata)(text), {"n_words": "n_words", "spans": "spans", "items": "items"})


def _union(spans: pa.Array) -> pa.Array:
    """Spans of several blocks as one list without overlaps."""
    out = []
    for row in spans.to_pylist():
        merged: list[dict] = []
        for s in sorted(row, key=lambda s: (s["first_word"], s["end_word"])):
            if merged and s["first_word"] <= merged[-1]["end_word"]:
                merged[-1]["end_word"], merged[-1]["end"] = max(merged[-1]["end_word"], s["end_word"]), max(merged[-1]["end"], s["end"])
            else:
                merged.append(s)
        out.append(merged)
    return pa.array(out, type=spans.type)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word range and character range of each marked run) and ``items`` (ids that occur)."""
    spark = docs.sparkSession
    rows = item_rows(benchmark, item_col, item_text_col)
    n = block_count(rows, window, max_block_bytes)
    if n <= 1:
        return _scanned(docs, text_column(docs, text_col), spark.sparkContext.broadcast(load_block(rows, 0, 1, window)))
    folder, key = shared_dir(spark), "__pithy_row"
    numbered = written(docs.withColumn(key, F.monotonically_increasing_id()), f"{folder}/rows")
    narrow = numbered.select(key, text_column(docs, text_col).alias("text"))
    marks = None
    for k in range(n):
        sent = spark.sparkContext.broadcast(load_block(rows, k, n, window))
        found = _scanned(narrow, F.col("text"), sent).select(key, "n_words", "spans", "items")
        found = written(found if k == 0 else found.where(F.size("spans") > 0), f"{folder}/marks{k}")  # the first pass has the words of all rows
        sent.destroy()
        marks = found if marks is None else marks.unionByName(found)
    _union.__annotations__ = {"spans": pa.Array, "return": pa.Array}
    whole = marks.groupBy(key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.select(key, "n_words", F.arrow_udf(_union, T.ArrayType(SPAN))("s").alias("spans"), "items")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    return numbered.select(key, *[F.col(f"`{c}`") for c in kept]).join(whole, key).drop(key)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["first_word"])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
