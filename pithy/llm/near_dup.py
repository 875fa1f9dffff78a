"""MinHash near-duplicates by HyperMinHash sketches.

1. Each text gives the set of its distinct 3-word shingles as 64-bit hashes. The set is split over
   ``REGISTERS`` buckets; a bucket keeps the leading zeros of its smallest value and the ``MANTISSA``
   bits after them (16 bits together). Empty buckets borrow a filled one by a fixed random order, so
   that a register agrees with the probability of the Jaccard similarity for small sets too.
2. Texts with equal sets form one class; only its smallest id goes on (a combined aggregate, so a
   group of copies of any size becomes one row before the shuffle).
3. ``BANDS`` bands of compressed registers are hashed. Nodes that share no band with any other are
   done; the sets of the others are written once, and only these are moved again.
4. Within a band's bucket every member is paired with one centre, drawn by a hash for each bucket,
   never with all the others. A pair whose Jaccard estimate from the registers, corrected for the
   accidental agreement of compressed registers, is within its margin of the threshold is confirmed
   on the full sets. Confirmed links make components.
5. Buckets that hold more than one component are finished exactly: their members are dealt into
   blocks of bounded size, and every pair of blocks meets in one task with sketches and sets. Pairs
   of different components whose sizes allow the similarity are estimated, and those within the
   margin confirmed, each in the first band that it shares; only the links that join components (a
   forest) leave the task.

So every pair that shares a band either ends in one component or has been compared. A pair at the
threshold misses all bands with a probability of about (1 - 0.85^5)^32 = 7e-9, and fails the
estimate's margin (five standard deviations) with less than 1e-6.

Defined cases: A-Z are lower-cased on bytes; words are split at bytes 0x09-0x0D and 0x20; a text with
one or two words is one shingle; null, empty and wordless texts have no shingle and stay alone. Rows
that repeat an id count as one document with several texts. Rows with a null id are linked with
nothing: they have no component and aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import map_slices, raw, release, struct_array, struct_type, text_column, with_struct
from pithy.llm.components import connected
from pithy.llm.tables import dropped, shared_dir, with_class, written

SHINGLE = 3
REGISTERS, MANTISSA = 160, 10
BANDS, ROWS = 32, 5
THRESHOLD_PERCENT = 85
MARGIN = 0.14
#: Members of a block, and shingles of all of them together.
BLOCK, BLOCK_SHINGLES = 256, 100_000
TABLE_WORDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
SKETCH = struct_type(n_shingles=T.LongType(), h1=T.LongType(), h2=T.LongType(), sketch=T.BinaryType())
SET = struct_type(n=T.LongType(), sketch=T.BinaryType(), shingles=T.BinaryType())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of shingle hashes, with a bounded table of word hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes | None) -> np.ndarray:
        words = text.translate(_LOWER).split() if text else []
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > TABLE_WORDS:
            known.clear()
        return out

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        w = self.words(text)
        if not len(w):
            return w
        if len(w) < SHINGLE:
            short = mix(w[0] + _U(1)) if len(w) == 1 else mix(mix(w[0] + _U(2)) + w[1])
            return np.array([short], np.uint64)
        s = mix(w[:-2] * _U(0x9E3779B97F4A7C15) + _U(3))
        s = mix(s + w[1:-1])
        s = np.sort(mix(s + w[2:]))
        return s[np.append(True, s[1:] != s[:-1])]


def _probes(n: int) -> np.ndarray:
    """For each bucket a fixed random order of buckets to borrow from."""
    rng = np.random.default_rng(20240611 + n)
    return np.stack([rng.permutation(n)[:256] for _ in range(n)]).astype(np.int16)


_PROBES = {REGISTERS: _probes(REGISTERS)}


def buckets_of(shingles: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each of n buckets; empty ones borrow."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    bucket = (shingles % _U(n)).astype(np.int64)
    np.minimum.at(least, bucket, mix(shingles ^ _U(0xD6E8FEB86659FD93 + n)))
    full = np.zeros(n, bool)
    full[bucket] = True
    empty, filled = np.flatnonzero(~full), least.copy()
    for turn in range(_PROBES[n].shape[1]):
        if not len(empty):
            break
        place = _PROBES[n][empty, turn]
        hit = full[place]
        filled[empty[hit]] = least[place[hit]]
        empty = empty[~hit]
    if len(empty):  # small sets: the shingle that is least for this bucket, which equal shingles choose alike
        value = mix(shingles ^ _U(0xD6E8FEB86659FD93 + n))
        for at in range(0, len(empty), 256):
            some = empty[at : at + 256]
            draw = mix(shingles[:, None] + mix(some.astype(np.uint64) + _U(n))[None])
            filled[some] = value[draw.argmin(0)]
    return filled


def compress(value: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa bits after them."""
    zeros = np.zeros(len(value), np.uint64)
    v = value.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        low = v < (_U(1) << _U(64 - shift))
        zeros[low] += _U(shift)
        v[low] <<= _U(shift)
    zeros = np.minimum(zeros, _U(53))
    return ((zeros << _U(MANTISSA)) | ((v << _U(1)) >> _U(64 - MANTISSA))).astype(np.uint16)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Densified registers of a set that isn't empty."""
    return compress(buckets_of(shingles, REGISTERS))


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of these sizes agree: equal leading zeros, then equal mantissas."""
    lz = np.arange(55)[:, None]
    at_least = lambda n: 1 - (1 - 2.0**-lz) ** np.maximum(1.0, n / REGISTERS)
    pa_, pb = at_least(na), at_least(nb)
    return ((pa_[:-1] - pa_[1:]) * (pb[:-1] - pb[1:])).sum(0) * 2.0**-MANTISSA


def estimate(agree: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, without the accidental ones."""
    c = chance(na, nb)
    return np.clip((agree - c) / (1 - c), 0, 1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact criterion on two sorted sets."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < THRESHOLD_PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD_PERCENT * (len(a) + len(b) - both)


def _sketch_slice(part: pa.Array, shingler: Shingler) -> pa.Array:
    n, h1, h2, out = [], [], [], []
    for text in raw(part):
        s = shingler.shingles(text)
        n.append(len(s))
        one, two = (int(mix(s + _U(k)).sum(dtype=np.uint64)) if len(s) else 0 for k in (11, 13))
        h1.append(one - (1 << 64) if one >> 63 else one)
        h2.append(two - (1 << 64) if two >> 63 else two)
        out.append(sketch_of(s).tobytes() if len(s) else None)
    return struct_array(SKETCH, n, h1, h2, out)


def _set_slice(part: pa.Array, shingler: Shingler) -> pa.Array:
    sets = [shingler.shingles(text) for text in raw(part)]
    return struct_array(SET, [len(s) for s in sets], [sketch_of(s).tobytes() if len(s) else None for s in sets], [s.tobytes() for s in sets])


def sketches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_shingles, the 128-bit hash (h1, h2) of the set and the sketch."""
    made = with_struct(docs, map_slices(_sketch_slice, SKETCH, Shingler)(text_column(docs, text_col)), {k: k for k in SKETCH.names}, drop=(text_col,))
    return made


class Members:
    """Some sets with their sketches, compared in numpy."""

    def __init__(self, sketches: list[bytes], sets: list[bytes]):
        self.sets = [np.frombuffer(x, np.uint64) for x in sets]
        self.n = np.array([len(x) for x in self.sets], np.int64)
        self.regs = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, REGISTERS)

    def likely(self, i: np.ndarray, other: Members, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i of these, j of the others) have sizes that allow the similarity and an estimate within the margin."""
        na, nb = self.n[i], other.n[j]
        ok = 100 * np.minimum(na, nb) >= THRESHOLD_PERCENT * np.maximum(na, nb)
        at = np.flatnonzero(ok)
        if len(at):
            ok[at] = estimate((self.regs[i[at]] == other.regs[j[at]]).mean(1), na[at].astype(float), nb[at].astype(float)) >= THRESHOLD_PERCENT / 100 - MARGIN
        return ok


def links_of(xs: list[dict], ys: list[dict], band: int) -> list[dict]:
    """Links that join different components among the members (id, comp, sketch, shingles) of two blocks, or of one (xs is ys).

    Components that are joined here count as one from then on, so the links are a forest.
    """
    a = Members([m["sketch"] for m in xs], [m["shingles"] for m in xs])
    b = a if xs is ys else Members([m["sketch"] for m in ys], [m["shingles"] for m in ys])
    ia, ib, ca, cb = (np.array([m[k] for m in ms], np.int64) for k in ("id", "comp") for ms in (xs, ys))
    out = []
    for i in range(len(xs)):
        j = np.flatnonzero((cb != ca[i]) & (ib > ia[i]) if xs is ys else cb != ca[i])
        if len(j):
            j = j[a.likely(np.full(len(j), i), b, j)]
        if len(j):
            same = (b.regs[j] == a.regs[i])[:, : BANDS * ROWS].reshape(len(j), BANDS, ROWS).all(2)
            j = j[same.argmax(1) == band]
        for k in j.tolist():
            if cb[k] != ca[i] and linked(a.sets[i], b.sets[k]):
                out.append({"a": int(min(ia[i], ib[k])), "b": int(max(ia[i], ib[k]))})
                old, new = cb[k], ca[i]
                ca[ca == old], cb[cb == old] = new, new
    return out


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, id) of each band of each sketch."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * width + 1, F.lit(width))))
    return nodes.select("id", F.posexplode(keys).alias("band", "bucket"))


def confirmed(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate is within the margin and whose full sets fulfil the criterion."""

    def run(batches):
        for sa, sb, ta, tb in batches:
            a, b = Members(sa.to_pylist(), ta.to_pylist()), Members(sb.to_pylist(), tb.to_pylist())
            both = np.arange(len(a.n))
            ok = a.likely(both, b, both) if len(both) else np.zeros(0, bool)
            for k in np.flatnonzero(ok).tolist():
                ok[k] = linked(a.sets[k], b.sets[k])
            yield pa.array(ok, type=pa.bool_())
        release()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    side = lambda k: active.select(F.col("id").alias(k), F.col("sketch").alias(f"s{k}"), F.col("shingles").alias(f"t{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return met.select("a", "b", F.arrow_udf(run, T.BooleanType())("sa", "sb", "ta", "tb").alias("ok")).where("ok").select("a", "b").distinct()


def classes(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their set's hash, classes of equal sets with their smallest id and sketch), both written."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    all_ = written(sketches(base), f"{folder}/sketches")
    grouped = all_.where("n_shingles > 0 and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "sketch")).alias("m"), F.count(F.lit(1)).alias("copies"))
    return all_, written(grouped.select("h1", "h2", F.col("m.id").alias("id"), F.col("m.sketch").alias("sketch"), "copies"), f"{folder}/nodes")


def finish(members: DataFrame, active: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """Links that join the components of buckets that hold several."""
    now = members.join(known, "id", "left").select("bucket", "band", "id", F.coalesce("comp", "id").alias("comp"))
    now = written(now, f"{folder}/now")
    open_ = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    rest = written(now.join(open_, "bucket"), f"{folder}/rest")
    sized = rest.join(active.select("id", "n"), "id").groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    dealt = written(sized.select("bucket", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES)).alias("parts")), f"{folder}/dealt")
    block = F.pmod(F.xxhash64("id", "shingles"), F.col("parts")).alias("block")
    full = rest.join(dealt, "bucket").join(active, "id").select("bucket", "band", block, F.struct("id", "comp", "sketch", "shingles").alias("m"))
    blocks = written(full.groupBy("bucket", "band", "block").agg(F.collect_list("m").alias("m")), f"{folder}/blocks")
    kind = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    arrow = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for part_a, part_b, band, one in batches:
            out = []
            for k in range(len(part_a)):
                xs = part_a[k].as_py()
                out.append(links_of(xs, xs if one[k].as_py() else part_b[k].as_py(), band[k].as_py()))
            yield pa.array(out, type=arrow)
        release()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    other = blocks.select("bucket", F.col("block").alias("block2"), F.col("m").alias("m2"))
    alone = blocks.select("m", F.lit(None).cast(blocks.schema["m"].dataType).alias("m2"), "band", F.lit(True).alias("one"))
    across = blocks.join(other, "bucket").where("block < block2").select("m", "m2", "band", F.lit(False).alias("one"))
    met = alone.unionByName(across)
    links = written(met.select(F.explode(F.arrow_udf(run, kind)("m", "m2", "band", "one")).alias("p")).select("p.a", "p.b").distinct(), f"{folder}/links")
    dropped(links.sparkSession, *[f"{folder}/{x}" for x in ("now", "rest", "dealt", "blocks")])
    return links


def joined(known: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(id, comp) of all linked nodes after more links."""
    up = lambda k: known.select(F.col("id").alias(k), F.col("comp").alias(f"c{k}"))
    lifted = links.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    above = connected(lifted, f"{folder}/cc")
    every = known.unionByName(above.join(known.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp")))
    return written(every.join(above.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), f"{folder}/final")


def components(nodes: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """(id, comp) for each class that is linked with another; texts: (id, text) of all documents."""
    of_bucket = buckets(nodes)
    draw = F.col("id").bitwiseXOR(F.xxhash64("bucket"))  # the smallest draw gives the centre back
    full = of_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(draw).bitwiseXOR(F.xxhash64("bucket")).alias("centre")).where("size > 1")
    members = written(of_bucket.join(full, "bucket"), f"{folder}/members")
    wanted = written(members.select("id").distinct(), f"{folder}/wanted")
    found = texts.join(wanted, "id", "left_semi").select("id", map_slices(_set_slice, SET, Shingler)(F.col("text")).alias("s"))
    active = written(found.select("id", "s.n", "s.sketch", "s.shingles"), f"{folder}/active")
    star = written(members.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), f"{folder}/star")
    links = written(confirmed(star, active), f"{folder}/links")
    known = connected(links, f"{folder}/cc").select("id", "comp")
    more = finish(members.where("size > 2").drop("centre", "size"), active, known, f"{folder}/rest")
    final = joined(known, more, f"{folder}/joined")
    dropped(nodes.sparkSession, *[f"{folder}/{x}" for x in ("members", "wanted", "active", "star", "links", "cc", "rest")])
    return final


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (smallest id that is reachable over links) and kept."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    all_, nodes = classes(docs, folder, id_col=id_col, text_col=text_col)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    comp = components(nodes, texts, folder)
    of_class = written(nodes.join(comp, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("component_id"), "copies"), f"{folder}/classes")
    ids = with_class(all_.select("id", "n_shingles", "h1", "h2"), of_class, ["h1", "h2"], "copies")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return ids.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
