"""Quality rules: a bitmask ledger in DataFrame functions only.

``ledger`` measures every text once and evaluates every rule once: one row per document with the
measurements and a word of failure bits (bit i: rule i failed). Policies are versioned masks over
those bits; applying one is ``fail_bits & mask = 0``, so a policy changes without reading a text
again. ``ablation`` counts documents by failure word (at most 2^rules groups, combined before the
shuffle) and answers by bitwise aggregation what each rule drops and what it alone drops.

Repeated 3-word windows are found inside the row: the windows' 64-bit hashes are sorted with their
positions, equal neighbours mark positions, and the words covered are summed. Nothing is exploded
and nothing is shuffled, whatever the length of a text or the number of copies.

Defined cases: null and empty text have no words, 0 in every measurement, and fail the rules on
missing words; a line counts only if it holds a word; ratios are compared as integer products.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pithy.llm.arrow import text_column

_SPACE = " \t\n\x0b\x0c\r"
_WORDS = r"[^ \t-\r]+"
_SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed`` (SQL over the measurements) is true."""

    name: str
    failed: str


#: Bit i is rule i. Rules are appended, never moved: stored ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 5 * n_lines"),
)

BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Versioned policies: a document is kept if none of these rules failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "prose-1": tuple(BIT),
}


def mask(policy: str) -> int:
    """The bits of a policy."""
    return sum(BIT[name] for name in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``id_cols`` and the measurements of each text."""
    text = F.coalesce(text_column(df, text_col), F.lit(""))
    step = df.select(*[F.col(f"`{c}`") for c in id_cols], text.alias("__t"))
    step = step.withColumn("__w", F.regexp_extract_all("__t", F.lit(_WORDS), 0)).withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(_WORDS)))
    word = lambda i: F.get("__w", i)
    step = step.select(
        *[F.col(f"`{c}`") for c in id_cols],
        F.size("__w").cast("long").alias("n_words"),
        _without(F.col("__t"), _SPACE).cast("long").alias("word_chars"),
        (F.length("__t") - _without(F.col("__t"), _SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^[ \t]*[-*•·]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.transform(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, word(i + 1), word(i + 2)).alias("h"), i.alias("p"))).alias("__g"),
    )
    step = step.withColumn("__s", F.sort_array("__g"))
    at = lambda i: F.get("__s", i)["h"]
    step = step.withColumn("__d", F.filter("__s", lambda x, i: at(i - 1).eqNullSafe(x["h"]) | at(i + 1).eqNullSafe(x["h"])))
    step = step.withColumn("__p", F.sort_array(F.transform("__d", lambda x: x["p"])))
    step = step.withColumn("__c", F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - p, F.lit(3)))))
    covered = F.aggregate("__c", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return step.select(*[F.col(f"`{c}`") for c in id_cols], *MEASURES[:-1], covered.alias("n_repeat_words"))


def ledger(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of each document."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, id_cols, text_col).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str, out_col: str = "kept") -> DataFrame:
    """The ledger with the verdict of a policy."""
    return led.withColumn(out_col, F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it drops, and that are kept without it."""
    want = mask(policy)
    words = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(want).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = words.select("bits", "n", F.explode(rules).alias("r"))
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("drops_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.bit_or(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("fails_with"),
    )
