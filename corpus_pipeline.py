"""A training corpus from ``documents``: identify languages, remove near-duplicates, cut repeated
passages, remove contaminated documents, encode.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of ``documents``; ``run`` writes each stage as Parquet in the shared folder and
reads it again, so a lost executor never repeats more than one stage.

Defined cases: a document whose language is rejected (no text, no letter, alien script) goes; rows
that repeat an id, and rows without an id, count as copies and go with the near-duplicates; a
document of which a cut leaves no word goes; all other columns pass through unchanged, except that
``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pithy.llm import bpe, decontaminate, language_id, lexicon, near_dup, suffix_dedup
from pithy.llm.tables import shared_dir, table, written

VOCAB = "word_bpe_49k.json"


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; models learn from the labelled rows of ``docs``."""
    found = language_id.identify(docs, language_id.train(docs), prefix="lid_")
    return _same_columns(found.where("not lid_rejected"), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of rows that repeat an id the least one, so that a repeated task keeps the same."""
    kept = near_dup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    others = F.struct("text", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(others).alias("__row"))
    return _same_columns(one.select("doc_id", *[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != "doc_id"]), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document has."""
    out = suffix_dedup.cut_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    slim = decontaminate.find_contamination(docs.withColumn("__text", F.col("text")), table(spark, sf_dir, "benchmark"), text_col="__text")
    return _same_columns(slim.where(F.size("spans") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and the hash of the text decoded from them."""
    both = bpe.encode_decode(docs, lexicon.default_path(VOCAB), keep=False)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", remove_contaminated),
    ("BPE encoding and decoding", encode),
]

#: No stage is whole in SQL: the first learns a model, the third cuts texts; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
