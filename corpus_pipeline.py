"""A corpus pipeline of five stages over documents; each stage's result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import lines, near_texts, packing, quality, substrings
from tidemill.llm.common import forget_written, maybe_small, numbered, spare_name, table, written, written_paths

ORACLE_SQL = None


def with_text(docs: DataFrame) -> DataFrame:
    """Documents that still have a word; n_chars follows the text. A null text has none."""
    left = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands; null and empty texts go.

    Each row is judged by itself: null or repeated ids don't matter. An empty table stays empty.
    """
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a document without a word left goes.

    Earlier is by doc_id, then by line. Rows that repeat an id are different documents in an order of
    their own; rows with a null id keep their lines and take none from others. An empty table stays empty.
    """
    return with_text(lines.without_repeats(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Near copies have a Jaccard similarity of 0.8 or more of their 5-word shingles, the rule for pipeline
    stages. Simhashes of these shingles meet in op9's BK-trees, and texts whose fingerprints link are verified.
    At 0.8 two simhashes differ by some 10 bits of 64, a radius at which no tree prunes and pairs would
    still be lost, so an exact join (near_texts) finds the pairs that the trees leave. Rows that repeat an id are
    different documents, of which the first stays; rows with a null id all stay. An empty table stays empty.
    """
    copy = spare_name("copy", docs.columns)
    rows = numbered(docs, copy)
    copies = written(near_texts.later_copies(rows.select("doc_id", "text", F.col(copy).alias("copy"))), "copies").withColumnRenamed("copy", copy)
    return rows.join(maybe_small(copies), ["doc_id", copy], "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes or more that start earlier; a document without a word left goes.

    Only whole characters go. Rows that repeat an id are different documents in an order of their own; rows with
    a null id keep their text and take none from others. An empty table stays empty.
    """
    return with_text(substrings.without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null text is the end id alone; rows that repeat an id, or have none, are packed as different
    documents. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written, and then what the stage itself has written goes."""
    docs, before = table(spark, sf_dir, "documents"), written_paths()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget_written(spark, before, docs)
    return docs
