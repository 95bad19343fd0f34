"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, substring dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir), applies one operator of :mod:`flickpulse.llm` to all that the stage before kept,
and all but the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared folder
and reads it back for the next. This module also gathers the queries of the operators, for the entry module.

Defined cases: rows with null ``doc_id`` pass the dedup stages unchanged, null texts fail the quality rules, and rows that
repeat a ``doc_id`` are one document; ``n_chars`` follows the text. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flickpulse.llm import catalog, line_dedup, minhash_dedup, packing, quality_rules, substring_dedup
from flickpulse.llm.registry import ORACLES, QUERIES, table
from flickpulse.operators.scale import stage

WORD = r"[^\x20\x09-\x0D]"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with another text; ``n_chars`` stays as it was where the text did."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source",
                       F.when(F.col(text).eqNullSafe(F.col("text")), F.col("n_chars"))
                       .otherwise(F.char_length(text).cast("long")).alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trained quality model."""
    docs = docs.select(*COLUMNS)
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).filter("keep_").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or they themselves, have already.

    A document that had words and has none left is an earlier one's copy, or made of such lines only, and goes.
    """
    left = line_dedup.remove_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed_") > 0) & ~F.col("kept_text_").rlike(WORD)
    return _with_text(left.filter(~F.coalesce(emptied, F.lit(False))), "kept_text_")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; the shingles are of five words here."""
    docs = docs.select(*COLUMNS)
    judged = minhash_dedup.near_duplicates(docs, shingle=5)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller id have; a text that loses nothing keeps its white space."""
    left = substring_dedup.remove_repeated(docs.select(*COLUMNS))
    return _with_text(left.withColumn("kept_text_", F.when(F.col("n_removed_") > 0, F.col("kept_text_")).otherwise(F.col("text"))), "kept_text_")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: every piece of every document that is left, with its place."""
    return packing.pack_documents(docs.select(*COLUMNS), catalog.word_bpe())


STAGES = [("quality rules", quality), ("line dedup", lines), ("minhash near-dedup", near_duplicates),
          ("substring dedup", substrings), ("best-fit packing", pack)]
#: Trained quality scores and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]
