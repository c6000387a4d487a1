"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs; all but the last return the columns of documents, whatever further columns there are and
whatever their names. An empty table gives an empty table in every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phylochron.llm import common, op1_quality, op5_mixing, op6_packing, op9_pii, op10_jaccard


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and goes; repeated rows are judged one by
    one, so all stay or all go; long texts are judged whole."""
    return op1_quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id, once; of rows that repeat this
    doc_id the one with the smallest hash. Rows without doc_id and texts without words are like no other and stay."""
    return op10_jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind in brackets, and n_chars follows. Texts without any, null and empty ones
    too, stay as they are; repeated rows are treated alike."""
    return op9_pii.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0, 1 or 2 times. A null source is one of its own, last; rows of one
    doc_id, source and size are taken equally often, but for none of them more than twice; a text without words has size 0."""
    return op5_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences. A null or empty text is its end token; repeated rows are packed one by one; only
    documents longer than a sequence are cut. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return op6_packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokens and sketches are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
