"""Five stages from raw documents to token ids; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, pieces, quality, secrets, simhash
from quern.llm.common import shared_path, table
from quern.llm.queries import PIECE_MODEL


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it trains on the training rows of labels.

    Null and empty texts are judged as empty ones; rows without an id and repeated rows are each judged and are no training rows, or one.
    Very long texts are read whole. An empty table stays empty, without labels all rows stay, and columns beyond id and text are
    passed on whatever their names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null and empty texts are one group. Rows without an id come last, ties go by the text's hash and then by the other columns as JSON, so the
    same row stays in any order; of whole repeats one stays. Very long texts are read whole, an empty table stays empty, and all columns are
    passed on whatever their names.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate, as they were.

    Null and empty texts have no words and stay; repeated rows are each judged, ids are not read. Very long texts are read whole; without a
    benchmark all rows stay, an empty table stays empty, and all columns are passed on whatever their names.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars as of the new text.

    Null texts stay null and have 0 characters, empty ones stay; spans that overlap get one mark. Repeated rows are each redacted, ids are not
    read. Very long texts are scanned in blocks of matches, an empty table stays empty, and other columns are passed on whatever their names.
    """
    columns = docs.columns
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0))).select(*columns) if "n_chars" in columns else clean


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the check that they decode to its text.

    Null and empty texts have no ids. Of equal scores the piece that starts first wins, so repeated rows get equal ids; each is
    returned. Very long texts are encoded word by word, an empty table gives an empty result, and of the columns only id and
    text are read.
    """
    return pieces.tokenize(docs, PIECE_MODEL())


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("SentencePiece encoding", encoding),
]

#: SQL can express neither the classifier nor the fingerprints' hash; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
