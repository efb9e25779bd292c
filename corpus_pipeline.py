"""From raw documents to token ids: quality, near-duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm import bpe, mixing, near_dedup, pii, quality
from demandgrid.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that a factorisation machine, learned from ``labels``, does not reject."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.accepted(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, with a similarity of 0.8 or more."""
    return near_dedup.deduplicated(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the whole texts; a null text stays null."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources reach their target weights."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the texts as token ids, with digests of them and of what they decode to."""
    return bpe.encoded(docs, ids=True, digests=True)


STAGES = [
    ("quality", quality_classifier),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", source_mix),
    ("bpe", token_ids),
]
ORACLE_SQL = None  # the classifier and the encoder have no SQL form; tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Documents with null or empty texts pass the stages that do not reject them and end with no tokens; a null id is kept; rows that repeat
    an id and have words are one document from the second stage on; other columns, whatever their names, are carried up to the
    last stage. Without labelled rows nothing is rejected; an empty table gives no rows. Texts are never cut.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
