"""The corpus pipeline: quality filter, near-duplicate removal, redaction of secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result of a stage is
written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fotonflow.llm import packing, quality, secret_scan, simhash_texts
from fotonflow.llm.common import materialize, table
from fotonflow.llm.registry import vocabulary


#: Bytes of a batch that goes to a Python worker. Its rows hold whole texts, and Spark's 64 MB are held several times over in each task.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """For the session, as a stage's last batches are made after the stage has returned; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject.

    Null and empty texts are scored like any other; repeated rows are each decided alike; all columns pass.
    """
    _small_batches(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    Null and empty texts are copies of each other; of repeated rows one stays; columns of any name pass through.
    """
    _small_batches(spark)
    return simhash_texts.representatives(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; null and empty texts and repeated rows stay as they are."""
    return secret_scan.redact(docs, secret_scan.default_forest(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents as sequences of power-of-two lengths; a null or empty text is its end token alone."""
    _small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("near_duplicate_removal", near_duplicate_removal),
    ("secret_redaction", secret_redaction),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the fitted models; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
