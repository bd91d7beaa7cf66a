"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Nulls, empty tables and extra columns go through as the stage's
operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import packing, pii, quality_classifier, simhash, suffix_dedup
from tidepool.llm.common import cut, discard, fresh, small_batches

#: Documents that score below go.
MIN_QUALITY = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs.columns, "score")
    return quality_classifier.score(docs, model, score).where(F.col(score) >= MIN_QUALITY).drop(score)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links, the document with the smallest doc_id. Rows of one doc_id stay or go together."""
    small_batches(spark)
    classes = simhash.near_duplicates(docs)
    copies = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    small_batches(spark)
    return _recounted(suffix_dedup.deduplicate(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind of personal data in its place."""
    small_batches(spark)
    return _recounted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids (ids: little-endian unsigned 32-bit integers), and their places in sequences."""
    small_batches(spark)
    return packing.pack(cut(packing.pieces(docs, ids=True)))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: A trained classifier and best-fit packing have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
