"""A cleaning pipeline over documents: each stage is one operator of the library, and what it decides takes effect.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; the columns of documents go
through all stages but the last, which returns the encoded documents.

Defined results: a null or empty text is a document like any other for each stage (scored, never a duplicate, clean,
without secrets, without ids); repeated rows share each verdict, but for near-duplicates, where rows of one doc_id stay
or go together; a null doc_id is kept by the dedup stage; an empty table gives an empty result; columns beside those of
documents go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, neardup, pieces, quality, secrets
from tessera.llm.store import kept


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the discriminant scores below 0.3; it learns from the labelled rows of the documents."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return neardup.keep_one(docs, 80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words a twentieth or more are a benchmark's."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; keeps all documents."""
    return secrets.redact(docs, secrets.train(spark))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document that is left."""
    return pieces.round_trips(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("SentencePiece", sentencepiece),
]

#: The first, fourth and fifth stages aren't expressible in SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, f"stage-{k}")
    return docs
