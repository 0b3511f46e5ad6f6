"""Bounded samples of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, modulus: int) -> Column:
    """The fold that a document belongs to: crc32 of its doc_id as text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled documents outside a fold: those whose doc_id hashes lowest.

    Repeated rows and repeated labels count once; a document with both labels is there with each; different texts of one
    doc_id are documents of their own.  The bound is what lets ids be broadcast and measurements be collected."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where((fold("_id", modulus) != held_out) & F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).distinct()
    order = [F.xxhash64("_id"), "_id"]
    ids = ids.orderBy(*order, "_y").limit(max_rows)
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    keys = texts.select("doc_id", "_h").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_id", "_h", "_y").distinct().orderBy(*order, "_h", "_y").limit(max_rows)
    keys = keys.withColumnRenamed("_h", "_k")
    found = texts.join(F.broadcast(keys), (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_k")))
    return found.groupBy("doc_id", "_h", F.col("_y").alias("y")).agg(F.first("text").alias("text")).select("doc_id", "text", "y")
