"""Reports and splits by hand: judged pairs, open sets, abstaining, shares of products, fixed galleries."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation, metrics

JUDGED = "verdict string, rank int, top1 double"


def test_judged_pairs(spark):
    rows = [("correct", 1, 0.9), ("correct", 1, 0.804), ("correct", 3, 0.7), ("correct", None, 0.2), ("missed", None, 0.6), ("absent", None, 0.85), ("absent", None, 0.1), ("absent", None, None), ("badcrop", None, 0.99), (None, 1, 0.5)]
    labels = spark.createDataFrame(rows, JUDGED)
    got = {r.k: (r.hits, r.n, r.recall) for r in metrics.pair_recall(labels).collect()}
    assert got == {1: (2, 5, 0.4), 5: (3, 5, 0.6), 10: (3, 5, 0.6)}
    table = {r.threshold: (r.false_reject, r.false_accept) for r in metrics.open_set_table(labels).collect()}
    # 0.804 lies above its own threshold, 0.8.
    assert table == {0.1: (0.0, 1.0), 0.8: (0.0, 0.5), 0.85: (0.5, 0.5), 0.9: (0.5, 0.0)}
    none = labels.limit(0)
    assert [(r.n, r.recall, r.low, r.high) for r in metrics.pair_recall(none).collect()] == [(0, None, 0.0, 0.0)] * 3 and metrics.open_set_table(none).count() == 0


def test_abstaining(spark):
    rows = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.9), ("a", "a", 0.1), ("b", None, None), ("b", "a", 0.5), ("c", "d", 0.9)], "truth string, predicted string, score double")
    got = {r.cls: (r.support, r.tp, r.fp, r.precision, r.abstain) for r in metrics.abstain_report(rows, 0.5).collect()}
    assert got == {"a": (3, 1, 1, 0.5, pytest.approx(1 / 3)), "b": (2, 0, 1, 0.0, 0.5), "c": (1, 0, 0, None, 0.0), "OVERALL": (6, 1, 3, 0.25, pytest.approx(1 / 3))}
    assert {(r.truth, r.said, r.n) for r in metrics.abstain_confusion(rows, 0.5).collect()} == {("a", "a", 1), ("a", "b", 1), ("a", "(abstain)", 1), ("b", "(abstain)", 1), ("b", "a", 1), ("c", "d", 1)}
    assert metrics.abstain_report(rows.limit(0), 0.5).count() == 0


def test_shares_of_products(spark):
    rows = spark.range(200).select(F.when(F.col("id") < 1, "one").when(F.col("id") < 3, "two").when(F.col("id") < 16, "thirteen").otherwise("many").alias("product"), F.col("id").alias("key"))
    got = {(r["product"], r.split): r["count"] for r in curation.share_split(rows, "product", "key", 3).groupBy("product", "split").count().collect()}
    # 2.6 and 36.8 are rounded; one row stays for training.
    assert got == {("one", "train"): 1, ("two", "test"): 1, ("two", "train"): 1, ("thirteen", "test"): 3, ("thirteen", "train"): 10, ("many", "test"): 37, ("many", "train"): 147}


def test_fixed_gallery(spark):
    products = spark.createDataFrame([(f"c{i}", f"i{i % 4}") for i in range(12)], "code string, identity string")
    queries = spark.createDataFrame([(i, f"c{i % 15}") for i in range(30)], "query_id long, code string")
    kept, identities, answerable = curation.fixed_gallery(products, queries, 5, 7)
    codes = {r.code for r in kept.collect()}
    assert len(codes) == 5 and {r.code for r in answerable.collect()} == codes and sum(r.n for r in identities.collect()) == 5
    assert curation.fixed_gallery(products, queries, 99, 7)[0].count() == 12
