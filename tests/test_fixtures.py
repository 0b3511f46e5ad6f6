"""Small cases whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import colour, text
from tessera.functions.vectors import top_k
from tessera.operators import cooccurrence, curation, metrics, relational, retrieval, taxonomy


def test_assignment_is_greedy(spark):
    scores = spark.createDataFrame([(0, 1, p, i, s) for p, i, s in [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.1)]], "query_id long, post long, part long, item long, score double")
    whole = spark.createDataFrame([(0, 1, 0, 1.0, 0.4), (0, 1, 1, 1.0, 0.3)], "query_id long, post long, part long, weight double, score double")
    row = retrieval.assign(scores, whole).first()
    assert row.total == pytest.approx(0.5) and row.picks == "0:0,1:1"


def test_assignment_without_items_left(spark):
    scores = spark.createDataFrame([(0, 1, 0, 0, 0.7), (0, 1, 1, 0, 0.6)], "query_id long, post long, part long, item long, score double")
    whole = spark.createDataFrame([(0, 1, 0, 1.0, 0.4), (0, 1, 1, 1.0, 0.3), (0, 2, 0, 1.0, 0.2), (0, 2, 1, 1.0, 0.4)], "query_id long, post long, part long, weight double, score double")
    rows = {r.post: r for r in retrieval.assign(scores, whole).collect()}
    assert rows[1].total == pytest.approx(0.5) and rows[1].picks == "0:0,1:-1"
    assert rows[2].total == pytest.approx(0.3) and rows[2].picks == "0:-1,1:-1"


def test_climb_stops_at_the_first_sure_node(spark):
    tree = taxonomy.closure(spark.createDataFrame([("g", "c1", "l1"), ("g", "c1", "l2"), ("g", "c2", None)], "grp string, category string, leaf string"))
    probs = spark.createDataFrame([(1, "l1", 0.4), (1, "l2", 0.3), (1, "c2", 0.3), (2, "l1", 0.2), (2, "l2", 0.2), (2, "c2", 0.6)], "query_id long, leaf string, p double")
    rows = {r.query_id: r for r in taxonomy.climb(probs, tree).collect()}
    assert (rows[1].best, rows[1].node) == ("l1", "c1") and rows[1].p == pytest.approx(0.7)
    assert (rows[2].best, rows[2].node) == ("c2", "c2")


def test_auroc_counts_ties_half(spark):
    rows = spark.createDataFrame([(float(s), p) for s, p in [(1, True), (2, True), (2, True), (2, False), (0, False)]], "score double, positive boolean")
    assert metrics.auroc(rows).first().auroc == pytest.approx(4 / 6)
    assert metrics.auroc(rows.where("positive")).first().auroc is None


def test_wilson(spark):
    low, high = metrics.wilson(F.col("h"), F.col("n"))
    rows = spark.createDataFrame([(8, 10), (0, 0)], "h long, n long").select(low.alias("a"), high.alias("b")).collect()
    assert rows[0].a == pytest.approx(0.4902, abs=1e-4) and rows[0].b == pytest.approx(0.9433, abs=1e-4)
    assert tuple(rows[1]) == (0.0, 0.0)


def test_ranks_and_medians(spark):
    scores = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.9, False), (1, 3, 0.9, True), (2, 1, 0.9, False), (2, 2, 0.5, False), (2, 3, 0.1, False)], "query_id long, key long, score double, is_target boolean")
    assert {r.query_id: r["rank"] for r in metrics.rank_strict(scores).collect()} == {1: 1}
    assert {r.query_id: r["rank"] for r in metrics.rank_positional(scores).collect()} == {1: 3, 2: 4}
    m = metrics.retrieval_metrics(spark.createDataFrame([(1,), (2,), (3,), (10,)], "rank long")).first()
    assert m["median"] == 2.5 and m.lower_median == 2


def test_first_wins_is_not_components(spark):
    rows = spark.createDataFrame([(1, "0" * 16), (2, "0" * 14 + "1f"), (3, "0" * 13 + "3ff"), (4, "f" * 16), (5, "f" * 16)], "id long, hash string")
    assert {r.id for r in curation.first_wins(rows).where("kept").collect()} == {1, 3, 4}


def test_npmi_of_independence(spark):
    row = spark.range(1).select(cooccurrence.npmi(F.lit(0.2), F.lit(0.5), F.lit(0.4)).alias("x"), cooccurrence.npmi(F.lit(0.0), F.lit(0.5), F.lit(0.4)).alias("y")).first()
    assert row.x == pytest.approx(0) and row.y == 0


def test_indel_ratio(spark):
    rows = spark.createDataFrame([("gap", "gaps"), ("", ""), ("a", None)], "a string, b string").select(text.indel_ratio("a", "b").alias("r")).collect()
    assert rows[0].r == pytest.approx(85.714, abs=1e-3) and rows[1].r == 100 and rows[2].r is None


def test_empty_result_is_a_result(spark):
    rows = spark.createDataFrame([(None,), ([],), (["x"],)], "meta array<string>").select(curation.needs_work(F.col("meta"), F.expr("CAST(array() AS ARRAY<STRING>)")).alias("t")).collect()
    assert [r.t for r in rows] == [True, False, True]


# From the published test data of the formula: two colours and their difference.
@pytest.mark.parametrize("x, y, expected", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.0, 2.0), (50, 0, 0), 2.3669), ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082), ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195)])
def test_ciede2000(spark, x, y, expected):
    lab = lambda v: F.struct(*[F.lit(float(c)).alias(n) for c, n in zip(v, "Lab")])
    assert spark.range(1).select(colour.ciede2000(lab(x), lab(y)).alias("d")).first().d == pytest.approx(expected, abs=1e-4)


TERMS = ("jeans", "cargo pants", "jorts", "hoodie", "sneaker", "jacket", "shirt", "shoe")
CASES = [
    (False, "", "unroutable"), (False, "   ", "unroutable"), (True, "", "identify"), (True, None, "identify"), (False, "blue jeans", "search"), (False, "gray suede adidas sneakers", "search"), (False, "what goes with cargo pants", "search"),
    (True, "what brand is this", "brand"), (True, "what brand are these", "brand"), (True, "who makes this", "brand"), (True, "which brand is this jacket", "brand"), (True, "what goes with this", "compose"), (True, "pair this with something", "compose"),
    (True, "what should i wear with this", "compose"), (True, "styled with baggy jeans", "compose"), (True, "this shoe with cargo jorts", "compose"), (True, "with jeans", "compose"), (True, "a shirt with stripes", "identify"), (True, "jacket with a hood", "identify"),
    (True, "sneakers with red laces", "identify"), (True, "this exact sneaker", "identify"), (True, "find me blue jeans like this", "identify"), (True, "something like this hoodie", "identify"),
]


def test_router(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "i int, image boolean, text string")
    got = rows.select("i", text.route(F.col("image"), F.col("text"), TERMS).alias("r")).orderBy("i").collect()
    assert [r.r.intent for r in got] == [c for *_, c in CASES]
    assert got[20].r.exactness_cue == "this exact" and got[21].r.similarity_cue == "like this"


def test_top_k_in_blocks(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(4)]) for i in range(40)]
    gallery = spark.createDataFrame(rows, "key long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(rows[:6], "query_id long, embedding array<float>")
    want = {(q, k, r) for q, v in rows[:6] for r, (_, k) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in rows)[:5], 1)}
    for block in (1, 1 << 20):
        assert {(r.query_id, r.key, r["rank"]) for r in top_k(queries, gallery, 5, block).collect()} == want


def test_splits_keep_groups_together(spark):
    rows = spark.range(500).withColumn("photo", F.col("id") % 50)
    split = curation.fraction_split(rows, "photo", 3).groupBy("photo").agg(F.countDistinct("split").alias("n"))
    assert split.where("n > 1").isEmpty()
    views = curation.view_split(rows, "photo", "id", 1).groupBy("photo").pivot("split", ["train", "test"]).count()
    assert views.where("train = 9 AND test = 1").count() == 50
    single = curation.view_split(spark.range(3), "id", "id", 1)
    assert single.where("split = 'test'").isEmpty()


def test_gate_falls_back_to_all(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "q long, c string")
    got = {(r.q, r.c, r.filter_applied) for r in relational.gate_or_all(rows, F.col("c") == "a", "q").collect()}
    assert got == {(1, "a", True), (2, "b", False)}
