"""Hard negatives: the search against all pairs, blocks and lanes, pruning, exact products, odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tests.compare import duck_rows, spark_rows

VECTORS = "key long, label long, vector array<long>"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, best=10, low=30, high=90):
    """All pairs, with Python's integers."""
    rows = [r for r in rows if None not in r]
    out = []
    for key, label, vector in rows:
        if key % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v)), k, other) for k, other, v in rows if len(v) == len(vector)]
        for p, pk, _ in sorted(s for s in scored if s[2] == label and s[1] != key)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)
            out += [(key, pk, rank + 1, k, -p, -n) for rank, (n, k, _) in enumerate(fits[:best])]
    return sorted(out)


def mined(spark, rows, every, **kw):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("key") % every == 0, **kw).collect())


@pytest.fixture
def rows():
    """Norms from 0 to thousands, labels of very different sizes, many ties and copies."""
    rng = np.random.default_rng(11)
    size = rng.choice([0, 1, 10, 300], 700)
    label = rng.choice([1, 1, 1, 1, 2, 3, 4], 700)
    vectors = [[int(x) for x in rng.integers(-s, s + 1, 6)] for s in size]
    vectors[100:300] = [[3, 4, 0, 0, 0, 0]] * 200
    return [(i, int(label[i]), v) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("anchors", "partitions"), [(16_384, 4), (16_384, 1), (20, 4), (3, 7)])
def test_all_pairs(spark, monkeypatch, rows, anchors, partitions):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "LANE", 100)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        want = brute(rows, 9)
        assert len(want) > 1000 and mined(spark, rows, 9) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_other_windows(spark, rows):
    assert mined(spark, rows, 50, positives=2, negatives=3, low=0, high=100) == brute(rows, 50, 2, 3, 0, 100)


def test_buckets_that_cannot_enter_are_not_multiplied(monkeypatch, rows):
    """The search over sorted buckets finds what all products find, with a part of the products."""
    done = []
    plain = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b, norm: done.append(len(a) * len(b)) or plain(a, b, norm))
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(0, 1, (4000, 8)) * np.exp(rng.normal(3, 2, (4000, 1)))).astype(np.int64)
    norm = np.sqrt((vectors * vectors).sum(1).astype(float))
    order = np.argsort(-norm)
    anchors = [{"row": i, "key": i, "label": 0, "norm": norm[i], "vector": vectors[i].tolist(), "windows": [{"number": 1, "low": int(norm[i] * 200), "high": 1 << 60}, {"number": 2, "low": -(1 << 60), "high": int(norm[i] ** 2)}]} for i in range(0, 4000, 40)]
    block = negatives._Block(anchors, 10, False)
    for at in range(0, 4000, 50):
        some = order[at : at + 50]
        if not block.meet(some, np.ones(50, np.int64), norm[some], vectors[some]):
            break
    got = {(a, n): [] for a in range(0, 4000, 40) for n in (1, 2)}
    for r in block.found().to_pylist():
        got[r["anchor"], r["number"]].append((r["key"], r["score"]))
    for a in anchors:
        scores = vectors @ vectors[a["row"]]
        for w in a["windows"]:
            fits = sorted((-int(s), i) for i, s in enumerate(scores) if w["low"] <= s <= w["high"])[:10]
            assert got[a["row"], w["number"]] == [(i, -s) for s, i in fits]
    assert 0 < sum(done) < 0.6 * 100 * 4000


def test_exact_products():
    rng = np.random.default_rng(2)
    for size, norm in ((200, 1 << 20), (1 << 20, 1 << 50), (1 << 29, 1 << 62)):
        a, b = rng.integers(-size, size, (5, 7)), rng.integers(-size, size, (6, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert negatives.products(a, b, norm).tolist() == want
    with pytest.raises(OverflowError):
        negatives.products(np.full((1, 4), 1 << 32), np.full((1, 4), 1 << 32), 1 << 66)


def test_vectors_of_several_lengths_and_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [int(x) for x in rng.integers(-(1 << 28), 1 << 28, (0, 2, 5)[i % 7 % 3])]) for i in range(240)]
    assert mined(spark, rows, 4) == brute(rows, 4)


def test_repeated_rows_and_nulls(spark, rows):
    more = rows[:150] + rows[:40] + [(None, 1, [1] * 6), (9, None, [1] * 6), (9, 1, None)]
    got, want = mined(spark, more, 30), brute(more, 30)
    assert got == want and len(want) > len(set(want))


def test_quantised(spark):
    vectors = [[0.1, -0.1, 0.0], [1.5, -0.00390625, 1 / 3], None, [], [1.0, None, 2.0], [float("nan"), 0.0], [float("inf")], [float("-inf")]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], EMBEDDINGS)
    got = [r[0] for r in df.orderBy("vec_id").select(negatives.quantised("embedding")).collect()]
    assert got == [[math.floor(256 * float(np.float32(x))) for x in v] for v in vectors[:2]] + [None, [], None, None, None, None]


def test_query_on_odd_rows(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 8).tolist(), int(rng.integers(0, 10))) for i in range(0, 3000, 2)]
    rows += [(100, [1.0] * 8, None), (200, None, 3), (300, [None] * 8, 3), (400, [float("nan")] * 8, 3), (500, [float("inf")] + [0.0] * 7, 3), (1, [0.5] * 8, 3), (3, [0.5] * 8, 4), (5, [0.5] * 8, 4)]
    spark.createDataFrame(rows, EMBEDDINGS).withColumns({c: F.lit("clash") for c in ("key", "vector", "row", "block", "lane", "norm", "windows")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = spark_rows(negatives.op11_negatives(spark, str(tmp_path)))
    assert got == duck_rows(duck.sql(negatives.OP11_SQL)) and len(got[1]) > 1000


def test_empty_and_alone(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(100, [1.0], 3)]), ("nulls", [(100, None, None)])):
        spark.createDataFrame(rows, EMBEDDINGS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert negatives.op11_negatives(spark, f"{tmp_path}/{name}").count() == 0


def test_lanes_share_the_candidates(spark, monkeypatch):
    """A label, norm and vector that nearly all rows have is dealt to all lanes."""
    monkeypatch.setattr(negatives, "LANE", 1000)
    rows = [(i, 1 if i % 10 else 2, [3, 4]) for i in range(4000)]
    counts = defaultdict(int)
    for r in mined(spark, rows, 1000):
        counts[r[0]] += 1
    assert dict(counts) == {} or set(counts.values()) <= {50}
    assert mined(spark, rows, 1000, high=100) == brute(rows, 1000, high=100)
