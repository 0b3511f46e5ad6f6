"""Batch composition: shares, no repeats, pools that run dry, a category of nearly all products."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import batches as B


def by_batch(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.batch, r.place)):
        out[r.batch].append((r.tier, r["product"]))
    return out


@pytest.fixture(scope="module")
def catalog(spark):
    """600 products, nine tenths of one category; the first 60 have 20 hard negatives each."""
    products = spark.createDataFrame([(f"p{i:03}", "big" if i % 10 else f"c{i % 70}") for i in range(600)], "product string, category string")
    negatives = spark.createDataFrame([(f"p{i:03}", f"p{(i + 7 * k) % 600:03}") for i in range(60) for k in range(20)], "code string, product string")
    return products, negatives


def test_hard_negative_shares(catalog):
    products, negatives = catalog
    got = by_batch(B.hard_negative_batches(products, negatives, 20, 1))
    near = defaultdict(set)
    for r in negatives.where("code <> product").collect():
        near[r.code].add(r["product"])
    category = {r["product"]: r.category for r in products.collect()}
    assert sorted(got) == list(range(30))
    for rows in got.values():
        tiers, names = Counter(t for t, _ in rows), [p for _, p in rows]
        seed = names[0]
        assert len(names) == len(set(names)) == 20 and rows[0][0] == "seed" and near[seed]
        assert tiers["hard"] == 7 and all(p in near[seed] for t, p in rows if t == "hard")
        assert all(category[p] == category[seed] for t, p in rows if t == "category")
        left = sum(category[p] == category[seed] for p in category) - sum(category[p] == category[seed] for t, p in rows if t in ("seed", "hard"))
        assert tiers["category"] == min(6, left) and tiers["random"] == 20 - 1 - 7 - tiers["category"]
    # Windows of the orders tile: no product comes up much oftener than its share.
    assert max(Counter(p for rows in got.values() for t, p in rows if t == "random").values()) <= 3
    again, other = by_batch(B.hard_negative_batches(products, negatives, 20, 1)), by_batch(B.hard_negative_batches(products, negatives, 20, 2))
    assert again == got and other != got


def test_identities_carry_what_siblings_leave(spark):
    rows = [(f"p{i}", f"i{i // 3}", "x" if i < 90 else "y", 1 if i % 15 == 0 else 3) for i in range(120)]
    products = spark.createDataFrame(rows, "product string, identity string, category string, n_rows int")
    got, by = by_batch(B.identity_batches(products, 16, 5)), {r[0]: r for r in rows}
    assert len(got) == -(-sum(r[3] >= 2 for r in rows) // 16)
    for batch in got.values():
        names, tiers = [p for _, p in batch], Counter(t for t, _ in batch)
        seed = by[names[0]]
        siblings = sum(r[1] == seed[1] and r[3] >= 2 for r in rows) - 1
        assert len(set(names)) == len(names) == 16 and all(by[p][3] >= 2 for p in names)
        assert tiers["sibling"] == siblings and tiers["category"] == 12 - siblings and tiers["random"] == 3
        assert all(by[p][1] == seed[1] for t, p in batch if t == "sibling") and all(by[p][2] == seed[2] for t, p in batch if t == "category")


def test_fewer_products_than_a_batch_and_none(spark):
    products = spark.createDataFrame([("a", "x"), ("b", None), (None, "x"), ("c", "x")], "product string, category string")
    none = spark.createDataFrame([], "code string, product string")
    got = by_batch(B.hard_negative_batches(products, none, 8, 1))
    assert list(got) == [0] and sorted(p for _, p in got[0]) == ["a", "b", "c"]
    assert B.hard_negative_batches(products.limit(0), none, 8, 1).count() == 0


def test_rows_of_products(spark):
    batches = spark.createDataFrame([(b, "seed", p) for b in (0, 1) for p in "abc"], "batch long, tier string, product string")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), *(("c", i) for i in range(9))], "product string, key int")
    once, again = ({(b, p): [] for b in (0, 1) for p in "abc"} for _ in range(2))
    for out, repeat in ((once, False), (again, True)):
        for r in B.with_rows(batches, rows, "key", 4, 3, repeat).collect():
            out[r.batch, r["product"]].append(r.key)
    assert all(sorted(once[b, "a"]) == [1] and sorted(once[b, "b"]) == [1, 2] and len(set(once[b, "c"])) == 4 for b in (0, 1)) and once[0, "c"] != once[1, "c"]
    assert all(again[b, "a"] == [1] * 4 and sorted(again[b, "b"]) == [1, 1, 2, 2] and sorted(again[b, "c"]) == sorted(once[b, "c"]) for b in (0, 1))


def test_places_over_many_parts(spark):
    """A pool of nearly all rows is numbered in parts, without gaps and in order."""
    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("pool"), F.col("id").cast("string").alias("key"))
    got = B.numbered(rows, "pool", F.sha1("key"), "key", 3000, part=20).withColumn("h", F.sha1("key")).collect()
    for pool in {r.pool for r in got}:
        mine = sorted((r.place, r.h, r.size) for r in got if r.pool == pool)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and [h for _, h, _ in mine] == sorted(h for _, h, _ in mine) and {n for _, _, n in mine} == {len(mine)}
