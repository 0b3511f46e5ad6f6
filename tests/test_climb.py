"""The climb against loops: nodes that are leaves too, leaves of two categories or of none, ties, weights; rows dealt once."""

import random
from collections import defaultdict

import pytest

from tessera.operators import taxonomy

PATHS = [("g", "c1", "l1"), ("g", "c1", "l2"), ("g", "c2", None), ("h", "c3", "l3"), ("h", "c3", "l4"), ("g", "c3", "l3"), ("h", "c1", None)]


def loop(rows, closure, threshold=0.5):
    out, queries = {}, defaultdict(list)
    for query, leaf, p in rows:
        queries[query].append((leaf, p))
    queries.pop(None, None)
    for query, of in queries.items():
        total = sum(p for _, p in of)
        shares = [(leaf, p / total) for leaf, p in of]
        best = min(shares, key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[0]
        mass = defaultdict(float)
        for leaf, p in shares:
            for node, _ in [(n, lv) for n, lf, lv, _ in closure if lf == leaf]:
                mass[node] += p
        path = {(n, lv) for n, lf, lv, _ in closure if lf == best}
        if path:
            level = max(lv for n, lv in path if lv == 0 or round(mass[n], 12) >= threshold)
            out[query] = best, level, {n: mass[n] for n, lv in path if lv == level}
    return out


@pytest.fixture(scope="module")
def tree(spark):
    return taxonomy.closure(spark.createDataFrame(PATHS, "grp string, category string, leaf string"))


def test_against_loops(spark, tree):
    rng = random.Random(8)
    rows = [(q, leaf, float(rng.randint(1, 3) * (3 if rng.random() < 0.2 else 1))) for q in range(80) for leaf in rng.sample(["l1", "l2", "l3", "l4", "c1", "c2", "unknown", None], rng.randint(1, 6))]
    rows += [(None, "l1", 1.0)]
    want = loop(rows, [tuple(r) for r in tree.select("ancestor", "leaf", "level", "category").collect()])
    got = taxonomy.climb(spark.createDataFrame(rows, "query_id long, leaf string, p double").repartition(3), tree, weights=True).collect()
    assert len(got) == len({r.query_id for r in got}) == len(want) and 40 < len(want) < 80
    for r in got:
        best, level, nodes = want[r.query_id]
        assert (r.best, r.level) == (best, level) and r.p == pytest.approx(nodes[r.node])


def test_nulls_and_nan(spark, tree):
    rows = [(1, "l1", None), (1, "l2", 0.7), (2, "l1", float("nan")), (2, "l2", 0.7), (3, "l2", None), (3, "l1", None)]
    got = {r.query_id: r for r in taxonomy.climb(spark.createDataFrame(rows, "query_id long, leaf string, p double"), tree).collect()}
    assert (got[1].best, got[1].node, got[1].p) == ("l2", "l2", 0.7) and (got[2].best, got[2].node) == ("l1", "l1") and (got[3].best, got[3].node, got[3].p) == ("l1", "root", None)


def test_rows_are_dealt_by_query_once(spark, tree):
    rows = spark.createDataFrame([(1, "l1", 1.0), (1, "l3", 2.0)], "query_id long, leaf string, p double")
    df = taxonomy.climb(rows, tree)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(query_id") == 1
