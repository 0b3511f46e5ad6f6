"""Groups renormalised, against loops: classes of several groups or of none, nulls, a region and a class of most rows."""

import random
from collections import defaultdict

import pytest

from tessera.operators import relational

ALLOWED = [("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"), ("d", None)]


def test_against_loops_without_tables_of_groups(spark):
    rng = random.Random(12)
    rows = [(0 if i % 3 else rng.choice([*range(1, 30), None]), "a" if i % 2 else rng.choice(["b", "c", "d", "e", None]), rng.randint(1, 50) / 50) for i in range(3000)] + [(31, "a", None), (32, "b", 0.5), (32, "b", None)]
    want = defaultdict(lambda: defaultdict(list))
    for region, cls, p in rows:
        for c, grp in ALLOWED:
            if c == cls:
                want[region][grp].append(p)
    df = relational.renormalised(spark.createDataFrame(rows, "region long, cls string, p double").repartition(3), spark.createDataFrame(ALLOWED, "cls string, grp string"))
    got = {r.region: r for r in df.collect()}
    assert set(got) == set(want) and len(got) == 33 and (got[31].grp, got[31].share) == ("y", None) and (got[32].grp, got[32].share) == ("y", 1.0)
    for region in set(want) - {31}:
        mass = {grp: round(sum(p for p in ps if p is not None), 9) for grp, ps in want[region].items()}
        share, grp = max((m / round(sum(mass.values()), 9), g or "") for g, m in mass.items())
        assert got[region].share == pytest.approx(share) and (got[region].grp or "") == grp
    # A class's rows stay where they are, and what a task holds is sorted, which can go to disk, instead of hashed.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cls" not in plan and "HashAggregate" not in plan
