"""First come, first kept, against a loop: families whose members are nearly all near one another, and chains."""

import random

import pytest

from tessera.operators import curation


def loop(rows, most=6):
    kept = []
    for i, h in sorted(rows):
        if all(bin(h ^ k).count("1") > most for _, k in kept):
            kept.append((i, h))
    return {i for i, _ in kept}


@pytest.mark.parametrize("front", [4])
def test_families_and_chains(spark, monkeypatch, front):
    rng = random.Random(front)
    monkeypatch.setattr(curation, "FRONT", front)
    monkeypatch.setattr(curation, "FEW", 3)
    hashes = [int(f"{'a' * 13}{rng.randrange(4096):03x}", 16) for _ in range(120)] + [rng.getrandbits(64) for _ in range(20)]
    for h in hashes[120:124]:
        for _ in range(3):  # each is near the one before
            for bit in rng.sample(range(64), 4):
                h ^= 1 << bit
            hashes.append(h)
    rng.shuffle(hashes)
    rows = list(enumerate(hashes))
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in rows], "id long, hash string").repartition(3)
    got = {r.id: r.kept for r in curation.first_wins(df).collect()}
    assert len(got) == len(rows) and {i for i, k in got.items() if k} == loop(rows)


def test_pairs_of_a_family_are_not_formed(spark):
    rows = spark.createDataFrame([(i, f"{'5' * 13}{i:03x}") for i in range(2000)], "id long, hash string")
    leading, pairs = curation.leaders(rows, 6, 16)
    assert 0 < pairs.count() < 50_000 and 0 < leading.count() < 2000  # of 1,999,000 pairs, most of them near
    assert curation.first_wins(rows.limit(0)).count() == 0
