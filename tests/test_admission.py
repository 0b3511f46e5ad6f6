"""Admission under quotas against a loop."""

import random

import pytest

from tessera.operators.admission import admit

SCHEMA = "place long, theme string, cap int, key string, hash string"


def loop(rows, most=6):
    out, kept = {}, []
    for place, theme, cap, key, h in sorted(rows, key=lambda r: r[0]):
        if h is None:
            out[place] = "unusable"
        elif sum(k[1] == (theme or "") for k in kept) >= (1 << 60 if cap is None else cap):
            out[place] = "full"
        elif any(key is not None and k[3] == key or bin(int(k[4], 16) ^ int(h, 16)).count("1") <= most for k in kept):
            out[place] = "near"
        else:
            out[place] = "kept"
            kept.append((place, theme or "", cap, key, h))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    families = [rng.getrandbits(64) for _ in range(25)]
    rows = []
    for place in rng.sample(range(5000), 260):
        h = rng.choice(families)
        for bit in rng.sample(range(64), rng.randint(0, 7)):
            h ^= 1 << bit
        theme = rng.choice(["hot", "hot", "hot", "cold", None])
        rows.append((place, theme, {"hot": 9, "cold": 4, None: None}[theme], rng.choice([None, None, f"k{rng.randint(0, 30)}"]), None if rng.random() < 0.05 else f"{h:016x}"))
    got = {r.place: r.outcome for r in admit(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = loop(rows)
    assert got == want and set(want.values()) == {"kept", "near", "full", "unusable"}


def test_a_near_duplicate_frees_its_theme_s_slot(spark):
    rows = [(1, "a", 2, None, "0" * 16), (2, "a", 2, None, "0" * 15 + "1"), (3, "a", 2, None, "f" * 16), (4, "a", 2, None, "0f" * 8), (5, "b", 1, None, "0f" * 8), (6, "b", 1, None, "33" * 8)]
    assert {r.place: r.outcome for r in admit(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "kept", 2: "near", 3: "kept", 4: "full", 5: "kept", 6: "full"}
    assert admit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_family_of_many_near_hashes_forms_no_pairs(spark, monkeypatch):
    from tessera.operators import curation

    met = []
    whole = curation.leaders
    monkeypatch.setattr("tessera.operators.admission.leaders", lambda *a: (lambda out: met.append(out[1].count()) or out)(whole(*a)))
    rows = [(i, "ab"[i % 2], 3, None, f"{'5' * 13}{i * 2654435761 % 4096:03x}") for i in range(700)]
    got = {r.place: r.outcome for r in admit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == loop(rows) and sum(met) < 60_000  # of 244,650 pairs, most of them near
