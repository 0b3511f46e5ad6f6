"""An index that is brought up to date, near-duplicates at ingest, substrings of two lists: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation, relational
from tessera.sources import index
from tessera.streaming import near

ROWS = "key long, signature string, value string"


def encode(values):
    return [None if v is None else [float(len(v))] for v in values]


def state(spark, root):
    return {r.key: (r.signature, r.embedding[0], r.part) for r in index.vectors(spark, root).collect()}


def test_index_embeds_what_changed(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    update = lambda rows, settings: tuple(index.update(spark.createDataFrame(rows, ROWS), root, "key", "signature", "value", settings, encode).first())
    with pytest.raises(FileNotFoundError):
        index.vectors(spark, root)
    first = [(1, "a", "x"), (2, "b", "xx"), (3, None, "xxx"), (4, "d", None), (None, "e", "x"), (5, "e", "y"), (5, "f", "yy")]
    assert update(first, {"m": 1}) == (0, 4, 1, 0)
    before = state(spark, root)
    assert {k: v[:2] for k, v in before.items()} == {1: ("a", 1.0), 2: ("b", 2.0), 3: (None, 3.0), 5: ("f", 2.0)}
    # Unchanged rows stay in their part, also when only their value differs; 2 changes, 5 goes, 4 can be read now.
    second = [(1, "a", "not read"), (2, "B", "xxxxx"), (3, None, "xxx"), (4, "d", "now"), (6, "g", "zz")]
    assert update(second, {"m": 1}) == (2, 3, 0, 1)
    after = state(spark, root)
    assert {k: v[:2] for k, v in after.items()} == {1: ("a", 1.0), 2: ("B", 5.0), 3: (None, 3.0), 4: ("d", 3.0), 6: ("g", 2.0)}
    assert after[1] == before[1] and after[3] == before[3] and after[2][2] != before[2][2]
    assert update(second, {"m": 1}) == (5, 0, 0, 0) and state(spark, root) == after
    assert update(second, {"m": 2}) == (0, 5, 0, 0) and not {v[2] for v in state(spark, root).values()} & {v[2] for v in after.values()}
    assert update(second[:1], {"m": 2}) == (1, 0, 0, 4) and set(state(spark, root)) == {1}
    held = state(spark, root)
    index.vacuum(spark, root)
    assert state(spark, root) == held and len(list((tmp_path / "index" / "parts").glob("part=*"))) == 1 and len(list((tmp_path / "index" / "manifests").glob("version=*"))) == 1
    assert update([], {"m": 2}) == (0, 0, 0, 1) and state(spark, root) == {}


def test_failed_update_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, "a", "x")], ROWS)
    index.update(rows, root, "key", "signature", "value", {}, encode)
    held = state(spark, root)

    def breaks(values):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        index.update(rows.withColumn("signature", F.lit("b")), root, "key", "signature", "value", {}, breaks)
    assert state(spark, root) == held
    (tmp_path / "index" / "manifests" / "version=000000001").mkdir()  # a manifest that wasn't completed
    assert state(spark, root) == held and tuple(index.update(rows, root, "key", "signature", "value", {}, encode).first()) == (1, 0, 0, 0)


def greedy(rows, most=6):
    out, kept = {}, []
    for i, h in sorted(rows):
        near_one = any(bin(h ^ k).count("1") <= most for k in kept)
        out[i] = not near_one
        if not near_one:
            kept.append(h)
    return out


def test_ingest_equals_one_batch(spark, tmp_path):
    rng = random.Random(6)
    hashes = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(150):
        h = rng.choice(hashes)
        for bit in rng.sample(range(64), rng.randint(0, 9)):
            h ^= 1 << bit
        rows.append((i, h))
    want = greedy(rows)
    assert 12 < sum(want.values()) < 150
    write = lambda part, name: spark.createDataFrame([(i, f"{h:016x}") for i, h in part], "id long, hash string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
    stream = lambda: near.dedup_stream(spark.readStream.schema("id long, hash string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = lambda: {r.id: r.kept for r in near.decisions(spark, f"{tmp_path}/out").collect()}
    (tmp_path / "in").mkdir()
    assert got() == {}
    for name, (a, b) in enumerate(((0, 60), (60, 61), (61, 150))):
        write(rows[a:b], name)
        stream()
        assert got() == {i: want[i] for i, _ in rows[:b]}
    # The same rows again, and nothing new: no decision changes.
    write(rows[:30], "again")
    stream()
    stream()
    assert got() == want
    whole = spark.createDataFrame([(i, f"{h:016x}") for i, h in rows], "id long, hash string")
    assert {r.id: r.kept for r in curation.first_wins(whole).collect()} == want


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "0" * 16), (2, "0" * 15 + "1"), (3, "f" * 16), (4, None), (None, "a" * 16)], "id long, hash string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "two"):  # a stream that has forgotten its progress runs batch 0 again
        near.dedup_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").awaitTermination()
        assert {r.id: r.kept for r in near.decisions(spark, f"{tmp_path}/out").collect()} == {1: True, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_substrings(spark, size):
    rng = random.Random(size)
    text = lambda most: "".join(rng.choice("abé𝔘 ") for _ in range(rng.randint(0, most)))
    queries, labels = [text(9) for _ in range(150)] + [None, "a" * 40], [text(14) for _ in range(150)] + [None, "a" * 50]
    got = sorted(tuple(r) for r in relational.substring_pairs(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(x,) for x in labels], "label string"), size).collect())
    assert got == sorted({(q, x) for q in queries for x in labels if q and x and (q in x or x in q)})


def test_substrings_make_no_nested_loop(spark):
    a, b = spark.createDataFrame([("x",)], "query string"), spark.createDataFrame([("xy",)], "label string")
    plan = relational.substring_pairs(a, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
