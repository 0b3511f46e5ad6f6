"""Conversation repair: the programme against all edits of small conversations, the query against its SQL, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"


def brute(signature):
    """The least (cost, audit) over all edits; symbols in the conversation's order."""
    best = None
    slots = [["D"] if x == "x" else ["D", "K", "Ru", "Ra"] for x in signature]
    for edits in itertools.product(*slots):
        for puts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(signature) + 1):
            roles = puts[0] + "".join(("" if e == "D" else x.lower() if e == "K" else e[1]) + put for x, e, put in zip(signature, edits, puts[1:]))
            if LEGAL.fullmatch(roles):
                cost = sum({"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and x.isupper() else 0) for x, e in zip(signature, edits)) + 5 * sum(map(len, puts))
                audit = "I" * len(puts[0]) + "".join(e[0] + "I" * len(put) for e, put in zip(edits, puts[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_walk_equals_all_edits():
    rng = random.Random(12)
    whole = ["".join(x) for n in range(3) for x in itertools.product("suaoSUAOx", repeat=n)]
    longer = ["".join(rng.choice("ssuuaaoSUAOx") for _ in range(3)) for _ in range(80)] + ["".join(rng.choice("uasx") for _ in range(4)) for _ in range(2)]
    given = sorted({s[::-1] for s in whole + longer})
    assert [(s, c, a) for s, c, a in repair.walk(iter(given))] == [(s, *brute(s[::-1])) for s in given]


def test_layers_are_computed_once_a_node(monkeypatch):
    calls = []
    plain = repair.layer
    monkeypatch.setattr(repair, "layer", lambda *a: calls.append(1) or plain(*a))
    given = sorted("".join(x) for n in range(7) for x in itertools.product("ua", repeat=n))
    assert len(list(repair.walk(iter(given)))) == len(given) and len(calls) == len(given) - 1


def test_long_signatures():
    (_, cost, audit), = repair.walk(iter(["au" * 50_000]))
    assert (cost, audit) == (0, "K" * 100_000)


@pytest.mark.parametrize("partitions", [1, 7])
def test_query(spark, sf_dir, duck, partitions):
    from tests.compare import duck_rows, spark_rows

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert spark_rows(repair.op12_repair(spark, sf_dir)) == duck_rows(duck.sql(repair.OP12_SQL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def odd_turns(spark):
    rows = [
        (1, None, "user", "first?"), (1, 5, "user", "first?"), (1, 5, "user", "first?"), (1, 2, None, None), (1, 9, "assistant", "no end"), (2, 1, "", ""), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho!"), (None, None, "user", None),
        (3, -5, "system", "\t."), (3, 7, "tool", "x" * 300_000 + "."), (4, 1, "assistant", "b."), (4, 1, "assistant", "a."), (4, 1, "user", "c. \n"), (5, None, None, None), (6, None, "assistant", "a."),
    ]
    return spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("digest", "fault", "kind", "copies_", "signature", "initial")})


def test_odd_rows_against_sql(spark, tmp_path):
    import duckdb

    from tests.compare import duck_rows, spark_rows

    rows = odd_turns(spark)
    more = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("conv_id", F.col("conv_id") + 10 * F.col("k")).drop("k").unionByName(rows)
    more.write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names, got = spark_rows(repair.op12_repair(spark, str(tmp_path)))
    assert (names, got) == duck_rows(duck.sql(repair.OP12_SQL))
    gone = [r for r in got if r[names.index("audit")] == ""]
    assert gone and all(r[names.index("repaired_sha256")] == hashlib.sha256(b"").hexdigest() and r[names.index("cost")] == 0 for r in gone)


def test_damage(spark):
    rows = spark.createDataFrame([(i, 0, "system", "A. b?") for i in range(100)], TURNS)
    for r in repair.damaged(rows).collect():
        f = zlib.crc32(f"{r.conv_id}:0".encode()) % 20
        assert (r.copies, r.role, r.text) == ({0: 0, 3: 2}.get(f, 1), "user" if f == 4 else "system", {1: "", 2: "A b"}.get(f, "A. b?"))


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a?"), (1, 1, "user", "b?"), (1, 2, "assistant", "c."), (1, 3, "assistant", " "), (2, 0, "assistant", "d.")], TURNS)
    found = repair.audits(rows)
    assert {r.conv_id: (r.blank, r.illegal, r.cost, r.audit) for r in found.collect()} == {1: (1, 2, 4, "DKKD"), 2: (0, 0, 2, "D")}
    assert [(r.edit, r.role, r.text) for r in repair.repaired(rows, found).collect()] == [("K", "user", "b?"), ("K", "assistant", "c.")]


def test_empty(spark):
    rows = spark.createDataFrame([], TURNS)
    assert repair.audits(rows).count() == 0 and repair.digests(repair.repaired(rows, repair.audits(rows))).count() == 0
