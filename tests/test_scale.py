"""Operators that deal ranges, blocks and bands to tasks, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import canonical_colour, fold_accents, indel_ratio
from tessera.functions.vectors import top_k
from tessera.operators import curation, metrics, relational
from tessera.sources import extract, store


def test_percentiles_of_ties_and_nulls(spark):
    values = [random.Random(1).choice([0.5, 1.0, 1.0, 2.5, 7.0, None]) for _ in range(500)] + [float(x) for x in range(900)]
    df = spark.createDataFrame([(v,) for v in values], "score double").repartition(7)
    got = {r.share: r.value for r in metrics.percentiles(df, "score", [0.0, 0.01, 0.5, 0.77, 1.0]).collect()}
    assert got == pytest.approx({q: float(np.quantile([v for v in values if v is not None], q)) for q in got})
    assert metrics.percentiles(df.limit(0), "score", [0.5]).count() == 0


def test_auroc_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(rng.randint(0, 300)), rng.random() < 0.4) for _ in range(2000)] + [("one", 1.0, True)]
    got = {r.g: r.auroc for r in metrics.auroc(spark.createDataFrame(rows, "g string, score double, positive boolean"), "g").collect()}
    for g in ("a", "b", None):
        p, n = ([s for x, s, y in rows if x == g and y == label] for label in (True, False))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n))
    assert got["one"] is None


def test_score_stats(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.05, 0.2, 0.7, rng.random()])) for g in "xyz" for _ in range(rng.randint(1, 90))] + [("single", 0.3)]
    for r in metrics.score_stats(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.9, 0.1).collect():
        v = sorted(x for g, x in rows if g == r.g)
        at = int(0.9 * len(v)) - 1
        assert (r.n, r.at_share, r.gate_fails) == (len(v), v[at] if at >= 0 else v[-1], sum(x < 0.1 for x in v)) and r.median == pytest.approx(float(np.median(v)))


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in list(hashes):
        for _ in range(4):
            x = h
            for bit in rng.sample(range(64), rng.randint(0, 8)):
                x ^= 1 << bit
            hashes.append(x)
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)], "id long, hash string")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and bin(a ^ b).count("1") <= 6}
    for agree in (1, 3):
        assert {tuple(r) for r in curation.near_pairs(df, 6, agree).collect()} == want


@pytest.mark.parametrize("block", [64 << 20, 100])
def test_top_k_in_blocks_and_groups(spark, block):
    rng = np.random.default_rng(5)
    v, label = rng.normal(size=(40, 4)), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(40)], "key long, embedding array<double>, label int").repartition(3)
    queries = df.where("key % 5 = 0").withColumnRenamed("key", "query_id")
    for group in (None, "label"):
        got = {(r.query_id, r.rank): r.key for r in top_k(queries, df, 6, block, group).collect()}
        for q in range(0, 40, 5):
            near = [i for i in np.argsort(-v @ v[q], kind="stable").tolist() if group is None or label[i] == label[q]][:6]
            assert [got.get((q, k + 1)) for k in range(len(near))] == near and (q, len(near) + 1) not in got
    assert top_k(queries.limit(0), df, 3).count() == 0 and top_k(queries, df.limit(0), 3).count() == 0


def test_top_k_leaves_out_what_has_no_score(spark):
    """Nulls and NaN anywhere, other lengths, ties, and a group of nearly all rows beyond one block."""
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [1.0, None], "a"), (4, [float("nan"), 1.0], "a"), (None, [9.0, 9.0], "a"), (5, [1.0], "a"), (6, [2.0, 1.0], None), (7, [1.0, 1.0], "b")] + [(i, [1.0, 2.0], "a") for i in range(10, 300)]
    df = spark.createDataFrame(rows, "key long, embedding array<double>, kind string").repartition(3)
    queries = df.where("key IS NULL OR key < 100").withColumnRenamed("key", "query_id")
    for block in (64 << 20, 64):
        got = {}
        for r in top_k(queries, df, 3, block, "kind").collect():
            got.setdefault(r.query_id, []).append(r.key)
        assert got == {1: [1, 10, 11], 5: [5], 7: [7]} | {i: [10, 11, 12] for i in range(10, 100)}


def test_fuzzy_match_finds_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    words, aliases = {word() for _ in range(150)}, {word() for _ in range(80)}

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return 200.0 * row[-1] / (len(x) + len(y))

    got = {(r.word, r.alias): r.ratio for r in relational.fuzzy_match(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(a,) for a in aliases], "alias string")).collect()}
    assert got == pytest.approx({(x, y): ratio(x, y) for x in words for y in aliases if ratio(x, y) >= (90 if len(y) <= 5 else 80)})
    odd = spark.createDataFrame([("", ""), ("a", ""), (None, "a")], "a string, b string").select(indel_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in odd] == [100.0, 0.0, None]


def test_bins_stream(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), f"{i:04d}", rng.choice([1, 5, 30, 200, None])) for i in range(300)]
    got = {(r.folder, r.name): r.bin for r in extract.bins(spark.createDataFrame(rows, "folder string, name string, size long"), 100).collect()}
    for folder in ("a", "b", None):
        at = used = 0
        for g, name, size in rows:
            if g == folder:
                size = size or 0
                at, used = (at + 1, size) if used > 0 and used + size > 100 else (at, used + size)
                assert got[folder, name] == at


def test_replaced_by_one_writer(spark):
    path = f"{store.shared_folder(spark)}/tables/one-writer"
    store.replace(spark.range(3), path)
    with store.single_writer(spark, path), pytest.raises(FileExistsError):
        store.replace(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    store.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_saved_tables_can_be_cleared(spark):
    df = store.saved(spark.range(5), "five")
    assert df.count() == 5
    store.clear(spark)
    with pytest.raises(Exception, match="(?i)not.exist|not found|FILE_NOT_EXIST"):
        store.saved(spark.range(5), "more").unionByName(df).count()


def test_colours_and_accents(spark):
    names = {**K.EXACT_COLOURS, "Metallic Gold": "gold", " Jet Black": "black", "Summit White": "cream", "no such": None}
    df = spark.createDataFrame(list(names.items()), "name string, want string")
    assert df.where(~canonical_colour(F.col("name")).eqNullSafe(F.col("want"))).count() == 0
    texts = spark.createDataFrame([("Crème  Brûlée™ №5",), ("ﬁancé́e",), (None,), ("日本",)], "t string").select(fold_accents("t").alias("t")).collect()
    assert [r.t for r in texts] == ["creme bruleetm no5", "fiancee", None, ""]


def test_only_rows_of_a_group_are_multiplied(monkeypatch):
    """Groups of any kind of name, in batches of any order; ties by key, also across parts of a batch."""
    from tessera.functions import vectors

    rng = np.random.default_rng(5)
    rows = rng.integers(-2, 3, (900, 4)).astype(np.float64)
    groups, keys = np.array([f"g{i}" for i in rng.integers(0, 6, 900)], object), rng.permutation(900)
    met = []
    monkeypatch.setattr(vectors, "WIDTH", 50)
    whole = vectors._Best._enter
    monkeypatch.setattr(vectors._Best, "_enter", lambda self, some, k, v: met.append((some.stop - some.start) * len(k)) or whole(self, some, k, v))
    best = vectors._Best(keys, rows, groups, 4)
    for some in np.array_split(np.arange(900), 7):
        best.meet(keys[some], rows[some], groups[some])
    got = {}
    for query, key, score in zip(*(c.to_pylist() for c in best.found().columns)):
        got.setdefault(query, []).append((-score, key))
    want = {int(keys[q]): sorted((-float(rows[q] @ rows[i]), int(keys[i])) for i in range(900) if groups[i] == groups[q])[:4] for q in range(900)}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert sum(met) == sum(int((groups == g).sum()) ** 2 for g in set(groups))  # a sixth of 810,000


def test_members_of_groups_are_dealt_to_lanes(spark):
    from tessera.operators.retrieval import members

    chosen = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (3, 9)], "query_id long, label int")
    rows = spark.createDataFrame([(5 + i % 3, i) for i in range(300)], "label int, code long")
    found = members(chosen, rows, "label", "code", 8)
    want = sorted((q, c) for q, label in ((1, 5), (2, 5), (2, 6)) for c in range(300) if 5 + c % 3 == label)
    assert sorted((r.query_id, r.code) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() == 8  # what is joined is small, but its partitions aren't put together


def test_long_texts_are_folded_in_batches_of_bytes(spark, tmp_path):
    """The query's own job has the smaller batches, and the session's size holds again after it."""
    from tessera.plans import catalog

    catalog.load()
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(size), []
    spark.createDataFrame([(i, "É" * i) for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = store.saved
    import tessera.plans.sources as plans

    plans.saved, kept = (lambda *a, **o: seen.append(spark.conf.get(size)) or whole(*a, **o)), plans.saved
    try:
        rows = catalog.QUERIES["F18_fold_accents"](spark, str(tmp_path)).count()
    finally:
        plans.saved = kept
    assert rows == 9 and seen == [str(8 << 20)] and spark.conf.get(size) == before


def test_a_page_s_state_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, '<script id="__NEXT_DATA__">{"props": {"pageProps": {"selectedProduct": {"styleColor": "c"}, "productGroups": []}}}</script>')], "k long, html string").write.parquet(f"{tmp_path}/pages")
    found = extract.embedded_variants(spark.read.parquet(f"{tmp_path}/pages"), "k", "html")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:2] for r in found.collect()] == [(1, "c")] and plan.count("FileScan") == 1
