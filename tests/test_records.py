"""Record files as a data source, embedded state of pages, two vocabularies: cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.sources import extract
from tessera.sources.records import Records, append_new, records

SCHEMA = "id long, name string"


def names(spark, path):
    return sorted((r.id, r.name) for r in records(spark, path, SCHEMA).collect())


def test_what_can_be_read(spark, tmp_path):
    rows = [{"id": 1, "name": "é\n"}, {"id": 2, "name": None}, {"id": 3}]
    (tmp_path / "array.json").write_text("\n " + json.dumps(rows, indent=1))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]")
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (folder / "b.json").write_text(json.dumps(rows[:1]))
    (folder / "_c.jsonl").write_text('{"id": 9}')
    (folder / "d.txt").write_text('{"id": 9}')
    want = [(1, "é\n"), (2, None), (3, None)]
    assert names(spark, f"{tmp_path}/array.json") == want and names(spark, f"file://{tmp_path}/array.json") == want
    assert names(spark, f"{tmp_path}/missing.json") == names(spark, f"{tmp_path}/empty.json") == names(spark, f"{tmp_path}/none.json") == []
    assert names(spark, str(folder)) == sorted([*want, want[0]], key=lambda r: (r[0], r[1] or ""))


def test_second_run_appends_new_keys_only(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(50)] + [(None, "null"), (7, "again")], SCHEMA).repartition(5)
    assert append_new(rows.where("id < 20 OR id IS NULL"), path, ["id"]) == 21
    before = {p.name: p.read_text() for p in (tmp_path / "out").glob("*.jsonl")}
    assert append_new(rows, path, ["id"]) == 51 and append_new(rows, path, ["id"]) == 51
    assert all((tmp_path / "out" / n).read_text() == text for n, text in before.items()) and {r.id for r in records(spark, path, SCHEMA).collect()} == {None, *range(50)}


def test_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(Records)
    path = f"{tmp_path}/out"
    rows = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("killed"))).otherwise(F.col("id").cast("string")).alias("value"))
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            rows.write.format("records").mode("append").save(path)
        assert spark.read.format("records").load(path).count() == 0 and not list((tmp_path / "out").glob("[!.]*"))
    assert append_new(spark.createDataFrame([(1, "a")], SCHEMA), path, ["id"]) == 1 and len(list((tmp_path / "out").glob("[!.]*"))) == 1


def test_embedded_state(spark):
    page = lambda state: f'<script id="__NEXT_DATA__" type="application/json">{state if isinstance(state, str) else json.dumps(state)}</script>'
    props = lambda **kw: {"props": {"pageProps": kw}}
    group = {"products": {"A-1": {"productInfo": {"title": "Shoe"}, "colorDescription": "Red", "contentImages": [{"cardType": "image", "properties": {"portrait": {"url": ""}, "squarish": {"url": "s"}}}, {"cardType": "image"}, {"cardType": "video", "properties": {"portrait": {"url": "v"}}}]}, "B-2": {}}}
    rows = [
        (1, page(props(selectedProduct={"groupIndex": 1}, productGroups=[{"products": {"no": {}}}, group]))), (2, page(props(selectedProduct={"styleColor": "C-3", "productInfo": {"title": "Hat"}}))), (3, page(props(productGroups=[group]))),
        (4, page("{broken")), (5, None), (6, "<p>plain</p>"), (7, page(props(selectedProduct={"groupIndex": 5}, productGroups=[group]))), (8, page(props(selectedProduct={}, productGroups=[]))), (9, page(props(selectedProduct={}, productGroups=[{"products": 3}]))),
    ]
    got = extract.embedded_variants(spark.createDataFrame(rows, "id long, html string"), "id", "html").collect()
    assert sorted(map(tuple, got)) == [(1, "A-1", "Shoe", "Red", None, ["s"]), (1, "B-2", "", None, None, []), (2, "C-3", "Hat", None, None, [])]


def test_two_vocabularies(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    catalog = table([("northface", "North"), ("acme", "Acme"), ("acme co", "Acme")], "alias string, brand string")
    others = table([("air jordan", "Jordan"), ("sub label", "Sub"), ("umbrella", "Umbrella"), ("zeta", "Zeta")], "alias string, brand string")
    parents = table([("Jordan", "ACME"), ("Sub", "Middle"), ("Middle", "Acme"), ("Zeta", "Nobody")], "brand string, parent string")
    lines = [(1, "ACME Co.", 0.9), (1, "Umbrella", 1.0), (2, "Air  Jordan", 0.8), (3, "sub label", 0.9), (4, "UMBRELLAS", 0.9), (5, "umbrello", 0.9), (6, "zeta", 0.3), (7, "size 42", 0.9), (8, "Zeta!", 0.7), (8, "umbrella", 0.6), (9, None, 0.9), (10, "zetas", 0.9)]
    got = {r.id: (r.verdict, r.brand, round(r.score, 3), r.reason) for r in relational.two_vocabularies(table(lines, "id long, text string, conf double"), catalog, others, parents).collect()}
    assert got == {
        1: ("in_catalog", "Acme", 0.9, "catalog_brand_read"), 2: ("no_evidence", None, 0.0, "sub_brand_of_stocked_parent"), 3: ("no_evidence", None, 0.0, "sub_brand_of_stocked_parent"), 4: ("off_catalog", "Umbrella", 0.847, "known_brand_not_stocked"),
        5: ("no_evidence", None, 0.0, "text_but_no_brand"), 6: ("no_evidence", None, 0.0, "no_text"), 7: ("no_evidence", None, 0.0, "text_but_no_brand"), 8: ("off_catalog", "Zeta", 0.7, "known_brand_not_stocked"), 9: ("no_evidence", None, 0.0, "no_text"), 10: ("no_evidence", None, 0.0, "text_but_no_brand"),
    }
