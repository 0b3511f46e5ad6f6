"""Orders whose ties and places are easily got wrong, against the SQL or exact numbers."""

import duckdb
import pytest

from tessera.operators import relational
from tessera.plans import catalog
from tests.compare import duck_rows, spark_rows

catalog.load()


@pytest.mark.parametrize("name", ["O14_one_per_post", "O21_ordered_distinct"])
def test_codes_of_six_digits(spark, tmp_path, name):
    """A code of 250,000 on line 1 comes after one of 7 on line 2."""
    spark.createDataFrame([(250_000, "red gear"), (7, "blue bolt"), (120_000, "red rod")], "p_partkey long, p_name string").selectExpr("*", "'b' AS p_brand", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, 250_000), (1, 2, 7), (2, 1, 120_000), (2, 2, 7), (2, 3, 250_000), (3, 1, 7), (3, 2, 120_000)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").selectExpr("*", "1D AS l_quantity", "'R' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").selectExpr("*", "'F' AS o_orderstatus", "1D AS o_totalprice", "'1' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "x")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for table in ("part", "lineitem", "orders", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == duck_rows(con.sql(catalog.ORACLES[name]))


def test_equal_means_are_equal_however_they_are_added(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (1, "a", 0.2), (1, "a", 0.3), (1, "b", 0.2), (2, "a", 0.3), (2, "b", 0.2)], "key int, cls string, p double")
    assert {r.key: r.cls for r in relational.pooled_class(rows.coalesce(1), "key").collect()} == {1: "b", 2: "a"}
