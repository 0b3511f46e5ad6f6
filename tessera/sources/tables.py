"""The tables that queries read, and the shapes that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Detected items: an order is a post, a line an item; a part's name is a colour and a garment."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    name = F.split("p_name", " ")
    return table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("post"), F.col("l_linenumber").alias("ix"), name[1].alias("category"), name[0].alias("colour"), (F.col("l_quantity") / 50).alias("confidence"),
        F.col("p_type").alias("grp"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("code"), F.col("l_returnflag").alias("source"),
    )


#: The same as a CTE.
ITEMS_SQL = """items AS (SELECT l_orderkey AS post, l_linenumber AS ix, split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) AS colour,
  l_quantity / 50 AS confidence, p_type AS grp, p_brand AS brand, p_partkey AS code, l_returnflag AS source FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with their context: the customer's segment is the section."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("post"), F.col("c_mktsegment").alias("section"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


POSTS_SQL = "posts AS (SELECT o_orderkey AS post, c_mktsegment AS section, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey)"
