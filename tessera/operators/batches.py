"""Training batches of products whose shares come from several pools.

A batch starts from a seed product; each tier then adds up to its quota of the pool that the seed points at (its hard
negatives, its siblings, its category, all products), nothing twice.  Draws are windows of a seeded order: the n-th batch
of a pool takes the stretch of the pool's order that starts where the batch before it ended, and goes round.  So a draw
is an equi-join on (pool, place in it), batches of a pool share it evenly, and no task holds a pool."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.curation import seeded
from tessera.sources.store import saved

#: Rows of a pool that one task numbers, about.
PART = 100_000


class Tier(NamedTuple):
    """A share of each batch: `quota` products of the pool that the seed's column `points_at` names, out of members
    (pool, product)."""

    name: str
    quota: int
    points_at: str
    members: DataFrame


def numbered(rows: DataFrame, pool: str, order: Column, key: str, n: int, part: int = PART) -> DataFrame:
    """Rows, about n of them, with `place`, from 0, in their pool's order (a hexadecimal digest, ties by key) and `size`, the
    pool's rows.

    Parts of a pool are ranges of its order: rows are numbered within their part, and parts, of which there are few, get
    the sums of those before them; a pool of all rows is numbered by many tasks."""
    digits = 1
    while 16**digits * part < n:
        digits += 1
    cut = rows.withColumn("_order", order).withColumn("_part", F.substring("_order", 1, digits))
    parts = cut.groupBy(pool, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(pool).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(pool, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(pool)).alias("size"))
    k = F.row_number().over(Window.partitionBy(pool, "_part").orderBy("_order", key))
    return cut.withColumn("_k", k).join(parts, [pool, "_part"]).withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_order", "_part", "_k", "_before")


def compose(products: DataFrame, tiers: list[Tier], size: int, seed: int, seeds: Column | None = None, carry: bool = False) -> DataFrame:
    """(batch, place, tier, product) of batches of `size` products: as many batches as hold all products.

    products: (product, and what tiers point at); `seeds` tells which may be seeds (if none may, all).  The last tier fills
    the batch up; with `carry` a tier also takes what the ones before it left, otherwise only the last one does.  A batch has
    fewer products only if all are in it."""
    products = products.where("product IS NOT NULL")
    n = products.count()
    n_batches = -(-n // size)
    may = products if seeds is None else products.where(F.coalesce(seeds, F.lit(False)))
    may = products if seeds is not None and may.isEmpty() else may
    order = numbered(may.withColumn("_all", F.lit(0)), "_all", seeded(F.col("product"), seed), "product", n).drop("_all")
    picks = F.sequence(F.col("place"), F.greatest(F.col("place"), F.lit(n_batches - 1)), F.col("size"))
    heads = saved(order.withColumn("batch", F.explode(F.filter(picks, lambda b: b < n_batches))).drop("place", "size"), "seeds")
    chosen = saved(heads.select("batch", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("at"), "product"), "batch-products")
    limit = 1
    for i, tier in enumerate(tiers, 1):
        last = i == len(tiers)
        limit += tier.quota
        had = chosen.groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("had"))
        room = F.lit(size) - F.col("had") if last else F.least(F.lit(limit if carry else size) - F.col("had"), F.lit(limit if carry else tier.quota))
        pools = heads.select("batch", F.col(tier.points_at).alias("pool")).where("pool IS NOT NULL")
        turns = numbered(pools, "pool", seeded(F.col("batch"), seed), "batch", n_batches).select("batch", "pool", F.col("place").alias("turn"))
        members = numbered(tier.members.select("pool", "product").where("pool IS NOT NULL AND product IS NOT NULL"), "pool", seeded(F.col("product"), seed + i), "product", n)
        sizes = members.where("place = 0").select("pool", "size")
        # Products that are in the batch already may come up, so as many more are drawn.
        asked = turns.join(sizes, "pool").join(had, "batch").withColumn("room", room).where("room > 0")
        drawn = asked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("room") + F.col("had"), F.col("size")) - 1))).withColumn("place", (F.col("turn") * (size if last else tier.quota) + F.col("at")) % F.col("size"))
        found = drawn.select("batch", "pool", "room", "at", "place").join(members.select("pool", "place", "product"), ["pool", "place"])
        new = found.join(chosen.select("batch", "product"), ["batch", "product"], "left_anti")
        k = F.row_number().over(Window.partitionBy("batch").orderBy("at"))
        new = new.withColumn("_k", k).where(F.col("_k") <= F.col("room"))
        chosen = saved(chosen.unionByName(new.select("batch", F.lit(i).alias("tier"), "at", "product")), "batch-products")
    names = F.element_at(F.array(*map(F.lit, ["seed", *(t.name for t in tiers)])), F.col("tier") + 1)
    place = F.row_number().over(Window.partitionBy("batch").orderBy("tier", "at"))
    return chosen.select("batch", place.alias("place"), names.alias("tier"), "product")


def with_rows(batches: DataFrame, rows: DataFrame, key: str, per_product: int, seed: int, repeat: bool) -> DataFrame:
    """(batch, tier, product, k, key) of per_product rows of each product of a batch, in an order that seed and batch fix.
    A product with fewer gives each again in turn with `repeat`, else once."""
    order = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("batch").cast("string"), F.col(key).cast("string")))
    w = Window.partitionBy("batch", "product")
    some = batches.join(rows.select("product", key), "product").withColumn("k", F.row_number().over(w.orderBy(order, key))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("k") <= per_product)
    if repeat:
        some = some.withColumn("k", F.explode(F.sequence(F.col("k"), F.greatest("k", F.lit(per_product)), F.greatest("n", F.lit(1)).cast("int"))))
    return some.select("batch", "tier", "product", "k", key)


def hard_negative_batches(products: DataFrame, negatives: DataFrame, size: int, seed: int, hard: float = 0.35, category: float = 0.30) -> DataFrame:
    """Seeds are products with hard negatives (code, product); what a pool lacks comes from all products.

    products: (product, category)."""
    codes = negatives.select(F.col("code").alias("product")).distinct().withColumn("_seed", F.lit(True))
    marked = products.withColumn("everything", F.lit("all")).withColumn("self", F.col("product")).join(codes, "product", "left")
    neighbours = negatives.where("code <> product").join(products.select("product"), "product", "left_semi").select(F.col("code").alias("pool"), "product").distinct()
    tiers = [Tier("hard", round(size * hard), "self", neighbours), Tier("category", round(size * category), "category", products.select(F.col("category").alias("pool"), "product")), Tier("random", 0, "everything", products.select(F.lit("all").alias("pool"), "product"))]
    return compose(marked, tiers, size, seed, F.col("_seed"))


def identity_batches(products: DataFrame, size: int, seed: int, sibling: float = 0.375, category: float = 0.375) -> DataFrame:
    """Products with two rows at least, siblings of the seed's identity first; the category also fills what they leave.

    products: (product, identity, category, n_rows)."""
    fit = products.where("n_rows >= 2").withColumn("everything", F.lit("all"))
    tiers = [Tier("sibling", round(size * sibling), "identity", fit.select(F.col("identity").alias("pool"), "product")), Tier("category", round(size * category), "category", fit.select(F.col("category").alias("pool"), "product")), Tier("random", 0, "everything", fit.select(F.lit("all").alias("pool"), "product"))]
    return compose(fit, tiers, size, seed, carry=True)
