"""Co-occurrence of categories within posts: support, confidence, lift and NPMI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_observations(items: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """A1: of each post's items of one category the most confident, the first of equals."""
    w = Window.partitionBy("post", "category").orderBy(F.desc("confidence"), "ix", "code")
    return items.where(F.col("confidence") >= min_confidence).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def npmi(joint: Column, p_a: Column, p_b: Column) -> Column:
    """ln(p(ab) / (p(a) p(b))) / -ln(p(ab)); 0 where a probability or the denominator is 0."""
    return F.when((joint <= 0) | (p_a <= 0) | (p_b <= 0) | (joint >= 1), F.lit(0.0)).otherwise(F.log(joint / (p_a * p_b)) / -F.log(joint))


def pair_counts(observations: DataFrame, *context: str) -> DataFrame:
    """Unordered pairs of categories of one post, by context.  A post's distinct categories are few, so its pairs are
    formed inside its row: the posts are shuffled once and not joined with themselves."""
    sets = observations.groupBy("post", *context).agg(F.array_sort(F.collect_set("category")).alias("cs"))
    pairs = F.explode(F.expr("flatten(transform(cs, (x, i) -> transform(slice(cs, i + 2, size(cs)), y -> struct(x AS a, y AS b))))"))
    return sets.where(F.size("cs") > 1).select(*context, pairs.alias("p")).groupBy(*context, "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def totals(observations: DataFrame) -> DataFrame:
    """One row; the denominator is all posts that keep an item, also those with one."""
    return observations.agg(F.countDistinct("post").alias("posts"))


def pair_table(observations: DataFrame, min_pair_count: int = 3) -> DataFrame:
    """Pairs with count, both confidences, lift and NPMI."""
    n = observations.groupBy("category").agg(F.count(F.lit(1)).alias("n_c"))
    a, b = n.select(F.col("category").alias("a"), F.col("n_c").alias("n_a")), n.select(F.col("category").alias("b"), F.col("n_c").alias("n_b"))
    pairs = pair_counts(observations).where(F.col("n") >= min_pair_count).join(a, "a").join(b, "b").crossJoin(totals(observations))
    joint, p_a, p_b = (F.col(c) / F.col("posts") for c in ("n", "n_a", "n_b"))
    return pairs.select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("p_b_given_a"), (F.col("n") / F.col("n_b")).alias("p_a_given_b"), (joint / (p_a * p_b)).alias("lift"), npmi(joint, p_a, p_b).alias("npmi"))


def examples(observations: DataFrame, most: int = 5) -> DataFrame:
    """The first posts of each pair, in post order; a bounded list per pair, kept by a ranked window."""
    sets = observations.groupBy("post").agg(F.array_sort(F.collect_set("category")).alias("cs"))
    pairs = sets.select("post", F.explode(F.expr("flatten(transform(cs, (x, i) -> transform(slice(cs, i + 2, size(cs)), y -> struct(x AS a, y AS b))))")).alias("p")).select("post", "p.a", "p.b")
    w = Window.partitionBy("a", "b").orderBy("post")
    return pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy("a", "b").agg(F.array_sort(F.collect_list("post")).alias("posts"))


def colour_pairs(observations: DataFrame, most: int = 40, min_count: int = 3) -> DataFrame:
    """C4: (category, colour) with each category it meets, both directions: the top `most`, of those the frequent."""
    sets = observations.groupBy("post").agg(F.collect_list(F.struct("category", "colour")).alias("cs"))
    met = F.explode(F.expr("flatten(transform(cs, x -> transform(filter(cs, y -> y.category <> x.category), y -> struct(x.category, x.colour, y.category AS b, y.colour AS b_colour))))"))
    n = sets.where(F.size("cs") > 1).select(met.alias("p")).groupBy("p.category", "p.colour", "p.b", "p.b_colour").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category", "colour").orderBy(F.desc("n"), "b", "b_colour")
    return n.withColumn("k", F.row_number().over(w)).where((F.col("k") <= most) & (F.col("n") >= min_count))


def by_context(observations: DataFrame, most: int = 15, min_posts: int = 20) -> DataFrame:
    """Top pairs of each context that has enough posts of several items; share of those posts."""
    sizes = observations.groupBy("context", "post").agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("context").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_posts)
    w = Window.partitionBy("context").orderBy(F.desc("n"), "a", "b")
    pairs = pair_counts(observations, "context").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return pairs.join(sizes, "context").select("context", "a", "b", "n", (F.col("n") / F.col("total")).alias("share"))


def profiles(observations: DataFrame, most: int = 6) -> DataFrame:
    """Per category its posts, their share, the group last seen and its most frequent colours."""
    w = Window.partitionBy("category").orderBy(F.desc("n"), "colour")
    colours = observations.groupBy("category", "colour").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    colours = colours.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "colour"))), lambda x: x["colour"]), ",").alias("colours"))
    main = observations.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max_by("grp", F.struct("post", "ix")).alias("grp"))
    return main.crossJoin(totals(observations)).join(colours, "category").select("category", "n", (F.col("n") / F.col("posts")).alias("share"), "grp", "colours")


def diagnostics(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean items of a post, pairs, pairs below lift 1, and whether lift can be relied on (not without pairs)."""
    sizes = observations.groupBy("post").agg(F.count(F.lit(1)).alias("k")).agg(F.avg("k").alias("mean_items"))
    lifts = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("lift") < 1).alias("below_one"))
    return sizes.crossJoin(lifts).withColumn("lift_is_unreliable", (F.col("n_pairs") == 0) | (F.col("below_one") > F.col("n_pairs") / 2))


def companions(pairs: DataFrame, category: str, top_k: int = 8, min_count: int = 3, rank_by: str = "count") -> DataFrame:
    """What goes with a category, by count and share or by lift and count."""
    sides = pairs.select(F.col("a").alias("of"), F.col("b").alias("companion"), "n", F.col("p_b_given_a").alias("share"), "lift").unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("companion"), "n", F.col("p_a_given_b").alias("share"), "lift"))
    order = ["n", "share"] if rank_by == "count" else ["lift", "n"]
    return sides.where((F.col("of") == category) & (F.col("n") >= min_count)).orderBy(*[F.desc(c) for c in order], "companion").limit(top_k)


def evidence(pairs: DataFrame, a: str, b: str, min_evidence: int = 5) -> DataFrame:
    """The pair in either order, and whether it is seen often enough to claim it."""
    low, high = sorted((a, b))
    return pairs.where((F.col("a") == low) & (F.col("b") == high)).withColumn("enough", F.col("n") >= min_evidence)


def companion_colours(colour_table: DataFrame, category: str, colour: str, other: str, top_k: int = 5) -> DataFrame:
    """Colours of another category seen with this category in this colour."""
    hit = (F.col("category") == category) & (F.col("colour") == colour) & (F.col("b") == other)
    return colour_table.where(hit).orderBy(F.desc("n"), "b_colour").limit(top_k).select("b_colour", "n")


def rerank_by_colour(hits: DataFrame, support: DataFrame) -> DataFrame:
    """C11: (query, code, rank, colour) hits ordered by their colours' highest support, then by rank."""
    best = hits.join(support, "colour", "left").groupBy("query", "code", "rank").agg(F.coalesce(F.max("n"), F.lit(0)).alias("support"))
    return best.withColumn("new_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("support"), "rank", "code")))
