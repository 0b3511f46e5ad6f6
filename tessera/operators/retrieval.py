"""Two-stage retrieval, re-ranking and multi-part search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, top_k
from tessera.operators.relational import box_iou


def softmax(score: Column, temperature: float, *by: str) -> Column:
    """V7: stable softmax over each query's rows."""
    w = Window.partitionBy(*by)
    e = F.exp((score - F.max(score).over(w)) / temperature)
    return e / F.sum(e).over(w)


def rerank(hits: DataFrame, fusion: tuple[float, float] | None = None, bonus: Column | None = None) -> DataFrame:
    """V4: (query_id, code, a, b) hits by encoder b.  With fusion both scores are standardised over the query (sample
    deviation; 0 where that is below 1e-6 or one row is left) and weighted.  The score given is b's, the order the
    ranking score's."""
    w = Window.partitionBy("query_id")

    def z(c: str) -> Column:
        sd = F.stddev_samp(c).over(w)
        return F.when((sd > 1e-6) & (F.count(F.lit(1)).over(w) > 1), (F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0)

    ranking = F.col("b") if fusion is None else fusion[0] * z("b") + fusion[1] * z("a")
    ranking = ranking if bonus is None else ranking + bonus
    order = Window.partitionBy("query_id").orderBy(F.desc("ranking"), "code")
    return hits.withColumn("ranking", ranking).withColumn("rank", F.row_number().over(order)).select("query_id", "code", F.col("b").alias("score"), "rank")


def max_sim(query_patches: DataFrame, candidate_patches: DataFrame) -> DataFrame:
    """V5: mean over a query's patches of the best candidate patch; (query_id, patch, embedding) and (code, embedding)."""
    pairs = query_patches.join(candidate_patches, "query_id").withColumn("s", dot("embedding", "other"))
    return pairs.groupBy("query_id", "code", "patch").agg(F.max("s").alias("s")).groupBy("query_id", "code").agg(F.avg("s").alias("score"))


def nearest_of_group(vectors: DataFrame, key: str, group: str, k: int) -> DataFrame:
    """(query_id, code, score, k) of each row's k nearest other rows of its group."""
    rows = vectors.select(F.col(key).alias("query_id"), "embedding", group)
    found = top_k(rows, vectors.select(F.col(key).alias("key"), "embedding", group), k + 1, group=group).where("query_id <> key")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("query_id", F.col("key").alias("code"), "score", "k")


def members(chosen: DataFrame, rows: DataFrame, group: str, key: str, lanes: int = 64) -> DataFrame:
    """V3: every row of each chosen group, chosen's columns first.  Groups are few and their rows many, so a group's rows are
    dealt to lanes and the chosen ones go to all of them; the partitions are as many as the lanes or Spark's own, since what
    is joined is small and what comes out is not."""
    n = max(lanes, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = chosen.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(n, group, "_lane")
    right = rows.withColumn("_lane", F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")).repartition(n, group, "_lane")
    return left.join(right.hint("shuffle_hash"), [group, "_lane"]).drop("_lane")


def window_rerank(hits: DataFrame, score: str, window: int = 10) -> DataFrame:
    """The first `window` rows of each query in the order of another score, the rest as they were."""
    inside = F.col("rank") <= window
    order = Window.partitionBy("query_id").orderBy(F.desc(inside), F.desc(F.when(inside, F.col(score))), "rank")
    return hits.withColumn("new_rank", F.row_number().over(order))


def flags(hits: DataFrame, queries: DataFrame, reject: float, ambiguous: float = 0.03) -> DataFrame:
    """Per query whether it is rejected (no result, or the first below the threshold) and whether the first
    two are one identity's and closer than `ambiguous`."""
    first = hits.where("rank <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.col("identity"))).alias("i1"), F.max(F.when(F.col("rank") == 2, F.col("identity"))).alias("i2"),
    )
    same = F.coalesce((F.col("i1") == F.col("i2")) & (F.abs(F.col("s1") - F.col("s2")) < ambiguous), F.lit(False))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce(F.col("s1") < reject, F.lit(True)).alias("rejected"), same.alias("ambiguous"))


def fill_up(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """K results of each query, lexical ones before semantic ones, none twice; (query_id, code, rank) both."""
    rows = first.withColumn("stage", F.lit(0)).unionByName(second.withColumn("stage", F.lit(1)))
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "code").orderBy("stage", "rank"))).where("_k = 1").drop("_k")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "rank", "code"))).where(F.col("place") <= k)


def colour_bonus(learned: Column, heuristic: Column, wanted: Column, delta: Column) -> Column:
    """1 for the learned colour, a half for the heuristic one, or how near the colours are."""
    return F.greatest((learned == wanted).cast("double"), 0.5 * (heuristic == wanted).cast("double"), F.exp(-F.pow(delta / 25, 2)))


def reference_bonus(l1: Column, a1: Column, b1: Column, reference: tuple[float, float, float], falloff: float = 12.0) -> Column:
    """exp(-(distance / falloff)^2) from a reference vector, its first component weighted 0.4."""
    d = F.sqrt(F.pow((l1 - reference[0]) * 0.4, 2) + F.pow(a1 - reference[1], 2) + F.pow(b1 - reference[2], 2))
    return F.exp(-F.pow(d / falloff, 2))


def assign(scores: DataFrame, whole: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment of query parts to a post's items.

    scores: (query_id, post, part, item, score), whole: (query_id, post, part, weight, score) with the part's score of
    the whole photo.  Parts go in the order of their best item; each takes its best item that is still free (the first
    of equals), or the whole photo where none is left; the post's total is the weighted mean.  A group is one query's
    parts times one post's items, so it stays small however many posts there are, and the fold over it stays in the JVM."""
    items = scores.groupBy("query_id", "post", "part").agg(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("double")).alias("minus"), F.col("item").cast("long").alias("item")))).alias("items"))
    parts = whole.select("query_id", "post", F.col("part").cast("long").alias("part"), F.col("weight").cast("double").alias("weight"), F.col("score").cast("double").alias("score")).join(items, ["query_id", "post", "part"], "left")
    part = F.struct(F.coalesce(F.get("items", F.lit(0))["minus"], F.lit(1.0)).alias("first"), "part", "weight", "score", F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRUCT<minus: DOUBLE, item: BIGINT>>)")).alias("items"))
    start = F.struct(F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("used"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("weights"), F.expr("CAST(array() AS ARRAY<STRUCT<part: BIGINT, item: BIGINT>>)").alias("picks"))

    def take(state: Column, p: Column) -> Column:
        best = F.get(F.filter(p["items"], lambda x: ~F.array_contains(state["used"], x["item"])), F.lit(0))
        item = F.coalesce(best["item"], F.lit(-1).cast("long"))
        return F.struct(
            F.concat(state["used"], F.array(item)).alias("used"), (state["sum"] + p["weight"] * F.coalesce(-best["minus"], p["score"])).alias("sum"),
            (state["weights"] + p["weight"]).alias("weights"), F.concat(state["picks"], F.array(F.struct(p["part"].alias("part"), item.alias("item")))).alias("picks"),
        )

    done = parts.groupBy("query_id", "post").agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("s", F.aggregate("parts", start, take))
    picks = F.array_join(F.transform(F.array_sort("s.picks"), lambda x: F.concat_ws(":", x["part"].cast("string"), x["item"].cast("string"))), ",")
    return done.select("query_id", "post", F.when(F.col("s.weights") > 0, F.col("s.sum") / F.col("s.weights")).otherwise(0.0).alias("total"), picks.alias("picks"))


def suppress(boxes: DataFrame, photo: str = "photo", most_iou: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression per photo, then the best box of each category; boxes: (photo, id, category,
    confidence, box [x1, y1, x2, y2]).  A photo's boxes are few; they are folded in order of confidence."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), "id", "category", "box")))
    kept = F.aggregate("bs", F.filter("bs", lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda k: box_iou(k["box"], x["box"]) > most_iou), kept).otherwise(F.concat(kept, F.array(x))))
    rows = boxes.groupBy(photo).agg(ordered.alias("bs")).select(photo, F.posexplode(kept).alias("k", "x"))
    return rows.groupBy(photo, "x.category").agg(F.min_by("x", "k").alias("x")).select(photo, F.col("x.id").alias("id"), "category", (-F.col("x.minus")).alias("confidence"))


def best_crop(crops: DataFrame, by: str, key: str, area: Column, least: float = 0.4, band: tuple[float, float] = (2, 55)) -> DataFrame:
    """Of each category's crops that are sure enough and whose area lies in the band the surest, the first of equals."""
    some = crops.where((F.col("confidence") >= least) & area.between(*band))
    return some.groupBy(by).agg(F.max_by(key, F.struct("confidence", -F.col(key))).alias(key))
