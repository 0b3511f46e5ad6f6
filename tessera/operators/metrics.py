"""Ranks, retrieval and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_strict(scores: DataFrame) -> DataFrame:
    """1 + the number of scores above the best target's; (query_id, key, score, is_target)."""
    best = F.max(F.when(F.col("is_target"), F.col("score"))).over(Window.partitionBy("query_id"))
    return scores.withColumn("t", best).where("t IS NOT NULL").groupBy("query_id").agg((F.count_if(F.col("score") > F.col("t")) + 1).alias("rank"))


def rank_positional(scores: DataFrame) -> DataFrame:
    """Place of the first target in the sorted list; the number of rows + 1 without one."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    placed = scores.withColumn("k", F.row_number().over(w)).groupBy("query_id")
    return placed.agg(F.coalesce(F.min(F.when(F.col("is_target"), F.col("k"))), F.count(F.lit(1)) + 1).alias("rank"))


def retrieval_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """Recall at 1, 5 and 10, mean reciprocal rank, both medians and the mean."""
    return ranks.groupBy(*by).agg(
        *[F.avg((F.col("rank") <= k).cast("int")).alias(f"r_at_{k}") for k in (1, 5, 10)], F.avg(1 / F.col("rank")).alias("mrr"),
        F.median("rank").alias("median"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rank)").cast("double").alias("lower_median"), F.avg("rank").alias("mean_rank"),
    )


def cumulated(values: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """Adds before_<column>, the sum of a column over the rows of smaller `order` (one row for each value and group), and
    total_<column>.  Values fall into ranges cut by approximate quantiles; sums of ranges are cumulated first, then the
    rows inside each range, so no task gets all values of a group."""
    cuts = values.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    same = lambda left, right: [F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in by]
    rows = values.join(cuts, same("", "_")) if by else values.crossJoin(cuts)
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts", *[f"_{c}" for c in by])
    sums = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_r")).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    whole = Window.partitionBy(*[f"_{c}" for c in by])  # at most `buckets` rows a group
    ranges = sums.withColumns({f"_b_{c}": F.coalesce(F.sum(f"_s_{c}").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in columns} | {f"total_{c}": F.sum(f"_s_{c}").over(whole) for c in columns})
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, [*same("", "_"), F.col("_range") == F.col("_r")])
    rows = rows.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return rows.select(*values.columns, *[f"{x}_{c}" for c in columns for x in ("before", "total")])


def at_place(place: Column, order: str = "value", n: str = "n") -> Column:
    """The value at a place, from 0, of the sorted list; an aggregate over rows of `cumulated`."""
    return F.max(F.when((F.col(f"before_{n}") <= place) & (place < F.col(f"before_{n}") + F.col(n)), F.col(order)))


def percentiles(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): exact percentiles, interpolated between neighbours; nulls don't count."""
    counts = cumulated(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value", ["n"])
    at = F.col("share") * (F.col("total_n") - 1)
    places = counts.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", at).groupBy("share", "at").agg(at_place(F.floor("at")).alias("low"), at_place(F.ceil("at")).alias("high"))
    return places.select("share", (F.col("low") + (F.col("at") - F.floor("at")) * (F.col("high") - F.col("low"))).alias("value"))


def score_stats(rows: DataFrame, by: str, column: str, share: float, gate: float) -> DataFrame:
    """Per group the number of rows, the median, the value at position int(share * n) - 1 of the sorted list (the last
    one where that is below 0), and how many rows lie below the gate."""
    values = rows.groupBy(by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.col("total_n")
    place = F.floor(share * total).cast("long")
    place = F.when(place >= 1, place - 1).otherwise(total - 1)
    median = [at_place(f((total - 1) / 2)) for f in (F.floor, F.ceil)]
    return cumulated(values, "value", ["n"], (by,)).groupBy(by).agg(
        F.sum("n").alias("n"), ((median[0] + median[1]) / 2).alias("median"), at_place(place).alias("at_share"), F.coalesce(F.sum(F.when(F.col("value") < gate, F.col("n"))), F.lit(0)).alias("gate_fails"),
    )


def auroc(scores: DataFrame, *by: str) -> DataFrame:
    """Mann-Whitney with ties counted half; null where a class is missing.  Scores are counted by value first,
    and a value's rank comes from the cumulated counts, so no list of all scores is held anywhere."""
    values = scores.groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    wins = cumulated(values, "score", ["n"], by).withColumn("wins", F.col("p") * (F.col("before_n") + F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    return wins.groupBy(*by).agg(F.when(total > 0, F.sum("wins") / total).alias("auroc"))


def operating_table(scores: DataFrame, shares: Sequence[int] = (1, 2, 5, 10, 20, 30, 50)) -> DataFrame:
    """Thresholds at percentiles of the positives, with the shares rejected and accepted wrongly."""
    cut = percentiles(scores.where("positive"), "score", [q / 100 for q in shares]).select(F.round(F.col("share") * 100).cast("int").alias("percentile"), F.col("value").alias("threshold"))
    return scores.crossJoin(cut).groupBy("percentile", "threshold").agg(
        (F.count_if(F.col("positive") & (F.col("score") < F.col("threshold"))) / F.count_if("positive")).alias("false_reject"),
        (F.count_if(~F.col("positive") & (F.col("score") >= F.col("threshold"))) / F.count_if(~F.col("positive"))).alias("false_accept"),
    )


def best_threshold(scores: DataFrame) -> DataFrame:
    """The observed score of least false-reject plus false-accept share, the smallest of equals."""
    values = cumulated(scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")), "score", ["p", "n"])
    cost = F.col("before_p") / F.col("total_p") + 1 - F.col("before_n") / F.col("total_n")
    return values.withColumn("cost", F.round(cost, 12)).orderBy("cost", "score").limit(1).select(F.col("score").alias("threshold"), "cost")


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval, cut to [0, 1]; (0, 0) of nothing."""
    p = hits / total
    centre, half = p + z * z / (2 * total), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    ends = [(centre + sign * half) / (1 + z * z / total) for sign in (-1, 1)]
    return tuple(F.when(total > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0) for x in ends)


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of (truth, predicted) rows; 0 for an empty denominator."""
    sides = pairs.select(F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("cls"), "truth", "predicted").where("cls IS NOT NULL")
    n = sides.groupBy("cls").agg(F.count_if((F.col("truth") == F.col("cls")) & (F.col("predicted") == F.col("cls"))).alias("tp"), F.count_if(F.col("predicted") == F.col("cls")).alias("predicted_n"), F.count_if(F.col("truth") == F.col("cls")).alias("support"))
    p, r = F.col("tp") / F.greatest("predicted_n", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return n.select("cls", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Mean F1 of the classes that the truth holds."""
    return class_report(pairs).where("support > 0").agg(F.avg("f1").alias("macro_f1"))


def abstain_sweep(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Fire rate, precision and recall at each threshold of (truth, predicted, score) rows."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    fires = F.col("score") >= F.col("threshold")
    right = F.count_if(fires & (F.col("truth") == F.col("predicted")))
    return rows.select("truth", "predicted", "score", t).groupBy("threshold").agg(F.avg(fires.cast("int")).alias("fire_rate"), (right / F.greatest(F.count_if(fires), F.lit(1))).alias("precision"), (right / F.count(F.lit(1))).alias("recall"))


def deep_diff(left: DataFrame, right: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """(id, path, value) rows that differ; a missing path counts as a difference."""
    a, b = left.withColumnRenamed("value", "left"), right.withColumnRenamed("value", "right")
    rows = a.where(~F.col("path").isin(*ignored)).withColumn("_a", F.lit(1)).join(b.where(~F.col("path").isin(*ignored)).withColumn("_b", F.lit(1)), ["id", "path"], "full")
    return rows.where(~F.col("left").eqNullSafe(F.col("right")) | F.col("_a").isNull() | F.col("_b").isNull()).select("id", "path", "left", "right")


def first_of(hits: DataFrame, *order: str | Column) -> DataFrame:
    """The first hit of each query."""
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("_k = 1").drop("_k")


def top_one_split(firsts: DataFrame, same: Column) -> DataFrame:
    """Shares of first hits of the same model and of unrelated ones."""
    return firsts.agg(F.avg(same.cast("int")).alias("same_model"), F.avg((~same).cast("int")).alias("unrelated"))


def miss_rate(scores: DataFrame) -> DataFrame:
    """The share of queries whose shortlist holds no target."""
    return scores.groupBy("query_id").agg(F.max("is_target").alias("found")).agg(F.avg((~F.col("found")).cast("int")).alias("miss_rate"))


def overlap(scores: DataFrame, by: str) -> DataFrame:
    """Per group how many positives lie below its highest negative, and negatives above its lowest positive; the
    edges are aggregates, so no group is gathered."""
    edges = scores.groupBy(F.col(by).alias("_by")).agg(F.max(F.when(~F.col("positive"), F.col("score"))).alias("_high"), F.min(F.when(F.col("positive"), F.col("score"))).alias("_low"))
    rows = scores.join(edges, F.col(by).eqNullSafe(F.col("_by")))
    return rows.groupBy(by).agg(F.count_if(F.col("positive") & (F.col("score") < F.col("_high"))).alias("pos_below"), F.count_if(~F.col("positive") & (F.col("score") > F.col("_low"))).alias("neg_above"))


def precision_at(judged: DataFrame, by: str, order: list[Column | str], right: Column, k: int = 15) -> DataFrame:
    """The share of right ones among each group's first k judged rows."""
    first = judged.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= k)
    return first.groupBy(by).agg(F.avg(right.cast("int")).alias("precision"))


def positive_floor(scores: DataFrame, share: float = 0.01) -> DataFrame:
    """One row: the lowest positive score (no false reject), and the one that rejects `share` of the positives."""
    positives = scores.where("positive")
    return positives.agg(F.min("score").alias("lowest")).crossJoin(percentiles(positives, "score", [share]).select(F.col("value").alias("at_share")))


def agreement(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """The share of each group's rows whose two verdicts agree."""
    return pairs.groupBy(by).agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def recall_by_cohort(ranks: DataFrame, cohort: Column, k: int = 1) -> DataFrame:
    """Recall at k of unseen products and of the control group."""
    return ranks.groupBy(cohort.alias("unseen")).agg(F.avg((F.col("rank") <= k).cast("int")).alias("r_at_1"), F.count(F.lit(1)).alias("n"))


def pair_recall(labels: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(k, hits, n, recall, low, high) of judged items (verdict, rank): of those that the catalog holds (`correct` or
    `missed`) how many were right among the first k, with the Wilson interval; null recall of none."""
    right = F.col("verdict") == "correct"
    counts = labels.agg(F.count_if(F.col("verdict").isin("correct", "missed")).alias("n"), *[F.count_if(right & (F.col("rank") <= k)).alias(f"h{k}") for k in ks])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("x")).select("x.k", "x.hits", "n")
    low, high = wilson(F.col("hits"), F.col("n"))
    return rows.select("k", "hits", "n", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("recall"), low.alias("low"), high.alias("high"))


def open_set_table(labels: DataFrame) -> DataFrame:
    """(threshold, false_reject, false_accept) at each first score of judged items (verdict, rank, top1), rounded to two
    places: the share of items right at rank 1 that score below it, and of absent ones that don't.  Scores and thresholds are
    counted by value, and shares come from the cumulated counts."""
    score, right, absent = F.col("top1"), (F.col("verdict") == "correct") & (F.col("rank") == 1), F.col("verdict") == "absent"
    judged = labels.where(score.isNotNull() & (right | absent))
    values = judged.select(score.cast("double").alias("value"), right.cast("int").alias("p"), absent.cast("int").alias("a"), F.lit(0).alias("mark"))
    marks = judged.select(F.bround(score.cast("double"), 2).alias("value"), F.lit(0).alias("p"), F.lit(0).alias("a"), F.lit(1).alias("mark"))
    counted = values.unionByName(marks).groupBy("value").agg(F.sum("p").alias("p"), F.sum("a").alias("a"), F.max("mark").alias("mark"))
    rows = cumulated(counted, "value", ["p", "a"]).where("mark = 1 AND total_p > 0 AND total_a > 0")
    return rows.select(F.col("value").alias("threshold"), (F.col("before_p") / F.col("total_p")).alias("false_reject"), (1 - F.col("before_a") / F.col("total_a")).alias("false_accept"))


def _asserted(threshold: float) -> Column:
    return F.when(F.col("score") >= threshold, F.col("predicted"))


def abstain_report(rows: DataFrame, threshold: float) -> DataFrame:
    """Per true class of (truth, predicted, score), and `OVERALL`: support, right and wrong assertions of it, recall,
    precision (null where it is never asserted) and the share of its rows where nothing was asserted."""
    said = rows.select("truth", _asserted(threshold).alias("said"))
    of = said.groupBy(F.col("truth").alias("cls")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("said").isNull()).alias("abstained"), F.count_if(F.col("said") == F.col("truth")).alias("tp"))
    wrong = said.where("said <> truth").groupBy(F.col("said").alias("cls")).agg(F.count(F.lit(1)).alias("fp"))
    each = of.join(wrong, "cls", "left").select("cls", "support", "abstained", "tp", F.coalesce("fp", F.lit(0)).alias("fp"))
    whole = said.agg(F.lit("OVERALL").alias("cls"), F.count(F.lit(1)).alias("support"), F.count_if(F.col("said").isNull()).alias("abstained"), F.count_if(F.col("said") == F.col("truth")).alias("tp"), F.count_if(F.col("said") != F.col("truth")).alias("fp"))
    both = each.unionByName(whole.where("support > 0"))
    return both.select("cls", "support", "tp", "fp", (F.col("tp") / F.col("support")).alias("recall"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("abstained") / F.col("support")).alias("abstain"))


def abstain_confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """(truth, said, n), where what wasn't asserted is `(abstain)`."""
    return rows.groupBy("truth", F.coalesce(_asserted(threshold), F.lit("(abstain)")).alias("said")).agg(F.count(F.lit(1)).alias("n"))
