"""Filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import candidates, indel_ratio


def section_excluded(source: Column, section: Column, sources: tuple[str, ...] = (), words: tuple[str, ...] = ()) -> Column:
    """The row's source is listed, or its section (lower case) contains one of the words."""
    text = F.lower(F.coalesce(section, F.lit("")))
    hit = F.coalesce(source.isin(*sources), F.lit(False)) if sources else F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def facet_filter(items: DataFrame, categories: list[str], colours: list[str]) -> DataFrame:
    """P5: posts that overlap each facet that is asked for (any value of one facet, all facets)."""
    sets = items.groupBy("post").agg(F.collect_set("category").alias("cs"), F.collect_set("colour").alias("ks"))
    if categories:
        sets = sets.where(F.arrays_overlap("cs", F.array(*map(F.lit, categories))))
    return (sets.where(F.arrays_overlap("ks", F.array(*map(F.lit, colours)))) if colours else sets).select("post")


def gate_or_all(hits: DataFrame, match: Column, *by: str) -> DataFrame:
    """Of each query the rows that match; all of them where none does.  filter_applied tells which."""
    w = Window.partitionBy(*by)
    return hits.withColumn("_m", match).withColumn("filter_applied", F.max("_m").over(w)).where(F.col("_m") | ~F.col("filter_applied")).drop("_m")


def margin(scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """Best positive less best negative similarity, and whether it reaches the threshold; one pass."""
    best = scores.groupBy(key).agg(F.max(F.when(F.col("positive"), F.col("sim"))).alias("p"), F.max(F.when(~F.col("positive"), F.col("sim"))).alias("n"))
    return best.select(key, (F.col("p") - F.col("n")).alias("margin")).withColumn("passes", F.col("margin") >= threshold)


def accept(reason: Column, score: Column, predicted: Column, threshold: float) -> Column:
    """The prediction where the reason is a match and the score reaches the threshold, else null."""
    return F.when((reason == "match") & (score >= threshold), predicted)


def backfill(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Fills a column's nulls from another table."""
    other = right.select(key, F.col(column).alias("_b"))
    return left.join(other, key, "left").withColumn(column, F.coalesce(column, "_b")).drop("_b")


def exactly_one(labels: DataFrame, detections: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Pairs whose key has one detection and one distinct label value; the others with the reason they go."""
    crops = detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_crops"))
    named = labels.groupBy(*keys).agg(F.collect_set(values).alias("_v"))
    reason = F.when(F.col("n_crops").isNull(), "no crop").when(F.col("n_crops") > 1, "several crops").when(F.size("_v") > 1, "several values").otherwise("kept")
    return named.join(crops, keys, "left").withColumn("reason", reason).withColumn(values, F.when(F.col("reason") == "kept", F.col("_v")[0])).drop("_v")


def box_iou(a: Column, b: Column) -> Column:
    """intersection over union of [x1, y1, x2, y2] boxes; 0 for an empty union."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    inter = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def best_overlap(left: DataFrame, right: DataFrame, on: str, min_iou: float) -> DataFrame:
    """For each left box (id, box) of a photo the right box (other, other_box) of highest IoU, if above min_iou."""
    w = Window.partitionBy(on, "id").orderBy(F.desc("iou"), "other")
    pairs = left.join(right, on).withColumn("iou", box_iou(F.col("box"), F.col("other_box"))).where(F.col("iou") > min_iou)
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(on, "id", "other", "iou")


def last_of_path(paths: DataFrame, terms: DataFrame, key: str = "code") -> DataFrame:
    """Of each row's path the values of the last entry that the term table knows; entries are compared trimmed
    and in lower case; paths: (key, path), terms: (term, values ...)."""
    values = [c for c in terms.columns if c != "term"]
    steps = paths.select(key, F.posexplode("path").alias("pos", "term")).withColumn("term", F.lower(F.trim("term")))
    known = terms.withColumn("term", F.lower(F.trim("term")))
    return steps.join(known, "term").groupBy(key).agg(F.max_by(F.struct(*values), "pos").alias("v")).select(key, "v.*")


def fuzzy_match(words: DataFrame, aliases: DataFrame, short: int = 5, floor_short: float = 90, floor: float = 80) -> DataFrame:
    """(word, alias, ratio) pairs whose similarity reaches the floor, a higher one for short aliases; words:
    (word), aliases: (alias).  Floors of 80 and more leave a pair two neighbouring letters in common (90 for aliases of
    up to five), so pairs meet by these and by the lengths that the floor allows, and only they are compared."""
    pair = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2))))).alias("two")
    least = F.when(F.length("alias") <= short, floor_short).otherwise(floor)
    fits = 200 * F.least(F.length("word"), F.length("alias")) >= least * (F.length("word") + F.length("alias"))
    near = words.select("word", pair("word")).join(aliases.select("alias", pair("alias")), "two").where(fits).select("word", "alias").distinct()
    return near.withColumn("ratio", indel_ratio("word", "alias")).where(F.col("ratio") >= least)


def renormalised(scores: DataFrame, allowed: DataFrame) -> DataFrame:
    """(region, cls, p) with the groups each class may be, renormalised per region; the best group.  Sums are rounded
    to nine places, so that shares don't depend on the order in which Spark adds.

    The groups, a row for each that a class may be, are broadcast, since one class may hold a large part of all rows.  Rows
    are dealt by region and sorted once, which serves both sums and the choice; no table of groups is held in memory."""
    rows = scores.join(F.broadcast(allowed), "cls").select("region", "grp", "p").repartition("region")
    of = Window.partitionBy("region", "grp").orderBy("grp")
    mass = rows.select("region", "grp", F.round(F.sum("p").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 9).alias("mass"), F.row_number().over(of).alias("_k")).where("_k = 1")
    mass = mass.withColumn("share", F.col("mass") / F.round(F.sum("mass").over(Window.partitionBy("region")), 9))
    return mass.groupBy("region").agg(F.max_by("grp", F.struct("share", "grp")).alias("grp"), F.max("share").alias("share"))


def prototypes(vectors: DataFrame, key: str, order: str, most: int = 6) -> DataFrame:
    """A2: normalised element-wise mean of the first `most` vectors of each key."""
    w = Window.partitionBy(key).orderBy(order)
    first = vectors.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    means = first.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", norm).select(key, F.transform("v", lambda x: x / F.col("n")).alias("prototype"))


def by_product(results: DataFrame, rule: str = "max") -> DataFrame:
    """A3, A4: products scored by their views: max or mean, the best view, and how many matched."""
    score = F.max("score") if rule == "max" else F.avg("score")
    return results.groupBy("query", "product").agg(score.alias("score"), F.max_by("view", F.struct("score", -F.col("view"))).alias("best_view"), F.count(F.lit(1)).alias("matched_views"))


def token_index(texts: DataFrame, fields: list[str], stopwords: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Token -> (field, value) counts; tokens are F21's, of at least three letters, and not stop words."""
    rows = texts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("r")).select("r.field", "r.value")
    tokens = rows.withColumn("token", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[a-z][a-z\-']+"), F.lit(0))))
    return tokens.where((F.length("token") >= least) & ~F.col("token").isin(*stopwords)).groupBy("token", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def label_index(products: DataFrame, projections: list[Column]) -> DataFrame:
    """Label -> product codes over several ways of naming a product; one scan, exploded."""
    return products.select("code", F.explode(F.array(*projections)).alias("label")).where(F.length("label") > 0).distinct()


def training_labels(products: DataFrame, texts: list[Column]) -> DataFrame:
    """Labels in order of position, the first of a key kept, the kind by the fraction of the list passed."""
    n = len(texts)
    kind = lambda i: "model" if i / n < 0.2 else "attribute" if i / n < 0.45 else "brand" if i / n < 0.7 else "generic"
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind(i)).alias("kind"), t.alias("label")) for i, t in enumerate(texts)])
    w = Window.partitionBy("code", "label").orderBy("i")
    rows = products.select("code", F.explode(entries).alias("e")).select("code", "e.i", "e.kind", "e.label")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def fold_rare(rows: DataFrame, label: str, in_train: Column, least: int, other: str = "other") -> DataFrame:
    """Labels with at least `least` training rows, the rest as one class; null labels go."""
    some = rows.where(F.col(label).isNotNull())
    keep = some.groupBy(label).agg(F.count_if(in_train).alias("_n")).where(F.col("_n") >= least).select(label, F.lit(True).alias("_kept"))
    return some.join(keep, label, "left").withColumn("folded", F.when(F.col("_kept"), F.col(label)).otherwise(other)).drop("_kept")


def pooled_class(probs: DataFrame, key: str, pool: str = "mean") -> DataFrame:
    """Per key the class of highest mean (or highest maximal, renormalised) probability, of equals the last.
    Means are compared to twelve places, so that ties don't depend on the order in which Spark adds."""
    p = probs.groupBy(key, "cls").agg((F.avg("p") if pool == "mean" else F.max("p")).alias("p"))
    p = p.withColumn("by", F.round("p", 12) if pool == "mean" else F.col("p")).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))
    return p.groupBy(key).agg(F.max_by("cls", F.struct("by", "cls")).alias("cls"), F.max("p").alias("p"))


def micro_macro(rows: DataFrame, *by: str) -> DataFrame:
    """micro = hits / judged over all, macro = mean of each row's share."""
    return rows.groupBy(*by).agg((F.sum("hits") / F.greatest(F.sum("judged"), F.lit(1))).alias("micro"), F.avg(F.col("hits") / F.greatest(F.col("judged"), F.lit(1))).alias("macro"))


def vocabulary(rows: DataFrame, canonical: Column, raw: str, unmapped: Column) -> DataFrame:
    """A5: each canonical value with the raw ones that stand for it, and how many rows weren't mapped."""
    return rows.groupBy(canonical.alias("canonical")).agg(F.array_sort(F.collect_set(raw)).alias("raw"), F.count_if(unmapped).alias("unmapped"))


def bucket_coverage(rows: DataFrame, raw: str, folded: str = "folded", other: str = "other") -> DataFrame:
    """One row: raw values, values kept, and the share of rows that were folded."""
    return rows.agg(F.countDistinct(raw).alias("raw"), F.countDistinct(folded).alias("kept"), F.avg((F.col(folded) == other).cast("int")).alias("folded_share"))


def nested_counts(rows: DataFrame, by: str, inner: str) -> DataFrame:
    """Each group's total, and its rows by an inner value as JSON; counted before anything is collected."""
    counts = rows.groupBy(by, inner).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.sum("n").alias("total"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n"))))).alias("counts"))


def _grams(text: Column, size: int) -> Column:
    """A text's distinct runs of `size` characters; none of a shorter one."""
    n = F.char_length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _inside(short: DataFrame, long: DataFrame, size: int) -> DataFrame:
    """(a, b): the distinct texts of short and long where a lies in b."""
    # A text of fewer characters than a gram is looked for by grams of its own size.
    sizes = range(1, size + 1)
    filed = F.array(*[F.struct(F.lit(k).alias("k"), _grams(F.col("b"), k).alias("grams")) for k in sizes])
    held = long.select("b", F.explode(filed).alias("x")).select("b", "x.k", F.explode("x.grams").alias("gram"))
    own = F.least(F.char_length("a"), F.lit(size))
    grams = _grams(F.col("a"), size)
    asked = short.where(own > 0).select("a", own.alias("k"), F.explode(F.when(own < size, F.array("a")).otherwise(grams)).alias("gram"))
    counts = held.groupBy("k", "gram").agg(F.count(F.lit(1)).alias("n"))
    # Its rarest gram stands for a text; one that no long text has rules it out.
    known = asked.join(counts, ["k", "gram"], "left").groupBy("a", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("a", "k", "x.gram")
    return known.join(held, ["k", "gram"]).where(F.contains("b", "a")).select("a", "b")


def substring_pairs(queries: DataFrame, labels: DataFrame, size: int = 3) -> DataFrame:
    """(query, label) of the distinct texts of which one lies in the other.

    A text is filed under its grams of `size` characters; the other side is joined by its rarest gram alone and then
    verified, so no pair is formed that doesn't share a rare gram.  Null and empty texts lie in none."""
    q, b = queries.select("query").where("query IS NOT NULL").distinct(), labels.select("label").where("label IS NOT NULL").distinct()
    one = _inside(q.select(F.col("query").alias("a")), b.select(F.col("label").alias("b")), size).select(F.col("a").alias("query"), F.col("b").alias("label"))
    other = _inside(b.select(F.col("label").alias("a")), q.select(F.col("query").alias("b")), size).select(F.col("b").alias("query"), F.col("a").alias("label"))
    return one.union(other).distinct()


def _best_reading(words: DataFrame, vocabulary: DataFrame, short: float, long: float) -> DataFrame:
    """(id, brand, score) of each id's best fuzzy match of (id, word, conf) with (alias, brand); score: similarity times
    confidence, ties by brand."""
    near = fuzzy_match(words.select("word").distinct(), vocabulary.select("alias").distinct(), 5, short, long)
    found = words.join(near, "word").join(vocabulary, "alias").select("id", "brand", (F.col("ratio") / 100 * F.col("conf")).alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "brand")
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def two_vocabularies(lines: DataFrame, catalog: DataFrame, others: DataFrame, parents: DataFrame, least_conf: float = 0.5, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(id, verdict, brand, score, reason) of read lines (id, text, conf).

    A brand of the catalog (alias, brand) wins over any other, which has to be nearer (95 for aliases of up to five letters,
    88 beyond).  One that belongs, by one or two links of parents (brand, parent), to a brand that the catalog has is no
    evidence; nor is text without a brand, or none that is sure enough."""
    kept = lines.where(F.col("conf") >= least_conf).withColumn("line", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))).where("line <> ''")
    words = kept.select("id", "conf", F.explode(candidates(F.col("line"))).alias("word")).groupBy("id", "word").agg(F.max("conf").alias("conf"))
    words = words.where(~F.col("word").isin(*blocked)) if blocked else words
    mine = _best_reading(words, catalog, 90, 80).select("id", F.col("brand").alias("own"), F.col("score").alias("own_score"))
    other = _best_reading(words.join(mine.select("id"), "id", "left_anti"), others, 95, 88)
    stocked = catalog.select(F.lower("brand").alias("top")).distinct()
    links = parents.select("brand", F.lower("parent").alias("top"))
    links = links.unionByName(links.join(parents.select(F.lower("brand").alias("top"), F.lower("parent").alias("up")), "top").select("brand", F.col("up").alias("top"))).distinct()
    other = other.join(links.join(stocked, "top", "left_semi").select("brand").distinct().withColumn("vetoed", F.lit(True)), "brand", "left")
    all_ids = lines.select("id").distinct().join(kept.select("id").distinct().withColumn("readable", F.lit(True)), "id", "left")
    rows = all_ids.join(mine, "id", "left").join(other, "id", "left")
    own, found = F.col("own").isNotNull(), F.col("brand").isNotNull() & F.col("vetoed").isNull()
    reason = F.when(own, "catalog_brand_read").when(F.col("readable").isNull(), "no_text").when(F.col("brand").isNull(), "text_but_no_brand").when(F.col("vetoed"), "sub_brand_of_stocked_parent").otherwise("known_brand_not_stocked")
    return rows.select("id", F.when(own, "in_catalog").when(found, "off_catalog").otherwise("no_evidence").alias("verdict"), F.when(own, F.col("own")).when(found, F.col("brand")).alias("brand"), F.when(own, F.col("own_score")).when(found, F.col("score")).otherwise(0.0).alias("score"), reason.alias("reason"))
