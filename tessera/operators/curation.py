"""Splits, balancing, near-duplicates and keyed merges."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import forget, saved


def unit_hash(c: Column) -> Column:
    """A number from 0 to 1 from the text's SHA-1, the same in every engine."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("long") / F.lit(0xFFFFFFFF)


def seeded(c: Column, seed: int) -> Column:
    """An order that a seed fixes: SHA-1 of seed and key."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def view_split(rows: DataFrame, product: str, key: str, seed: int, held_out: int = 1) -> DataFrame:
    """Of each product min(held_out, n - 1) rows are test rows, in seeded order; single rows are gallery."""
    w = Window.partitionBy(product)
    k = F.row_number().over(w.orderBy(seeded(F.col(key), seed), key))
    n = F.count(F.lit(1)).over(w)
    return rows.withColumn("split", F.when(k <= F.least(F.lit(held_out), n - 1), "test").otherwise("train"))


def share_split(rows: DataFrame, product: str, key: str, seed: int, share: float = 0.2) -> DataFrame:
    """Of each product's n rows max(1, round(n * share)) are test rows, halves rounded to even, but one at least stays."""
    w = Window.partitionBy(product)
    n = F.count(F.lit(1)).over(w)
    most = F.least(F.greatest(F.lit(1), F.bround(n * share, 0).cast("long")), n - 1)
    return rows.withColumn("split", F.when(F.row_number().over(w.orderBy(seeded(F.col(key), seed), key)) <= most, "test").otherwise("train"))


def fraction_split(rows: DataFrame, key: str, seed: int, fractions: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Keys dealt by seeded hash, so a key's rows stay together and no order of all keys is formed."""
    u, edge, out = unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 0.0, F.lit(names[-1])
    cuts = []
    for f, name in zip(fractions[:-1], names[:-1]):
        edge += f
        cuts.append((edge, name))
    for cut, name in reversed(cuts):
        out = F.when(u < cut, name).otherwise(out)
    return rows.withColumn("split", out)


def round_robin(rows: DataFrame, stratum: str, photo: str, key: str, seed: int, per_photo: int, n: int) -> DataFrame:
    """At most per_photo rows of a photo, then strata in turn until n."""
    order = seeded(F.col(key), seed)
    some = rows.withColumn("_k", F.row_number().over(Window.partitionBy(photo).orderBy(order, key))).where(F.col("_k") <= per_photo)
    turn = some.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    return turn.orderBy("_k", stratum).limit(n).drop("_k")


def balance(rows: DataFrame, label: str, key: str, seed: int, least: int, cap: int) -> DataFrame:
    """Rare labels go, training rows are capped per label, weights are root inverse frequencies, ids are dense."""
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    counts = rows.groupBy(label).agg(F.count_if(train).alias("_n")).where(F.col("_n") >= least).select(label)
    counted = rows.join(counts, label)
    # The cap alone is asked of the window, so that each task sends `cap` rows of a label at most; other splits need none.
    capped = counted.where(train).withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(seeded(F.col(key), seed), key))).where(F.col("_k") <= cap).drop("_k")
    some = capped.unionByName(counted.where(~train))
    sizes = some.where(train).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # Labels are few: their totals and ids are formed on one row each.
    ids = sizes.withColumns({"weight": F.round(F.sqrt(F.sum("_n").over(Window.partitionBy()) / F.col("_n")), 4), "text_id": F.dense_rank().over(Window.orderBy(label)) - 1}).drop("_n")
    return some.join(ids, label)


def fixed_gallery(products: DataFrame, queries: DataFrame, size: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A seeded sample of `size` products (code, identity), its identities with what is left of their products, and the
    queries (query_id, code) that it can answer; everything, if there are fewer products."""
    kept = products.orderBy(seeded(F.col("code"), seed), "code").limit(size)
    return kept, kept.groupBy("identity").agg(F.count(F.lit(1)).alias("n")), queries.join(kept.select("code"), "code", "left_semi")


def weighted_sample(rows: DataFrame, by: str, key: str, weight: Column, seed: int, k: int) -> DataFrame:
    """K rows of each group without replacement, likelier with weight (exponential race over hashed numbers)."""
    u = F.greatest(unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.lit(1e-12))
    w = Window.partitionBy(by).orderBy(-F.log(u) / weight, key)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


# Near-duplicates


#: How many rows of a band meet one another in the first round and at most; each round takes twice as many as the last.
FRONT, WIDEST = 16, 1024
#: Kept rows up to which their bands are broadcast.
FEW = 2_000


def word(c: Column | str) -> Column:
    """A 16-digit hexadecimal hash as a number of 64 bits."""
    return F.conv(c, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """differing bits of two 16-digit hexadecimal hashes."""
    return F.bit_count(word(a).bitwiseXOR(word(b)))


def banded(rows: DataFrame, most: int = 6, agree: int = 3) -> DataFrame:
    """(id, hash, band) of (id, hash) rows, a row for each band of each hash.  64 bits are cut into most + `agree` pieces; two
    hashes at most `most` bits apart agree on `agree` of them at least, so with a band for each choice of so many pieces
    they share one.  A band has 64 * agree / (most + agree) bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring("hash", i, 8), 16, 2), 32, "0") for i in (1, 9)])
    n = most + agree
    cuts = [round(64 * i / n) for i in range(n + 1)]
    cut = F.array(*[F.substring(bits, a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    choices = F.array(*[F.array(*map(F.lit, some)) for some in combinations(range(n), agree)])
    bands = F.transform(choices, lambda some: F.xxhash64(some, F.transform(some, lambda i: F.get("cut", i))))
    return rows.withColumn("cut", cut).withColumn("band", F.explode(bands)).drop("cut")


def near_pairs(rows: DataFrame, most: int = 6, agree: int = 3) -> DataFrame:
    """(a, b) pairs, a < b, of (id, hash) rows at most `most` bits apart, by an equi-join on their bands, which loses
    nothing.  Equal hashes are one row."""
    keyed = banded(rows.groupBy("hash").agg(F.min("id").alias("id")), most, agree)
    left, right = keyed.select("band", F.col("id").alias("a"), F.col("hash").alias("ha")), keyed.select("band", F.col("id").alias("b"), F.col("hash").alias("hb"))
    return left.join(right, "band").where((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= most)).select("a", "b").distinct()


def leaders(rows: DataFrame, most: int, width: int, agree: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of (id, hash) rows, whose hashes differ, the saved (id) of those that are among the first `width` of each of their
    bands, and the saved pairs (a, b), a < b, of near rows among the first `width` of a band.  What is near a row of the
    former and before it is in these pairs, so a band of any size costs width^2."""
    first = F.row_number().over(Window.partitionBy("band").orderBy("id"))
    front = banded(rows, most, agree).select("band", "id", word("hash").alias("word")).withColumn("_k", first).where(F.col("_k") <= width)
    side = lambda c: front.select("band", F.col("id").alias(c), F.col("word").alias(f"w{c}"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= most)
    pairs = saved(side("a").join(side("b").hint("merge"), "band").where(near).select("a", "b").distinct(), "leading-pairs")
    whole = front.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == comb(most + agree, agree))
    return saved(whole.select("id"), "leaders"), pairs


def near_any(rows: DataFrame, kept: DataFrame, most: int, agree: int = 3) -> DataFrame:
    """(id) of the (id, hash) rows that are near one of the kept (id, hash) rows."""
    there = banded(kept, most, agree).select("band", word("hash").alias("other"))
    there = F.broadcast(there) if kept.limit(FEW + 1).count() <= FEW else there.hint("merge")
    mine = banded(rows, most, agree).select(F.col("band").alias("mine"), "id", word("hash").alias("word"))
    return mine.join(there, (F.col("mine") == F.col("band")) & (F.bit_count(F.col("word").bitwiseXOR(F.col("other"))) <= most), "left_semi").select("id").distinct()


def first_wins(rows: DataFrame, most: int = 6) -> DataFrame:
    """(id, kept): a row goes if an earlier *kept* row is near.  Equal hashes go with their first.

    A round keeps the rows that lead all their bands with nothing near before them, and passes over what is near these; so
    a family of near rows costs what its kept rows cost, and its pairs are never formed.  A chain of k needs k rounds at most."""
    left, width, kept = saved(rows.groupBy("hash").agg(F.min("id").alias("id")).select("id", "hash"), "left"), FRONT, None
    while not left.isEmpty():
        leading, pairs = leaders(left, most, width)
        new = saved(left.join(leading, "id", "left_semi").join(pairs.select(F.col("b").alias("id")), "id", "left_anti"), "kept")
        near = pairs.join(new.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).union(near_any(left.join(leading, "id", "left_anti"), new, most))
        rest = saved(left.join(new.select("id").union(near), "id", "left_anti"), "left")
        for table in (left, leading, pairs):
            forget(table)
        left, width, kept = rest, min(2 * width, WIDEST), new if kept is None else kept.union(new)
    if kept is None:
        return rows.select("id", F.lit(False).alias("kept"))
    return rows.select("id").join(kept.select("id", F.lit(True).alias("kept")), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


# Keyed merges


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source replace those of their key, others are added."""
    return target.join(source, keys, "left_anti").unionByName(source, allowMissingColumns=True)


def update_columns(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only the named columns, only of keys that are there, only where the source has a value."""
    new = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return target.join(new, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def merge_counts(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """U4: how many keys are updated, unchanged or missing in the target."""
    a, b = target.select(*keys, F.struct(*columns).alias("_a")), source.select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, keys, "right")
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return both.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def needs_work(meta: Column, params: Column, force: bool = False) -> Column:
    """No result yet, or one of other parameters (as a whole); an empty result is a result."""
    return F.lit(force) | ~meta.eqNullSafe(params)


def reuse(current: DataFrame, index: DataFrame, key: str, signature: str, core_equal: bool) -> DataFrame:
    """Each current row with what happens to it: reused where signature and core settings are the same, else
    embedded; rows that are gone don't appear."""
    old = index.select(key, F.col(signature).alias("_s"))
    return current.join(old, key, "left").withColumn("action", F.when(F.lit(core_equal) & F.col(signature).eqNullSafe(F.col("_s")), "reuse").otherwise("embed")).drop("_s")


def training_batches(rows: DataFrame, product: str, key: str, n_batches: int, per_product: int, seed: int) -> DataFrame:
    """Rows for contrastive batches: products are dealt to batches by seeded hash, each with per_product of
    its rows in seeded order (fewer if it has fewer); no order over all products is formed."""
    batch = F.floor(unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col(product).cast("string"))) * n_batches).cast("long")
    w = Window.partitionBy(product).orderBy(seeded(F.col(key), seed), key)
    return rows.withColumns({"batch": F.least(batch, F.lit(n_batches - 1).cast("long")), "k": F.row_number().over(w)}).where(F.col("k") <= per_product)


def last_write_wins(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each key's value of the last write."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def cache_check(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """One row: keys, vectors of the right size, and whether the cache can be used (as many of the one as the other)."""
    return rows.agg(F.count(key).alias("keys"), F.count_if(F.size(vector) == size).alias("vectors")).withColumn("usable", F.col("keys") == F.col("vectors"))


# Orders and sets


def top(rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """O1: the k rows of highest value, ties by key; each task sends k rows."""
    return rows.orderBy(F.desc(by), key).limit(k)


def most_common(rows: DataFrame, columns: list[str], place: Column, k: int) -> DataFrame:
    """O2: the k most frequent values; of equals the one seen first."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "first", *columns).limit(k)


def union_views(*views: DataFrame) -> DataFrame:
    """Rows of all views; columns that a view lacks are null."""
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view, allowMissingColumns=True)
    return out


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of both."""
    return left.intersect(right)


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows that the left side holds oftener than the right."""
    return left.exceptAll(right).distinct()


def ordered_distinct(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Each group's values in the order of their first places; groups are small (a post's items)."""
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_x"))
    return lists.select(by, F.array_distinct(F.transform("_x", lambda x: x[value])).alias("values"))
