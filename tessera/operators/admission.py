"""Quotas with near-duplicates left out (S22): rows are admitted in order while their theme has room, and a row that is near
one admitted before takes no room.

Rounds decide all rows whose answer no longer depends on undecided ones: counts of a theme's earlier rows come from counts
cumulated over ranges of the order, nearness from the hashes that lead their bands, so neither a theme nor the copies of a
picture lie in one task and the pairs of a family are never formed.  The first undecided row can always be decided; a row
waits only for rows that are near it or may fill its theme, or that crowd its bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.curation import FRONT, WIDEST, leaders, near_any
from tessera.operators.metrics import cumulated
from tessera.sources.store import forget, saved


def admit(rows: DataFrame, most: int = 6) -> DataFrame:
    """(place, outcome) of (place, theme, cap, key, hash): `kept`, `full` (the theme has its cap), `near` (a kept row before it
    has its key or a hash at most `most` bits away) or `unusable` (no hash).

    place is the order and differs from row to row; null themes are a theme, a null key is like no other, a null cap is none."""
    usable = rows.where(F.col("hash").isNotNull()).select(F.col("place").cast("long").alias("place"), F.coalesce("theme", F.lit("")).alias("theme"), F.coalesce("cap", F.lit(1 << 60)).cast("long").alias("cap"), "key", "hash")
    state = saved(usable.withColumn("outcome", F.lit(None).cast("string")), "admission")
    kept, open_, width = F.col("outcome") == "kept", F.col("outcome").isNull(), FRONT
    while not state.where(open_).isEmpty():
        counts = state.select("theme", "place", kept.cast("long").alias("kept"), open_.cast("long").alias("open")).na.fill(0, ["kept", "open"])
        before = cumulated(counts, "place", ["kept", "open"], ("theme",)).where("open = 1").select("place", "before_kept", "before_open")
        seen = saved(state.where(open_).join(before, "place"), "admission-open")
        rest = seen.where("before_kept < cap")
        hashes = saved(rest.groupBy("hash").agg(F.min("place").alias("id")).select("id", "hash"), "admission-hashes")
        leading, pairs = leaders(hashes, most, width)
        # First of its hash and key, nothing near before it, and room even if all before it were kept.
        fit = rest.where("before_kept + before_open < cap").join(leading.select(F.col("id").alias("place")), "place", "left_semi").join(pairs.select(F.col("b").alias("place")), "place", "left_anti")
        by_key = rest.where("key IS NOT NULL").groupBy("key").agg(F.min("place").alias("first"))
        new = saved(fit.join(by_key, "key", "left").where("key IS NULL OR place = first").select("place", "key", "hash"), "admitted")
        firsts = new.select(F.col("place").alias("id"), "hash")
        ids = firsts.select("id").union(pairs.join(firsts.select(F.col("id").alias("a")), "a").select("b")).union(near_any(hashes.join(leading, "id", "left_anti"), firsts, most))
        near = hashes.join(ids, "id", "left_semi").select("hash", F.lit(True).alias("by_hash"))
        keys = new.where("key IS NOT NULL").select("key", F.lit(True).alias("by_key"))
        told = seen.join(near, "hash", "left").join(keys, "key", "left").join(new.select("place", F.lit(True).alias("new")), "place", "left")
        outcome = F.when(F.col("before_kept") >= F.col("cap"), "full").when(F.col("new"), "kept").when(F.col("by_hash") | F.col("by_key"), "near")
        after = saved(told.select(*state.columns[:-1], outcome.alias("outcome")).unionByName(state.where(~open_)), "admission")
        for table in (state, seen, hashes, leading, pairs, new):
            forget(table)
        state, width = after, min(2 * width, WIDEST)
    # A row known to be near another may have been passed before its theme was known to be full.
    before = cumulated(state.select("theme", "place", F.coalesce(kept, F.lit(False)).cast("long").alias("kept")), "place", ["kept"], ("theme",)).select("place", "before_kept")
    done = state.join(before, "place").select("place", F.when((F.col("outcome") == "near") & (F.col("before_kept") >= F.col("cap")), "full").otherwise(F.col("outcome")).alias("outcome"))
    return done.unionByName(rows.where(F.col("hash").isNull()).select(F.col("place").cast("long").alias("place"), F.lit("unusable").alias("outcome")))
