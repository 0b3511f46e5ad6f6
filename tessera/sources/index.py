"""An index of embeddings that is brought up to date piece by piece.

The index is a folder of immutable parts, each the vectors that one update had to compute, and of numbered manifests that
say which key lives in which part under which signature.  An update embeds only rows whose signature (what their vector was
made of) isn't in the newest manifest; it writes those as a new part and then a new manifest, whose completion is the swap.
Vectors that are still right are never read or written, vanished ones are left out of the manifest, and other settings mean
that nothing is reused.  A failed update leaves a part that no manifest names; readers see the manifest before it.

Rows with a null key are left out; of rows with one key the one of the greatest signature counts; a null signature is a
signature; rows that can't be encoded are in no manifest and are tried again the next time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import embed_rows
from tessera.sources.store import single_writer


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of the complete manifests, the oldest first."""
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = as_path(f"{root}/manifests")
    files, found = folder.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for status in files.listStatus(folder) if files.exists(folder) else ():
        if files.exists(as_path(status.getPath(), "_SUCCESS")):
            found.append((int(status.getPath().getName().partition("=")[2]), status.getPath().toString()))
    return sorted(found)


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """(key, signature, part, settings) of the newest version; None where there is none."""
    found = _versions(spark, root)
    return spark.read.parquet(found[-1][1]) if found else None


def update(current: DataFrame, root: str, key: str, signature: str, value: str, settings: dict, encode: Callable[[list], list]) -> DataFrame:
    """Brings the index at root to the rows of current; one row of counts: reused, embedded, unreadable, dropped."""
    spark, said = current.sparkSession, json.dumps(settings, sort_keys=True)
    rows = current.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(signature).alias("signature"), F.col(value).alias("value"))
    rows = rows.groupBy("key").agg(F.max(F.struct(F.col("signature").isNotNull().alias("known"), "signature", "value")).alias("x")).select("key", "x.signature", "x.value")
    with single_writer(spark, f"{root}/index"):
        found = _versions(spark, root)
        number, path = found[-1] if found else (-1, None)
        old = None if path is None else spark.read.parquet(path)
        usable = None if old is None else old.where(F.col("settings") == said)
        live = None
        if usable is not None:
            same = (F.col("n.key") == F.col("o.key")) & F.col("n.signature").eqNullSafe(F.col("o.signature"))
            live = usable.alias("o").join(rows.select("key", "signature").alias("n"), same, "left_semi")
            work = rows.alias("n").join(usable.select("key", "signature").alias("o"), same, "left_anti")
        else:
            work = rows
        part = uuid.uuid4().hex
        vectors = embed_rows(work, "key", "value", encode)
        vectors.join(work.select("key", "signature"), "key").select("key", "signature", "embedding").write.parquet(f"{root}/parts/part={part}")
        new = spark.read.parquet(f"{root}/parts/part={part}").select("key", "signature", F.lit(part).alias("part"), F.lit(said).alias("settings"))
        whole = new if live is None else live.select("key", "signature", "part", "settings").unionByName(new)
        target = f"{root}/manifests/version={number + 1:09d}"
        whole.write.mode("overwrite").parquet(target)  # an incomplete one of a failed update may be there
        now = spark.read.parquet(target)
        sizes = now.agg(F.count_if(F.col("part") != part).alias("reused"), F.count_if(F.col("part") == part).alias("embedded")).first()
        dropped = 0 if old is None else old.join(rows.select("key"), "key", "left_anti").count()
        return spark.createDataFrame([(sizes.reused, sizes.embedded, rows.count() - sizes.reused - sizes.embedded, dropped)], "reused long, embedded long, unreadable long, dropped long")


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """(key, signature, embedding, part) of the index; only parts that hold a live row are read."""
    live = manifest(spark, root)
    if live is None:
        raise FileNotFoundError(f"no index at {root}")
    names = [r.part for r in live.select("part").distinct().collect()]
    if not names:
        return live.select("key", "signature", F.lit(None).cast("array<float>").alias("embedding"), "part")
    stored = spark.read.option("basePath", f"{root}/parts").parquet(*[f"{root}/parts/part={n}" for n in names])
    return stored.withColumn("part", F.col("part").cast("string")).join(live.select("key", "part"), ["key", "part"]).select("key", "signature", "embedding", "part")


def vacuum(spark: SparkSession, root: str) -> None:
    """Removes manifests before the newest and parts that it doesn't name."""
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    with single_writer(spark, f"{root}/index") as files:
        found = _versions(spark, root)
        if not found:
            return
        named = {r.part for r in manifest(spark, root).select("part").distinct().collect()}
        for status in files.listStatus(as_path(f"{root}/manifests")):
            if status.getPath().toString() != found[-1][1]:
                files.delete(status.getPath(), True)
        for status in files.listStatus(as_path(f"{root}/parts")):
            if status.getPath().getName().partition("=")[2] not in named:
                files.delete(status.getPath(), True)
