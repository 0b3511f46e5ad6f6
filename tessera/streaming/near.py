"""Near-duplicates at ingest (N2): a stream of hashes against all that were kept before, first come first kept.

What is kept is filed under its bands, a folder a batch; a batch reads the folders before its own, decides its rows and
writes theirs.  A batch that is run again after a failure finds the same folders before it and writes the same ones again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.curation import banded, first_wins, word

DECISIONS = "id long, hash string, kept boolean"


def _before(spark: SparkSession, root: str, kind: str, number: int) -> DataFrame | None:
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = as_path(f"{root}/{kind}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in (files.listStatus(folder) if files.exists(folder) else ()) if int(s.getPath().getName().partition("=")[2]) < number and files.exists(as_path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(*[n.toString() for n in names]) if names else None


def decide(batch: DataFrame, kept: DataFrame | None, most: int = 6) -> DataFrame:
    """(id, hash, kept) of a batch's rows: a row goes if it is near one that was kept before, or an earlier kept one of the
    batch.  kept: (band, id, hash) of those before."""
    if kept is not None:
        new = banded(batch.groupBy("hash").agg(F.min("id").alias("id")), most)
        there = kept.select(F.col("band").alias("there"), word("hash").alias("other"))
        near = new.join(there, (F.col("band") == F.col("there")) & (F.bit_count(word("hash").bitwiseXOR(F.col("other"))) <= most), "left_semi")
        seen = near.select("hash").distinct().withColumn("seen", F.lit(True))
        batch = batch.join(seen, "hash", "left")
    else:
        batch = batch.withColumn("seen", F.lit(None).cast("boolean"))
    fresh = first_wins(batch.where("seen IS NULL").select("id", "hash"), most)
    return batch.select("id", "hash").join(fresh, "id", "left").select("id", "hash", F.coalesce("kept", F.lit(False)).alias("kept"))


def dedup_stream(stream: DataFrame, root: str, checkpoint: str, most: int = 6) -> StreamingQuery:
    """Decides the rows (id, hash) of each micro-batch, in the order of id; all data that is there is taken and the query
    ends.  A row whose hash is null is kept and near nothing; one whose id is null, or was decided in an earlier batch, is
    passed over."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("id IS NOT NULL").groupBy("id").agg(F.min("hash").alias("hash"))
        done = _before(spark, root, "decided", number)
        rows = (rows if done is None else rows.join(done.select("id"), "id", "left_anti")).persist()
        try:
            decided = decide(rows.where("hash IS NOT NULL"), _before(spark, root, "bands", number), most).unionByName(rows.where("hash IS NULL").withColumn("kept", F.lit(True)))
            decided.write.mode("overwrite").parquet(f"{root}/decided/batch={number:09d}")
            mine = spark.read.schema(DECISIONS).parquet(f"{root}/decided/batch={number:09d}").where("kept AND hash IS NOT NULL")
            banded(mine.select("id", "hash"), most).select("band", "id", "hash").write.mode("overwrite").parquet(f"{root}/bands/batch={number:09d}")
        finally:
            rows.unpersist()

    return stream.select("id", "hash").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """(id, hash, kept) of all batches so far."""
    found = _before(spark, root, "decided", 1 << 31)
    return spark.createDataFrame([], DECISIONS) if found is None else found.select("id", "hash", "kept")
