"""Keyed tables kept up to date from a stream of files (U1, U6, U7 as micro-batches; T1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Writes the last row of each key of every micro-batch beside a Parquet table; all data that is there is taken and
    the query ends.

    A batch costs what its own rows cost: it becomes a folder named by its number, and `current` lets later batches win.
    A batch that is run again after a failure writes the same folder again, so nothing is counted twice."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, target: str):
    """The file system, and (number, folder) of the complete base tables and batches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[tuple[int, str]]] = {"base": [], "batch": []}
    for status in files.listStatus(root) if files.exists(root) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append((int(number), status.getPath().toString()))
    return files, found


def current(spark: SparkSession, target: str, keys: list[str]) -> DataFrame | None:
    """The newest row of each key: the newest base table and the batches since; None where there is neither."""
    _, found = _complete(spark, target)
    base = max(found["base"], default=(-1, None))
    parts = [x for x in [base, *sorted(found["batch"])] if x[1] and (x == base or x[0] > base[0])]
    if len(parts) == 1:
        return spark.read.parquet(parts[0][1])
    rows = None
    for number, path in parts:
        part = spark.read.parquet(path).withColumn("_batch", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    return rows if rows is None else latest(rows, keys, ["_batch"]).drop("_batch")


def compact(spark: SparkSession, target: str, keys: list[str]) -> None:
    """Writes the current rows as a new base table, and only then removes what it stands for."""
    files, found = _complete(spark, target)
    last = max((n for kind in found.values() for n, _ in kind), default=None)
    if last is None or not found["batch"]:
        return
    current(spark, target, keys).write.mode("overwrite").parquet(f"{target}/base={last:09d}")
    for kind, folders in found.items():
        for number, path in folders:
            if kind == "batch" or number < last:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows, for batches and streams alike; ts of any timestamp type."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
