"""Streams end at the same table as a batch merge."""

from pyspark.sql import functions as F

from tessera.sources.tables import table
from tessera.streaming.incremental import compact, current, latest, upsert_stream, windowed_counts


def test_upserts_from_files(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # The order of files decides between versions, so the key's own order column is what counts here.
    keys = ["user_id", "event_type", "event_id"]
    for _ in range(2):  # a second run finds nothing new
        upsert_stream(stream, f"{tmp_path}/out", keys, ["event_id"], f"{tmp_path}/checkpoint").awaitTermination()
    want = {tuple(r) for r in latest(events, keys, ["event_id"]).select("event_id", "value").collect()}
    for _ in range(2):  # as batches, then as one table
        assert {tuple(r) for r in current(spark, f"{tmp_path}/out", keys).select("event_id", "value").collect()} == want
        compact(spark, f"{tmp_path}/out", keys)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["base=000000002"]
    assert current(spark, f"{tmp_path}/none", keys) is None


def test_later_batches_win(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
    run = lambda: upsert_stream(stream, f"{tmp_path}/out", ["k"], ["v"], f"{tmp_path}/checkpoint").awaitTermination()
    rows((1, "z"), (1, "y"), (2, "a"))
    run()
    compact(spark, f"{tmp_path}/out", ["k"])
    rows((1, "b"), (3, "c"))
    run()
    got = lambda: {tuple(r) for r in current(spark, f"{tmp_path}/out", ["k"]).collect()}
    assert got() == {(1, "b"), (2, "a"), (3, "c")}
    compact(spark, f"{tmp_path}/out", ["k"])
    assert got() == {(1, "b"), (2, "a"), (3, "c")}


def test_windows_stream_and_batch_agree(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {(r.window.start, r.event_type, r.n) for r in windowed_counts(events).collect()}
    assert {(r.window.start, r.event_type, r.n) for r in spark.sql("SELECT * FROM counts").collect()} == want
