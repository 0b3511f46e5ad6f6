"""Tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Where saved tables lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one that was set on the context; a local session without any gets one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later jobs start from the files, also after an
    executor is lost; options are the writer's.  The files stay until `clear` or the owner of the shared folder removes them."""
    path = f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(table: DataFrame) -> None:
    """Removes a saved table that nothing reads any more: one of the rounds before, say."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int):
    """Jobs that run inside get Arrow batches of so many bytes, or of one row; the session's own size holds again after."""
    before = spark.conf.get(_SIZE)
    spark.conf.set(_SIZE, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(_SIZE, before)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has saved; results that are still to be computed from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def single_writer(spark: SparkSession, path: str):
    """Holds `path`.lock, which only one writer can create; another one gets a FileExistsError."""
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.createNewFile(lock):
        raise FileExistsError(f"{path} is being written")
    try:
        yield fs
    finally:
        fs.delete(lock, False)


def replace(df: DataFrame, path: str) -> None:
    """Writes df beside the table at `path` and then puts it in its place, so that readers see the old table or the
    new one; one writer at a time."""
    spark = df.sparkSession
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    with single_writer(spark, path) as fs:
        new, old = as_path(f"{path}.new-{uuid.uuid4().hex}"), as_path(f"{path}.old-{uuid.uuid4().hex}")
        df.write.parquet(new.toString())
        there = fs.exists(as_path(path))
        if there and not fs.rename(as_path(path), old) or not fs.rename(new, as_path(path)):
            raise OSError(f"{path} can't be replaced")
        if there:
            fs.delete(old, True)
