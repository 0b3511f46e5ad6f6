"""Files of JSON records as a data source of Spark.

`spark.read.format("records").load(path)` reads a file that holds an array of objects, or an object a line, or all `.json`
and `.jsonl` files of a folder; where there is nothing it gives no rows, and so does an empty file.  A row is an object's JSON;
`records` gives it columns.  `write.format("records").mode("append").save(folder)` adds a file of lines for each task: tasks
write beside the folder, and only the commit, which Spark makes once after all tasks have ended, moves the files in; a job
that fails leaves nothing that is read (a task that was still writing when the others were given up may leave a hidden folder).
Files are reached through pyarrow's filesystems."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "value string"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Message(WriterCommitMessage):
    def __init__(self, name: str | None, n_rows: int) -> None:
        self.name, self.n_rows = name, n_rows


class _Reader(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        store, path = filesystem(self.uri)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_File(path)]
        if info.type == fs.FileType.NotFound:
            return [_File("")]
        found = store.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.endswith((".json", ".jsonl")) and f.base_name[0] not in "._"] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        if not partition.path:
            return
        store, _ = filesystem(self.uri)
        with store.open_input_file(partition.path) as stream:
            start = stream.read(4096).lstrip()
            stream.seek(0)
            if start[:1] == b"[":  # an array is one value, so it is read as a whole
                for record in json.loads(stream.read()):
                    yield (json.dumps(record, ensure_ascii=False),)
                return
            rest = b""
            while piece := stream.read(1 << 20):
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    if line.strip():
                        yield (line.decode(),)
            if rest.strip():
                yield (rest.decode(),)


class _Writer(DataSourceWriter):
    def __init__(self, uri: str) -> None:
        self.uri, self.job = uri.rstrip("/"), uuid.uuid4().hex

    def _beside(self, path: str) -> str:
        return f"{path}/.writing-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, path = filesystem(self.uri)
        name, n, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for row in rows:
                if out is None:
                    store.create_dir(self._beside(path), recursive=True)
                    out = store.open_output_stream(f"{self._beside(path)}/{name}", compression=None)
                out.write(row[0].encode() + b"\n")
                n += 1
        finally:
            if out is not None:
                out.close()
        return _Message(name if n else None, n)

    def commit(self, messages: list) -> None:
        store, path = filesystem(self.uri)
        store.create_dir(path, recursive=True)
        for message in messages:
            if message is not None and message.name:
                store.move(f"{self._beside(path)}/{message.name}", f"{path}/{message.name}")
        self._clear(store, path)

    def abort(self, messages: list) -> None:
        self._clear(*filesystem(self.uri))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(self._beside(path)).type == fs.FileType.Directory:
            store.delete_dir(self._beside(path))


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("records are only appended")
        return _Writer(self.options["path"])


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a file or folder with the columns of a schema; no rows where there is nothing."""
    spark.dataSource.register(Records)
    return spark.read.format("records").load(path).select(F.from_json("value", schema).alias("x")).select("x.*")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys aren't in the folder yet, of repeated ones one; how many there are afterwards."""
    spark = rows.sparkSession
    spark.dataSource.register(Records)
    have = records(spark, path, rows.select(*keys).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    new = rows.dropDuplicates(keys).alias("n").join(have.alias("o"), same, "left_anti")
    new.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.format("records").mode("append").save(path)
    return spark.read.format("records").load(path).count()
