"""WARC archives with Zstandard (operator 13): `.warc.zst` files with a dictionary, written and read record by record.

An archive starts with a skippable frame that holds its dictionary, itself compressed; a frame for each record follows, the
first of them a `warcinfo`.  Every archive learns its dictionary from its own first records (`SAMPLE_BYTES` of them), so
nothing passes through the driver; one with too little to learn from has none.

`write` deals records to tasks, each of which writes archives of about `ARCHIVE_BYTES` into the shared folder under names
of its own.  A task that is lost or repeated leaves files that no manifest names: the manifest is a table that Spark
commits, and `read` takes the archives from there.  `read` streams an archive frame by frame, and holds one record at a
time; it checks the frames, the headers, both digests, the lengths of record and HTTP message and, against the manifest,
the number of records.  What is wrong gives a row with `error`; a wrong record is passed over, a broken frame ends its
archive, since nothing tells where the next one starts.  Files are reached through pyarrow's filesystems (file, hdfs, s3, gs, abfs).

`deduplicated` decides which records are revisits: of equal payloads (by SHA-256) the record with the largest key is the
response.  Keys are compared as narrow rows that combine before they are shuffled; pages are joined with the keys of
repeated payloads only, which is a plain table, so a payload that a third of all pages share can be split.

Defined results: a null text is an empty payload, and empty payloads are equal like others; a null key is the smallest
and comes back as null; equal keys are told apart by `tie` (a column that differs from row to row), so that one of them is
the response, and without it all rows of that key are; a null address is left out; characters that would end a header are
percent-encoded; an empty table gives no archive and no rows; other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import kept, shared_folder

#: Bytes of compressed records after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive's first records that its dictionary is learned from, and the size and segments of that.
SAMPLE_BYTES, DICTIONARY_BYTES, SEGMENT, MER = 1 << 20, 32 << 10, 256, 8
LEVEL, CHUNK = 3, 1 << 20

# Fixed values of the formats: magic numbers of frames and dictionaries, the profile of revisits.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_BREAKS = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"application/http"
READ = "archive string, offset long, warc_type string, record_id string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
_READ = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for c, kind in (x.split() for x in READ.split(", "))])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(key: object) -> str:
    return f"<urn:page:{'' if key is None else quote(str(key), safe='')}>"


def record(kind: str, urn: str, date: str, block: bytes, content_type: str, **fields: str | None) -> bytes:
    """A record's bytes; fields by name with `_` for `-`, those without value are left out."""
    named = {"WARC-Type": kind, "WARC-Record-ID": urn, "WARC-Date": date} | {k.replace("_", "-"): v for k, v in fields.items()}
    named |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(key: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit: the HTTP head alone, which tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    address = None if url is None else _BREAKS.sub(lambda m: quote(m[0]), url)
    return record(
        "revisit" if revisit else "response", page_urn(key), date, head if revisit else head + payload, "application/http;msgtype=response",
        WARC_Target_URI=address, WARC_Payload_Digest=f"sha1:{digest(payload)}", WARC_Profile=PROFILE if revisit else None, WARC_Refers_To=page_urn(refers_to) if revisit else None,
    )


class Archive:
    """Writes records to a binary stream: the dictionary's frame once enough records are there to learn from, then a frame for
    each record."""

    def __init__(self, out, date: str) -> None:
        self.out, self.waiting, self.waiting_bytes = out, [], 0
        self.compressor: zstandard.ZstdCompressor | None = None
        self.records = self.size = 0
        self.add(record("warcinfo", f"<{uuid.uuid4().urn}>", date, b"format: WARC File Format 1.1\r\n", "application/warc-fields"))

    def add(self, whole: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self._put(self.compressor.compress(whole))
            return
        self.waiting.append(whole)
        self.waiting_bytes += len(whole)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def _begin(self) -> None:
        try:
            learned = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting, k=SEGMENT, d=MER)
        except zstandard.ZstdError:  # too few or too short records
            learned = None
        if learned is not None:
            held = zstandard.ZstdCompressor(level=LEVEL).compress(learned.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True)
        for whole in self.waiting:
            self._put(self.compressor.compress(whole))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()


class Broken(ValueError):
    """A frame that can't be decoded; what follows it can't be found."""


class _Source:
    """Bytes of a stream with a look ahead."""

    def __init__(self, read: Callable[[int], bytes]) -> None:
        self.read, self.held, self.at = read, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.read(CHUNK)):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        if len(self.peek(n)) < n:
            raise Broken(f"a frame of {n} bytes is cut short")
        out, self.held = self.held[:n], self.held[n:]
        self.at += n
        return out

    def frame(self, decompressor: zstandard.ZstdDecompressor) -> bytes:
        """One decoded frame."""
        decoder, parts = decompressor.decompressobj(), []
        try:
            while not decoder.eof:
                piece = self.held or self.read(CHUNK)
                if not piece:
                    raise Broken("a frame is cut short")
                parts.append(decoder.decompress(piece))
                self.held = decoder.unused_data
                self.at += len(piece) - len(self.held)
        except zstandard.ZstdError as e:
            raise Broken(str(e)) from e
        return b"".join(parts)


def frames(read: Callable[[int], bytes]) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded frame) of an archive whose bytes `read` gives."""
    source, dictionary = _Source(read), None
    decompressor = zstandard.ZstdDecompressor()
    while head := source.peek(4):
        kind = int.from_bytes(head, "little")
        if kind in SKIPPABLE:
            first = source.at == 0
            _, size = struct.unpack("<II", source.take(8))
            held = source.take(size)
            if first and kind == DICTIONARY_FRAME:
                if held[:4] == FRAME.to_bytes(4, "little"):
                    held = _Source(_once(held)).frame(decompressor)
                if held[:4] != DICTIONARY.to_bytes(4, "little"):
                    raise Broken("the leading frame holds no dictionary")
                dictionary = zstandard.ZstdCompressionDict(held)
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        elif kind == FRAME:
            at = source.at
            yield at, source.frame(decompressor)
        else:
            raise Broken(f"no frame starts with {head.hex()}")


def _once(held: bytes) -> Callable[[int], bytes]:
    parts = iter([held])
    return lambda n: next(parts, b"")


class Record(NamedTuple):
    warc_type: str
    record_id: str
    target_uri: str | None
    date: str
    payload_bytes: int
    payload_digest: str
    refers_to: str | None
    payload: bytes | None


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the named fields in lower case; lines that start with a blank go on."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return lines[0], found


def _length(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"not a length: {text[:80]!r}")
    return int(text)


def _same(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != digest(data):
        raise ValueError(f"the {what}'s digest isn't {stated}")


def parse(whole: bytes) -> Record:
    """The record of a frame; ValueError if its headers, lengths or digests are wrong."""
    head, ends, rest = whole.partition(b"\r\n\r\n")
    version, named = _fields(head)
    if not ends or not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"not a record: {version[:80]!r}")
    if missing := [k for k in _REQUIRED if not named.get(k)]:
        raise ValueError(f"without {', '.join(missing)}")
    size = _length(named["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {size} bytes is said, {len(rest) - 4} are there")
    block, kind, stated = rest[:size], named["warc-type"], named.get("warc-payload-digest")
    _same(named.get("warc-block-digest"), block, "block")
    payload, n_bytes = block, size
    if named.get("content-type", "").encode().startswith(_HTTP):
        http, ends, payload = block.partition(b"\r\n\r\n")
        if not ends:
            raise ValueError("an HTTP head without end")
        said = _fields(http)[1].get("content-length")
        n_bytes = _length(said) if said else len(payload)
        if kind != "revisit" and n_bytes != len(payload):
            raise ValueError(f"a payload of {n_bytes} bytes is said, {len(payload)} are there")
    if kind == "revisit":
        if not stated or not named.get("warc-refers-to"):
            raise ValueError("a revisit that doesn't name its payload")
        return Record(kind, named["warc-record-id"], named.get("warc-target-uri"), named["warc-date"], n_bytes, stated.partition(":")[2], named["warc-refers-to"], None)
    _same(stated, payload, "payload")
    return Record(kind, named["warc-record-id"], named.get("warc-target-uri"), named["warc-date"], n_bytes, digest(payload), None, payload)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def deduplicated(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", tie: Column | None = None) -> DataFrame:
    """(key, url, payload, revisit, refers_to) of each page."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"), F.struct(F.col(key).alias("key"), (F.lit(0) if tie is None else tie).alias("tie")).alias("row")).withColumn("name", F.sha2("payload", 256))
    best = named.groupBy("name").agg(F.max("row").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "best")
    rows = named.join(kept(best, "repeated-payloads"), "name", "left")
    revisit = F.col("best").isNotNull() & ~F.col("row").eqNullSafe(F.col("best"))
    return rows.select("key", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("best.key")).alias("refers_to"))


def write(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (key, url, payload, revisit, refers_to) as archives into a folder; gives their manifest (path, n_records,
    n_bytes), which is a table already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        archive, name = None, ""
        for batch in batches:
            for row in range(batch.num_rows):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(store.open_output_stream(f"{root}/{name}", compression=None), date)
                archive.add(page_record(*(batch.column(c)[row].as_py() for c in ("key", "url", "payload", "refers_to", "revisit")), date))
                if archive.size >= archive_bytes:
                    yield _closed(archive, name)
                    archive = None
        if archive is not None:
            yield _closed(archive, name)

    def _closed(archive: Archive, name: str) -> pa.RecordBatch:
        archive.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([archive.records]), pa.array([archive.size])], ["path", "n_records", "n_bytes"])

    rows = records.select("key", "url", "payload", "refers_to", "revisit")
    return kept(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def archives_in(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the archives that a pattern names, as Spark lists them; nothing is read."""
    return spark.read.format("binaryFile").load(pattern).select("path")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path and, if there, n_records): see READ.  Without `payloads` they are checked all the same, but
    not given."""
    n_known = "n_records" in archives.columns

    def rows(path: str, expected: int | None) -> Iterator[dict]:
        n, nothing = 0, dict.fromkeys(_READ.names) | {"archive": path}
        try:
            store, where = filesystem(path)
            with store.open_input_stream(where, compression=None) as stream:
                for at, whole in frames(stream.read):
                    n += 1
                    try:
                        found = parse(whole)._asdict()
                        yield nothing | found | {"offset": at, "payload": found["payload"] if payloads else None}
                    except ValueError as e:
                        yield nothing | {"offset": at, "error": str(e)}
            if expected is not None and n != expected:
                yield nothing | {"error": f"{expected} records were written, {n} are there"}
        except (Broken, OSError) as e:
            yield nothing | {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, size = [], 0
                for r in rows(row["path"], row.get("n_records")):
                    found.append(r)
                    size += len(r["payload"] or b"") + 500
                    if size >= T.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(found, _READ)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, _READ)

    # An archive a task, or a few: paths are narrow, archives aren't.
    dealt = archives.select("path", *["n_records"] * n_known).repartition(max(1, archives.count()))
    return dealt.mapInArrow(run, READ)


def pages_of(records: DataFrame, kind: str) -> DataFrame:
    """(page_id of type `kind`, payload_bytes, payload_digest, record_type, refers_to) of the page records; a record with an
    error ends the job."""

    def key(urn: str) -> Column:
        return F.nullif(F.url_decode(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)), F.lit("")).cast(kind)

    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("archive"), F.lit(": "), F.col("error")))).otherwise(F.col("warc_type"))
    return records.withColumn("record_type", sound).where(F.col("record_type").isin("response", "revisit")).select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as a record and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tie = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    folder = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    return pages_of(read(write(deduplicated(pages, tie=tie), folder), payloads=False), pages.schema["page_id"].dataType.simpleString())


OP13_SQL = """
WITH named AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best,
    list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: right(bin(16 + strpos('0123456789abcdef', c) - 1), 4)), 'string_agg', '') AS bits
  FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_concat([0], list_transform(string_split(substr(bits, 5 * i + 1, 5), ''), lambda b: b::BIGINT)), lambda x, y: 2 * x + y)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN best END AS refers_to
FROM named
"""
