"""WARC archives: round trips, an independent decoder, broken archives, revisits against SQL."""

import base64
import hashlib
import io
import struct

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import warc
from tests.compare import duck_rows, spark_rows

PAGES = "page_id long, url string, html string"
DATE = "2024-01-01T00:00:00Z"


class Held(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()
        super().close()


def archive(records):
    out = Held()
    writer = warc.Archive(out, DATE)
    for x in records:
        writer.add(x)
    writer.close()
    return out.whole


def page(i, size=3000):
    return f"<html><title>Page {i}</title><p>{' '.join(f'word{(i * 31 + k * k) % 977}' for k in range(size // 8))}</p></html>".encode()


@pytest.fixture(scope="module")
def records():
    return [warc.page_record(i, f"https://a.example/{i}", page(i), None, False, DATE) for i in range(600)]


@pytest.fixture(scope="module")
def whole(records):
    return archive(records)


def test_archive_is_read_by_another_decoder(records, whole):
    """A skippable frame with a compressed dictionary, then frames that any decoder with it reads across."""
    magic, size = struct.unpack("<II", whole[:8])
    dictionary = zstandard.ZstdDecompressor().decompress(whole[8 : 8 + size])
    assert magic == 0x184D2A5D and dictionary[:4] == bytes.fromhex("37a430ec")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).stream_reader(io.BytesIO(whole[8 + size :]), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and plain.endswith(b"".join(records))
    assert sum(len(zstandard.ZstdCompressor(level=3).compress(x)) for x in records) > len(whole)


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_frames_in_any_pieces(records, whole, step):
    some = whole if step > 1 else archive(records[:3])
    stream = io.BytesIO(some)
    got = list(warc.frames(lambda n: stream.read(min(n, step))))
    assert [x for _, x in got][1:] == (records if step > 1 else records[:3])
    assert all(some[at : at + 4] == bytes.fromhex("28b52ffd") for at, _ in got)


def test_plain_dictionaries_and_other_skippable_frames(records, whole):
    size = struct.unpack("<I", whole[4:8])[0]
    dictionary = zstandard.ZstdDecompressor().decompress(whole[8 : 8 + size])
    put_in = struct.pack("<II", 0x184D2A50, 5) + b"notes"
    some = struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary + put_in + whole[8 + size :]
    assert [x for _, x in warc.frames(io.BytesIO(some).read)][1:] == records
    few = archive(records[:1])
    assert few[:4] == bytes.fromhex("28b52ffd") and len(list(warc.frames(io.BytesIO(put_in + few).read))) == 2


def test_pages_come_back():
    for payload in (b"", b"\r\n\r\n", "Ünï\r\n\r\n\0".encode(), b"x" * 3_000_000):
        r = warc.parse(warc.page_record("a b/>", "https://x.example/\r\nInjected: 1", payload, None, False, DATE))
        assert (r.payload, r.payload_bytes, r.payload_digest) == (payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert r.target_uri == "https://x.example/%0D%0AInjected:%201" and r.record_id == "<urn:page:a%20b%2F%3E>"
        v = warc.parse(warc.page_record(3, None, payload, 9, True, DATE))
        assert (v.warc_type, v.payload, v.payload_bytes, v.payload_digest, v.refers_to, v.target_uri) == ("revisit", None, len(payload), r.payload_digest, "<urn:page:9>", None)


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"WARC/1.1", b"WARC/9.1"), (b"WARC-Date: " + DATE.encode() + b"\r\n", b""), (b"WARC-Type", b"no colon"), (b"Content-Length: 3", b"Content-Length: -3"), (b"Content-Length: 3", b"Content-Length: 4"),
        (b"Page", b"Pagf"), (b"sha1:", b"sha1:A"), (b"\r\n\r\n<html", b"<html"),
    ],
)
def test_wrong_records(old, new):
    good = warc.page_record(3, "u", page(3), None, False, DATE)
    assert warc.parse(good) and old in good
    with pytest.raises(ValueError):
        warc.parse(good.replace(old, new))
    for cut in (good[:-1], good[:-4], good + b"x", b""):
        with pytest.raises(ValueError):
            warc.parse(cut)


def test_broken_archives_give_errors(spark, tmp_path, records, whole):
    size = 8 + struct.unpack("<I", whole[4:8])[0]
    compress = zstandard.ZstdCompressor().compress
    bad = {
        "cut": whole[: size + 2000], "dictionary": whole[: size - 10], "garbage": b"\x01\x02\x03\x04" + whole, "none": b"", "stray": whole + b"PK", "no_dictionary": struct.pack("<II", 0x184D2A5D, 4) + b"abcd" + whole[size:], "lost": whole[size:],
        "flipped": whole[: size + 1500] + bytes([whole[size + 1500] ^ 255]) + whole[size + 1501 :], "record": compress(records[0]) + compress(records[1][:-2]) + compress(records[2]),
    }
    for name, raw in bad.items():
        (tmp_path / f"{name}.warc.zst").write_bytes(raw)
    (tmp_path / "fine.warc.zst").write_bytes(whole)
    got = warc.read(warc.archives_in(spark, f"{tmp_path}/*.warc.zst")).select(F.regexp_extract("archive", "([^/]+).warc.zst", 1).alias("name"), F.col("error").isNull().alias("fine"), "payload").collect()
    fine = {name: [bytes(r.payload) for r in got if r.name == name and r.fine] for name in [*bad, "fine"]}
    wrong = {name: sum(r.name == name and not r.fine for r in got) for name in [*bad, "fine"]}
    assert wrong == dict.fromkeys(bad, 1) | {"none": 0, "fine": 0} and fine["fine"][1:] == [page(i) for i in range(600)]
    assert fine["record"] == [page(0), page(2)] and fine["stray"] == fine["fine"] and not fine["garbage"] and not fine["dictionary"] and not fine["lost"] and not fine["none"]
    assert fine["cut"] == fine["fine"][: len(fine["cut"])] and fine["flipped"] == fine["fine"][: len(fine["flipped"])]
    missing = warc.read(spark.createDataFrame([(f"{tmp_path}/nowhere", 3), (f"{tmp_path}/fine.warc.zst", 9)], "path string, n_records long")).where("error IS NOT NULL")
    assert missing.count() == 2
    with pytest.raises(Exception, match="nowhere"):
        warc.pages_of(missing, "long").collect()


def test_revisits_against_sql(spark, tmp_path):
    """A payload that a third of the pages share, empty ones, null keys, texts and addresses, repeated rows."""
    rows = [(i, f"u{i}", "<p>shared</p>" if i % 3 == 0 else f"<p>{i // 4}</p>") for i in range(300)] + [(900, None, None), (901, "", ""), (None, None, None), (7, "u7", "<p>1</p>"), (902, "a\nb", "one"), (902, "a\nb", "one"), (902, None, "two"), (None, "z", "alone")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in ("key", "payload", "name", "best", "row", "revisit")})
    df.repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names, got = spark_rows(warc.op13_warc(spark, str(tmp_path)))
    assert (names, got) == duck_rows(duck.sql(warc.OP13_SQL)) and len(got) == len(rows)
    untied = spark_rows(warc.deduplicated(df).where("key = 902").select("payload", "revisit"))[1]
    assert len(untied) == 3 and not any(r[1] for r in untied)


def test_archives_roll_and_keep_texts(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", page(i, 9000).decode()) for i in range(700)], PAGES).repartition(2)
    manifest = warc.write(warc.deduplicated(pages), f"file://{tmp_path}/a", archive_bytes=300_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == 700 + manifest.count()
    got = {r.record_id: bytes(r.payload) for r in warc.read(manifest).where("warc_type = 'response'").collect()}
    assert got == {f"<urn:page:{i}>": page(i, 9000) for i in range(700)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op13_warc(spark, str(tmp_path)).count() == 0
