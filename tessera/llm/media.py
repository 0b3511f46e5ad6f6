"""Media columns (operator 1): interleaved sequences of text and media references, media in a table of their own.

`sequences` parses pages into parts in reading order.  A media part holds a reference (its address or, for inline media,
the SHA-256 of the bytes) and its caption (the figure's, before or after it, else alt); the bytes go to a column of their own, so that they
lie in other pages of the Parquet file than the sequence.  `resolve` joins payloads back by digest; positions and
captions stay those of the sequence.

Defined results: a null page has no parts; a part without text isn't kept, nor what stands in `noscript` or `template`; a
marked section (`<![...]>`) is a comment, as in browsers; a caption ends where its figure, a heading or another section
does, and one that nothing ends is text; of an element's addresses `src` or `data` counts, or `data-src` or the first of
`srcset` where there is none or only an inline stand-in for it; a video's poster is an image of its own; inline media that can't be decoded keep
their reference and have no payload; equal media have one digest, and a digest that is asked for many times (a third of
all rows, say) is split by Spark's skew join, with small rows on that side; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import arrow_batches, kept

WIDTH = 64
MEDIA_TAGS = {"img": "image", "audio": "audio", "video": "video", "source": "media", "embed": "media", "object": "media"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "tr", "td", "th", "blockquote", "pre", "figure", "header", "footer", "nav", "main", "aside", "hr", "title", "body"}
_HIDDEN = {"script", "style", "template", "noscript"}
#: Start tags that end a caption which has no end tag.
_ENDS_CAPTION = {"figure", "article", "section", "header", "footer", "nav", "main", "aside", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Bytes of an Arrow batch of pages, and of a row group of media.
BATCH, ROW_GROUP = 8 << 20, 16 << 20


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.texts: list[str] = []
        self.hidden, self.caption, self.figure, self.figure_caption = 0, None, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.texts).split())
        self.texts = []
        if text:
            self.parts.append({"kind": "text", "text": text, "caption": None, "ref": None, "media": None})

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def end_caption(self) -> None:
        text = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figure is not None:  # for media of the figure that come after it
            self.figure_caption = text or None
        for part in self.parts[self.figure if self.figure is not None else len(self.parts) :]:
            if part["kind"] != "text":
                part["caption"] = text or part["caption"]

    def end_page(self) -> None:
        if self.caption is not None:
            self.texts, self.caption = self.caption, None
        self.flush()

    def place(self, kind: str, ref: str, alt: str | None) -> None:
        self.flush()
        media = _inline(ref)
        self.parts.append({"kind": kind, "text": None, "caption": self.figure_caption or alt or None, "ref": hashlib.sha256(media).hexdigest() if media is not None else ref, "media": media})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.caption is not None and tag in _ENDS_CAPTION:
            self.end_caption()
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            if self.caption is not None:
                self.end_caption()
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS and not self.hidden:
            given = dict(attrs)
            ref = _address(given)
            if tag == "video" and given.get("poster"):
                self.place("image", given["poster"], None)
            if ref:
                self.place(MEDIA_TAGS[tag], ref, given.get("alt"))
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure, self.figure_caption = len(self.parts), None

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("figcaption", "figure") and self.caption is not None:
            self.end_caption()
        if tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = self.figure_caption = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.texts if self.caption is None else self.caption).append(data)


def _address(given: dict) -> str | None:
    """An element's address, of the attributes in the order that the module's docstring gives."""
    ref = given.get("src") or given.get("data")
    if ref and not ref.startswith("data:"):
        return ref
    listed = (given.get("srcset") or "").strip().split(None, 1)
    return given.get("data-src") or (listed[0].rstrip(",") if listed and not ref else None) or ref


def _inline(ref: str) -> bytes | None:
    """The bytes of a data address; None for other addresses and for what isn't base64 (white space and missing padding
    are allowed, as in browsers)."""
    if not ref.startswith("data:") or "," not in ref:
        return None
    head, body = ref.split(",", 1)
    raw = unquote_to_bytes(body)
    if not head.endswith(";base64"):
        return raw
    raw = b"".join(raw.split())
    if len(raw) % 4 and b"=" not in raw:
        raw += b"=" * (-len(raw) % 4)
    try:
        return base64.b64decode(raw, validate=True)
    except (binascii.Error, ValueError):
        return None


def parse(html: str | None) -> list[dict]:
    """Parts of a page, in order."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    reader.end_page()
    return reader.parts


_PART = {"position": pa.int64(), "kind": pa.string(), "text": pa.string(), "caption": pa.string(), "ref": pa.string(), "media": pa.binary()}


def sequences(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each part of each page: the columns `carry` of the page, position (from 0), kind (text, or the kind of
    media), text, caption, ref (address, or digest of inline media) and media (inline bytes)."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, html, 4 << 20):
                rows, parts = [], []
                for row, page in enumerate(part.column(html)):
                    for position, found in enumerate(parse(page.as_py())):
                        rows.append(row)
                        parts.append(found | {"position": position})
                taken = part.select(list(carry)).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array([p[c] for p in parts], kind) for c, kind in _PART.items())], [*carry, *_PART])

    return pages.select(*carry, html).mapInArrow(run, f"{schema}, position long, kind string, text string, caption string, ref string, media binary")


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """Parts with the columns of media (one row for each digest `ref`); parts without payload stay."""
    return parts.join(media, "ref", "left")


def graymap(text: F.Column) -> F.Column:
    """A text's UTF-8 bytes, filled up with zeros to lines of 64, as the 8-bit samples of a portable graymap."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    lines = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)).cast("int")
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), lines.cast("string"), F.lit("\n255\n")), "UTF-8"), F.rpad(raw, lines * WIDTH, F.lit(b"\x00")))


def read_graymap(media: bytes) -> bytes:
    """The samples of a graymap written by `graymap`."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit graymap")
    return samples


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    mean = x.mean()
    return f"{mean:.4f};{np.sqrt(max(np.square(x, dtype=np.float64).mean() - mean * mean, 0)):.4f};{','.join(map(str, bins.tolist()))}"


def measured(media: DataFrame) -> DataFrame:
    """One row for each digest of (ref, media): what the stored bytes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, stored in zip(batch.column("ref").to_pylist(), batch.column("media")):
                stored = stored.as_py()
                samples = read_graymap(stored)
                rows.append({"ref": ref, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-WIDTH:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature(samples)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("ref", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    rows = media.select("ref", "media").mapInArrow(run, "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("ref").agg(*(F.first(c).alias(c) for c in rows.columns[1:]))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page whose figure holds the text's bytes: parsed, stored, read back and joined by digest."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    page = F.concat(F.lit('<article><h1>document</h1><figure><img alt="bytes" src="data:image/x-portable-graymap;base64,'), F.base64(graymap(F.col("text"))), F.lit('"><figcaption>text of the document</figcaption></figure></article>'))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    with arrow_batches(spark, BATCH):
        stored = kept(sequences(documents.select("doc_id", n_bytes.alias("n_bytes"), page.alias("html")), "html", ("doc_id", "n_bytes")), "media", **{"parquet.block.size": str(ROW_GROUP)}).where("kind = 'image'")
        media = kept(measured(stored), "media-features")
    return resolve(stored.select("doc_id", "n_bytes", "position", "caption", "ref"), media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
