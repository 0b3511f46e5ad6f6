"""Benchmark decontamination (operator 5): prefix-filtered join of item windows with documents.

An item's windows are its runs of `WINDOW` words (an item of fewer words is one window).  A window has to occur whole,
so in the order of rarity one shingle is a sufficient prefix: each window is filed under the shingle of its words that
fewest documents hold.  A document's words point, by their prefix shingles and the offsets in use, at the places where a
window may start; the place has to lie inside the document (positional and length bounds), and the join then asks for
the same prefix, offset and size and for both hashes of all the window's words.

1. Windows are cut in tasks from the benchmark, and their shingles counted in one pass over all documents.
2. A second pass sends what passes two bitmaps (of prefixes, of windows): hits, and few others.  The bitmaps have `BITS`
   bits at every size of the benchmark; a larger one lets more rows through to the join, which decides.
3. Hits are joined with the windows and meet by document.  Texts are never shuffled, and neither benchmark nor corpus
   passes through the driver.

Defined results: a null text has no words; an item without words matches nothing; repeated items all count, under
their own item_id, and so do repeated rows of documents; items with a null item_id are left out of n_items but still
hit; empty tables give an empty result or no hits; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import kept

WINDOW, SHINGLE = 13, 4
#: Bits of a broadcast bitmap, as a power of two: 8 MB.
BITS = 26


def _words(texts: pa.Array) -> T.Words:
    return T.words(texts, T.ALNUM, lower=True)


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, a, b, size, keys) of each window of each item: two hashes of its words, how many they are, and its
    shingles in order (a window shorter than a shingle is one shingle of its own size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = _words(part.column("text"))
                counts = w.counts()
                long, short = T.starts(w.bounds, WINDOW), np.flatnonzero((counts > 0) & (counts < WINDOW))
                at, size = np.concatenate([long, w.bounds[short]]), np.concatenate([np.full(len(long), WINDOW), counts[short]])
                row = np.concatenate([w.rows()[long], short])
                width = np.minimum(SHINGLE, size)
                n = size - width + 1
                cut = np.concatenate([[0], np.cumsum(n)])
                keys = T.grams(w.hash, np.repeat(width, n), np.repeat(at - cut[:-1], n) + np.arange(cut[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(row)), pa.array(T.signed(T.grams(w.hash, size, at))), pa.array(T.signed(T.grams(w.other(), size, at))), pa.array(size, pa.int32()), T.lists(T.signed(keys), cut, pa.int64())],
                    ["item_id", "a", "b", "size", "keys"],
                )

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, a long, b long, size int, keys array<long>")


class Bitmap:
    """Which hashes a table may hold, by their leading bits."""

    def __init__(self, keys: DataFrame, bits: int) -> None:
        """keys: (key) rows; at most 2 ** (bits - 6) words come to the driver."""
        slot = F.shiftrightunsigned("key", 64 - bits)
        words = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.shift, self.words = np.uint64(64 - bits), np.zeros(1 << (bits - 6), np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def prefixes(documents: DataFrame, distinct: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    """(key, offset, a, b, size): each window filed under its rarest shingle, the first of equals; rarity is the number of
    documents, of all, that hold it."""
    keys = distinct.select("a", "b", "size", F.posexplode("keys").alias("offset", "key"))
    shared = documents.sparkSession.sparkContext.broadcast(Bitmap(keys, bits))
    widths = sorted({min(SHINGLE, k) for k in sizes})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w, held = _words(part.column("text")), []
                rows = w.rows()
                for width in widths:
                    at = T.starts(w.bounds, width)
                    h = T.grams(w.hash, width, at)
                    near = shared.value.has(h)
                    held.append(T.distinct(rows[at[near]], h[near], part.num_rows)[0])
                key, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(key)), pa.array(n.astype(np.int64))], ["key", "n"])

    rarity = documents.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    filed = keys.join(rarity, "key", "left").groupBy("a", "b", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("least"))
    return filed.select("least.key", "least.offset", "a", "b", "size")


def occurrences(documents: DataFrame, filed: DataFrame, bits: int) -> DataFrame:
    """doc_id, text_hash, n_words and places (start, size, key, offset, a, b) where a window may stand, of every row."""
    shapes = [(r.offset, r.size) for r in filed.select("offset", "size").distinct().orderBy("offset", "size").collect()]
    shared = documents.sparkSession.sparkContext.broadcast((Bitmap(filed, bits), Bitmap(filed.select(F.col("a").alias("key")), bits)))
    kind = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("offset", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, whole = shared.value
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = _words(part.column("text"))
                rows, found = w.rows(), []
                near: dict[int, tuple] = {}
                whole_at: dict[int, np.ndarray] = {}
                for offset, size in shapes:
                    width = min(SHINGLE, size)
                    if width not in near:
                        at = T.starts(w.bounds, width)
                        h = T.grams(w.hash, width, at)
                        hit = prefix.has(h)
                        near[width] = at[hit], h[hit]
                    at, h = near[width]
                    row = rows[at]
                    fits = (at - offset >= w.bounds[row]) & (at - offset + size <= w.bounds[row + 1])
                    start, h = at[fits] - offset, h[fits]
                    if size not in whole_at:
                        whole_at[size] = np.zeros(len(rows), np.uint64)
                        at = T.starts(w.bounds, size)
                        whole_at[size][at] = T.grams(w.hash, size, at)
                    a = whole_at[size][start]
                    fits = whole.has(a)
                    if fits.any():
                        start = start[fits]
                        found.append((start, np.full(len(start), size), h[fits].view(np.int64), np.full(len(start), offset), a[fits].view(np.int64), T.grams(w.other(), size, start).view(np.int64)))
                columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
                order = np.argsort(columns[0], kind="stable")
                columns = [x[order] for x in columns]
                row = rows[columns[0]] if len(order) else columns[0]
                columns[0] = columns[0] - w.bounds[row]
                places = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kind)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), places)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(w.counts(), pa.int64()), lists], ["doc_id", "text_hash", "n_words", "places"])

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(find, "doc_id long, text_hash long, n_words long, places array<struct<start:int,size:int,key:long,offset:int,a:long,b:long>>")


def covered(spans: str = "spans") -> F.Column:
    """Number of places that (start, size) spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state: F.Column, span: F.Column) -> F.Column:
        end = span["start"] + span["size"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def contamination(documents: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit and items (ids with occurring windows) of every document.  A document's hits meet
    by doc_id and the hash of its text; equal rows have equal hits and each gets them."""
    cut = kept(windows(benchmark), "windows")
    distinct = kept(cut.groupBy("a", "b", "size").agg(F.first("keys").alias("keys")), "distinct-windows")
    sizes = [r.size for r in distinct.select("size").distinct().collect()]
    filed = kept(prefixes(documents, distinct, sizes, bits), "prefixes")
    places = kept(occurrences(documents, filed, bits), "places")
    hits = places.select("doc_id", "text_hash", F.explode("places").alias("p")).select("doc_id", "text_hash", "p.*")
    hits = kept(hits.join(filed, ["key", "offset", "a", "b", "size"], "left_semi").select("doc_id", "text_hash", "start", "size", "a", "b").distinct(), "hits")
    spans = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "size")).alias("spans")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), covered().alias("n_hit"))
    owners = cut.where("item_id IS NOT NULL").select("a", "b", "item_id").distinct()
    items = hits.select("doc_id", "text_hash", "a", "b").distinct().join(owners, ["a", "b"]).groupBy(F.col("doc_id").alias("_e"), F.col("text_hash").alias("_g")).agg(F.collect_set("item_id").alias("items"))
    rows = places.select("doc_id", "text_hash", "n_words")
    rows = rows.join(spans, rows.doc_id.eqNullSafe(spans._d) & (rows.text_hash == spans._h), "left").join(items, rows.doc_id.eqNullSafe(items._e) & (rows.text_hash == items._g), "left")
    return rows.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("items"))


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> F.Column:
    """A document is contaminated when hit words are a twentieth of its words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def keep_clean(documents: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of documents, all columns, that aren't contaminated.  The others' keys are read from a table of known size,
    so Spark broadcasts them while they are few and shuffles documents only beyond that."""
    dirty = kept(contamination(documents, benchmark, bits).where(contaminated()).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    return documents.join(dirty, documents["doc_id"].eqNullSafe(dirty["_id"]) & (F.xxhash64(documents["text"]) == dirty["_hash"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
 iw AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') s FROM (SELECT *, least(13, len(w)) k FROM b WHERE len(w) > 0) x, unnest(range(1, len(x.w) - x.k + 2)) t(i)),
 dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') s FROM (SELECT * FROM d, (SELECT DISTINCT k FROM iw) ks) x, unnest(range(1, len(x.w) - x.k + 2)) t(i)),
 h AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, s)),
 hw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT DISTINCT doc_id, i, k FROM h) x, unnest(range(x.i, x.i + x.k)) t(p) GROUP BY 1),
 hi AS (SELECT doc_id, count(DISTINCT item_id) n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) s FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
