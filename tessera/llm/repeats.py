"""Substring dedup (operator 3): long repeats across documents, found by recompression.

Rounds of run and pair naming shorten each text's word sequence.  Names are hashes of what they stand for, so every
task gives equal substrings equal interior symbols without asking another.  With each symbol goes its context, the
stretch of words that decided how it was formed; a symbol whose context lies inside a window is the same wherever the
window's words occur.  So is a high-level symbol, which stands for several neighbours whose contexts all lie inside.  A
window of `WINDOW` words is known by the smallest high-level symbol of the longest kind that it holds, its anchor;
windows without one (long runs of a word, say) are always looked at.

1. Per document: anchors of its windows, and a cryptographic digest of its words.  Documents of equal words form
   classes; of those with a window, all but the smallest doc_id are removed whole, and only classes count further on.
2. Anchors that two classes share are kept; the documents that hold one are cut into windows again, and windows with a
   shared anchor are confirmed by two independent 64-bit hashes of their words: sorted by these and doc_id, all but the
   smallest document's go.
   Within a task windows are first compared with each other, so that a passage that very many documents share sends
   one row a task.
3. Documents meet the starts of their removed windows and write out what is left.

Defined results: a null text has no words and loses none; a repeated row is judged like its double (equal doc_id: not
smaller, so neither removes the other); rows with a null doc_id lose nothing and remove nothing; texts of fewer words
than a window stay whole; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import kept

WINDOW = 50
#: Rounds of naming: symbols then stand for 3 words on average; their contexts reach about as far again to each side.
ROUNDS = 4
#: Neighbouring symbols that a high-level symbol stands for; a window takes the first of these that fits in it.
LEVELS = (6, 3, 1)
#: Windows that a task compares with each other before they are shuffled.
COMPARED = 1 << 20
_NONE = np.uint64(0)


def symbols(h: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, first word of context, end of context) of each text's symbols after `rounds` rounds, in order.  A context
    that would reach past its text's ends goes one word beyond them, so no window holds it."""
    n = len(h)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    name, low, high = T.mix(h), np.arange(n), np.arange(n) + 1
    for k in range(rounds):
        # Runs: equal neighbours become one symbol; its neighbours decide where the run ends, a single symbol's too.
        first = np.ones(len(name), bool)
        first[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(name)))
        last = at + size - 1
        run = size > 1
        always = np.ones(len(at), bool)
        low, high = _widened(low, high, row, bounds, at, last, always, always)
        name, row = np.where(run, T.mix(name[at] * np.uint64(0x9FB21C651E98DF25) ^ size.astype(np.uint64)), name[at]), row[at]
        # Pairs: a left symbol followed by a right one.  An unpaired one depends on the neighbour that it could join.
        right = (T.mix(name ^ np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        heads = np.zeros(len(name), bool)
        heads[:-1] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
        tails = np.zeros(len(name), bool)
        tails[1:] = heads[:-1]
        at = np.flatnonzero(~tails)
        paired = heads[at]
        last = at + paired
        low, high = _widened(low, high, row, bounds, at, last, ~paired & right[at], ~paired & ~right[at])
        name, row = np.where(paired, T.mix(name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + T.mix(name[last] + np.uint64(k))), name[at]), row[at]
    return name, low, high


def _widened(low: np.ndarray, high: np.ndarray, row: np.ndarray, bounds: np.ndarray, at: np.ndarray, last: np.ndarray, to_left: np.ndarray, to_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the symbols that join [at, last], with their left or right neighbour's where that decided."""
    a, b = low[at], high[last]
    before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(low) - 1)
    inside = (at > 0) & (row[before] == row[at])
    a = np.where(to_left, np.where(inside, low[before], bounds[row[at]] - 1), a)
    inside = (last + 1 < len(low)) & (row[after] == row[at])
    return a, np.where(to_right, np.where(inside, high[after], bounds[row[at] + 1] + 1), b)


def anchors(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and their anchors (0: none)."""
    at = T.starts(bounds, window)
    found = np.zeros(len(at), np.uint64)
    if not len(at):
        return at, found
    name, low, high = symbols(h, bounds, rounds)
    # Contexts advance with the symbols, so those inside a window are neighbours.
    low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    for level in LEVELS:
        none = np.flatnonzero(found == _NONE)
        if len(name) < level or not len(none):
            continue
        joint = np.maximum(T.grams(name, level, np.arange(len(name) - level + 1)), np.uint64(1))
        begin, end = np.searchsorted(low[: len(joint)], at[none]), np.searchsorted(high[level - 1 :], at[none] + window, "right")
        found[none] = _least(joint, begin, end)
    return at, found


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest value of each range, 0 for an empty one."""
    n, out = end - begin, np.zeros(len(begin), np.uint64)
    most, width = int(n.max(initial=0)), 1
    while width <= most:
        # `values` holds the minima of `width` neighbours; two of them cover any range of up to twice that.
        some = np.flatnonzero((n >= width) & (n < 2 * width))
        out[some] = np.minimum(values[begin[some]], values[end[some] - width])
        values = np.minimum(values[:-width], values[width:]) if len(values) > width else values[:0]
        width *= 2
    return out


def _profiles(documents: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, a and b (digest of the words) and names (distinct anchors) of every row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                counts, rows = w.counts(), w.rows()
                a, b = T.digests(w)
                at, found = anchors(w.hash, w.bounds, window)
                names, offsets = T.distinct(rows[at], found, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(a), pa.array(b), T.lists(T.signed(names), offsets, pa.int64())], ["doc_id", "n_words", "a", "b", "names"])

    return documents.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, n_words long, a long, b long, names array<long>")


def _windows(documents: DataFrame, window: int) -> DataFrame:
    """Rows (a, b, doc_id, start, gone) of the windows of (doc_id, text, names) whose anchor is among names.  gone: a
    smaller document of the same batch has the window; else the row is to be compared with other tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, held = [], 0
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                rows = w.rows()
                at, found = anchors(w.hash, w.bounds, window)
                names = _flat(part.column("names"))
                of = np.repeat(np.arange(part.num_rows), [len(x) if x is not None else 0 for x in part.column("names")])
                # Names of other documents in the slice may only add windows, which the exact hash then sorts out.
                shared = np.unique(np.append(names[of >= 0], _NONE))
                to = np.minimum(np.searchsorted(shared, found), len(shared) - 1)
                at = at[shared[to] == found]
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[rows[at]]
                a, b = T.grams(w.hash, window, at), T.grams(w.other(), window, at)
                # One row for equal windows of a document: the first.
                order = np.lexsort((at, b, a, rows[at]))
                new = np.ones(len(order), bool)
                new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (rows[at][order][1:] != rows[at][order][:-1])
                order = order[new]
                taken.append((a[order], b[order], doc[order], (at - w.bounds[rows[at]])[order]))
                held += len(order)
                if held >= COMPARED:
                    yield _compared(taken)
                    taken, held = [], 0
        if taken:
            yield _compared(taken)

    return documents.mapInArrow(run, "a long, b long, doc_id long, start int, gone boolean")


def _compared(taken: list[tuple]) -> pa.RecordBatch:
    a, b, doc, start = (np.concatenate(x) for x in zip(*taken))
    order = np.lexsort((doc, b, a))
    a, b, doc, start = a[order], b[order], doc[order], start[order]
    gone = _beyond_first(a, b, doc)
    # Rows that are decided already are dealt by document, not by window.
    a = np.where(gone, T.mix(doc.astype(np.uint64)), a)
    return pa.RecordBatch.from_arrays([pa.array(T.signed(a)), pa.array(T.signed(b)), pa.array(doc), pa.array(start, pa.int32()), pa.array(gone)], ["a", "b", "doc_id", "start", "gone"])


def _flat(lists: pa.Array) -> np.ndarray:
    """All elements of a list column."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _beyond_first(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows sorted by (a, b, doc): whether an earlier row of the same window has a smaller document."""
    if not len(a):
        return np.zeros(0, bool)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return doc > np.repeat(doc[at], np.diff(np.append(at, len(a))))


def _removed(windows: DataFrame) -> DataFrame:
    """(doc_id, start) of the windows that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last window and its smallest document: a window's rows may go on in the next batch
        for batch in batches:
            a, b, doc, start = (batch.column(c).to_numpy() for c in ("a", "b", "doc_id", "start"))
            gone = batch.column("gone").to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (gone[1:] != gone[:-1])
            at = np.flatnonzero(new)
            least = np.repeat(doc[at], np.diff(np.append(at, len(a))))
            if held and held[:3] == (a[0], b[0], gone[0]):
                least[: at[1] if len(at) > 1 else len(a)] = held[3]
            held = (a[-1], b[-1], gone[-1], least[-1])
            out = gone | (doc > least)
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out])], ["doc_id", "start"])

    return windows.repartition("a").sortWithinPartitions("a", "b", "gone", "doc_id").mapInArrow(run, "doc_id long, start int")


def _written(documents: DataFrame, window: int) -> DataFrame:
    """Output rows of (doc_id, text, starts, whole): starts are first places of removed windows; whole: a smaller
    document has all the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"))
                counts = w.counts()
                size = np.array([len(x) if x.is_valid else 0 for x in part.column("starts")], np.int64)
                at = np.repeat(w.bounds[:-1], size) + (_flat(part.column("starts").filter(pa.array(size > 0))).astype(np.int64) if size.any() else np.zeros(0, np.int64))
                edge = np.zeros(len(w.hash) + 1, np.int64)
                if len(at):
                    # Equal windows elsewhere in the document go with the first.
                    rows = w.rows()
                    all_at = T.starts(w.bounds, window)
                    all_at = all_at[size[rows[all_at]] > 0]
                    for h in (w.hash, w.other()):
                        keys = [T.mix(T.grams(h, window, x) + rows[x].astype(np.uint64)) for x in (at, all_at)]
                        all_at = all_at[np.isin(keys[1], keys[0])]
                    edge += np.bincount(all_at, minlength=len(edge)) - np.bincount(all_at + window, minlength=len(edge))
                covered = np.cumsum(edge)[:-1] > 0
                whole = np.array([bool(x) and n >= window for x, n in zip(part.column("whole").to_pylist(), counts.tolist())])
                covered |= np.repeat(whole, counts)
                removed = np.bincount(w.rows()[covered], minlength=part.num_rows)
                raw, cut = T.joined(w, ~covered)
                texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(cut), pa.py_buffer(raw)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), texts], ["doc_id", "n_words", "n_removed", "kept_text"])

    return documents.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def deduplicated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row."""
    profiles = kept(_profiles(documents, window), "profiles")
    full = profiles.where(F.col("n_words") >= window)
    classes = kept(full.groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "word-classes").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "rep")
    role = full.select("doc_id", "a", "b").join(classes, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("doc_id", (F.col("doc_id") > F.col("rep")).alias("whole"))
    role = kept(role.groupBy("doc_id").agg(F.min("whole").alias("whole")), "roles")
    named = full.select("doc_id", "a", "b", F.explode("names").alias("name"))
    shared = kept(named.where("name <> 0").groupBy("name").agg(*(f(c).alias(n) for n, f, c in (("x", F.min, "a"), ("y", F.max, "a"), ("u", F.min, "b"), ("v", F.max, "b")))).where("x <> y OR u <> v").select(F.col("name").alias("_n")), "anchors")
    held = named.where("name <> 0").select("doc_id", "name").join(shared, F.col("name") == F.col("_n")).select("doc_id", "name").union(named.where("name = 0").select("doc_id", "name"))
    own = role.where("NOT whole").select(F.col("doc_id").alias("_o"))
    names = held.groupBy("doc_id").agg(F.collect_set("name").alias("names")).join(own, F.col("doc_id") == F.col("_o"), "left_semi").select(F.col("doc_id").alias("_d"), "names")
    texts = documents.select("doc_id", "text")
    gone = kept(_removed(_windows(texts.join(names, F.col("doc_id") == F.col("_d")).select("doc_id", "text", "names"), window)), "removed")
    starts = gone.groupBy("doc_id").agg(F.collect_set("start").alias("starts")).select(F.col("doc_id").alias("_d"), "starts")
    verdict = role.join(starts, F.col("doc_id") == F.col("_d"), "left").where("whole OR starts IS NOT NULL").select(F.col("doc_id").alias("_v"), "starts", "whole")
    return _written(texts.join(verdict, F.col("doc_id") == F.col("_v"), "left").select("doc_id", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole")), window)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to windows of 50 words that a smaller document has, and a digest of what it keeps."""
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) s FROM d, unnest(range(1, len(d.w) - 48)) t(i)),
 f AS (SELECT s, min(doc_id) m FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM win JOIN f USING (s) WHERE m < doc_id) x, unnest(range(x.i, x.i + 50)) t(p)),
 words AS (SELECT doc_id, p, w[p] word FROM d, unnest(range(1, len(d.w) + 1)) t(p)),
 stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN stay USING (doc_id)
"""
