"""MinHash near-duplicates (operator 9): an LSH forest whose candidates are confirmed on full shingle sets.

1. Texts of equal shingle sets form classes; only a class's smallest doc_id goes on.
2. Each tree of the forest orders the signatures by its own sequence of hash values.  Signatures that agree on the
   tree's first `DEPTH` values form a region; regions of one are dropped by a count before any signature moves.  The
   number of trees follows from the threshold and `MISS`.
3. In a region of up to `SMALL` texts every pair is a candidate whose signatures agree as often as a pair at the threshold
   does (but for a chance of `MISS`).  A larger region is dealt to many tasks by ranges of its order; there candidates
   are the neighbours of longest common prefix, a few hubs (a hub is the member nearest to the most frequent values of
   what is left) with the members like them, and, at the depth where the region has fallen apart into groups of up to
   `DEEP`, every pair of a group.
4. Hub and neighbour pairs are confirmed first, on the shingles of the whole texts; of the others, those whose ends are
   still in different components.  A larger region that is still in several components is then joined exactly: two texts
   at the threshold share one of the rarest 15 % + 1 (at 0.85) of either's shingles, whatever number of members hold it.
   Pairs in one component, and pairs whose numbers of shingles or places of the shared one rule the threshold out,
   aren't confirmed.

Defined results: null, empty and wordless texts have the empty set and are components of their own; fewer than five
words are one shingle; ties and repeated rows share a component; rows with a null doc_id are left to themselves (null
component, kept); an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.graph import components
from tessera.llm.store import arrow_batches, kept

WORDS = 5
#: Values that a region shares at least, and the chance with which a pair at the threshold may be missed by all trees (and,
#: again, by how often its signatures agree).
DEPTH, MISS = 3, 3e-7
#: Regions up to SMALL are paired fully; a larger one is taken in blocks of BLOCK rows of its order, and deeper down in
#: groups of DEEP.
SMALL, BLOCK, HUBS, DEEP = 48, 4096, 3, 8
#: Rows of regions that a task gets.
PER_TASK = 1 << 14
#: Holders of a shingle that meet in one cell; more are dealt to blocks, and every two blocks to a cell.
CELL = 512
#: Bytes of an Arrow batch: a task holds one on either side, and some of them at once.
BATCH = 8 << 20


class Forest(NamedTuple):
    """What follows from a threshold: trees, values of a signature, and how many of them agree in a candidate."""

    trees: int
    hashes: int
    agree: int


def forest(least: int) -> Forest:
    s = min(least / 100, 1 - 1e-9)
    trees = max(1, ceil(log(MISS) / log(1 - s**DEPTH)))
    n = trees * DEPTH
    below, agree = 0.0, 0
    while (below := below + comb(n, agree) * s**agree * (1 - s) ** (n - agree)) <= MISS:
        agree += 1
    return Forest(trees, n, agree)


_SCATTER = np.random.default_rng(9_000_011).integers(0, 1 << 63, (2, 1024), dtype=np.uint64)


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and offsets."""
    row, h = _shingles(T.words(texts, lower=True), size)
    return T.distinct(row, h, len(texts))


def _shingles(w: T.Words, size: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row and hash of each shingle, and its hash over the other word hashes given."""
    rows, counts = w.rows(), w.counts()
    at = T.starts(w.bounds, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    return np.concatenate([rows[at], short]), *(np.concatenate([T.grams(h, size, at), T.grams(h, counts[short], w.bounds[short])]) for h in (w.hash, *more))


def signatures(h: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """`hashes` 32-bit minima for each set; an empty set has zeros."""
    out = np.zeros((len(offsets) - 1, hashes), ">u4")
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        begin, buffer = offsets[some], np.empty_like(h)
        for k in range(hashes):
            np.bitwise_xor(h, _SCATTER[0, k], out=buffer)
            np.multiply(buffer, _SCATTER[1, k] | np.uint64(1), out=buffer)
            out[some, k] = np.minimum.reduceat(buffer, begin) >> np.uint64(32)
    return out


def sketches(documents: DataFrame, least: int = 85) -> DataFrame:
    """doc_id, n_shingles, a and b (sums over the set by two independent hashes) and sig of every row."""
    hashes = forest(least).hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                w = T.words(part.column("text"), lower=True)
                row, h, g = _shingles(w, WORDS, w.other())
                order = T.by_row(row, h)
                row, h, g = row[order], h[order], g[order]
                if ((row[1:] == row[:-1]) & (h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():
                    order = np.lexsort((g, h, row))
                    row, h, g = row[order], h[order], g[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                row, h, g = row[new], h[new], g[new]
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
                n = np.diff(offsets)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(T.mix(x))]) for x in (h, g)]
                a, b = (T.signed(s[offsets[1:]] - s[offsets[:-1]]) for s in sums)
                sig = signatures(h, offsets, hashes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "n_shingles", "a", "b", "sig"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, sig binary")


def _hub(sig: np.ndarray) -> int:
    """The row that agrees most with the most frequent value of each column."""
    if len(sig) < 3:
        return 0
    agree = np.zeros(len(sig), np.int32)
    for column in sig.T:
        values, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
        agree += inverse == counts.argmax()
    return int(agree.argmax())


def region_pairs(ids: np.ndarray, sig: np.ndarray, least: int = 85) -> tuple[list[np.ndarray], int]:
    """Candidate pairs [(from, to, order)] of one region's block in the tree's order, and a larger region's first hub."""
    m, out, shape = len(ids), [], forest(least)

    def pair(i: np.ndarray, j: np.ndarray, order: int, agree: float) -> None:
        ok = (sig[i] == sig[j]).sum(1) >= agree
        out.append(np.column_stack([ids[i[ok]], ids[j[ok]], np.full(int(ok.sum()), order)]))

    # Next to each other in the order: the longest common prefixes.
    if m <= SMALL:
        i, j = np.triu_indices(m, 1)
        pair(i[j - i == 1], j[j - i == 1], 0, shape.agree)
        pair(i[j - i > 1], j[j - i > 1], 1, shape.agree)
        return out, 0
    pair(np.arange(m - 1), np.arange(1, m), 0, max(shape.agree, shape.hashes * (least - 10) / 100))
    rest, first = np.arange(m), 0
    for k in range(HUBS):
        if len(rest) < 2:
            break
        hub = rest[_hub(sig[rest])]
        first = hub if k == 0 else first
        rest = rest[rest != hub]
        pair(np.full(len(rest), hub), rest, 0, max(shape.agree, shape.hashes * (least - 20) / 100))
        rest = rest[(sig[rest] == sig[hub]).mean(1) < least / 100]
    # Deeper, where the region falls apart.
    shared = np.append((sig[1:] == sig[:-1]).cumprod(1).sum(1), 0)
    todo = [(0, m, DEPTH + 1)]
    while todo:
        a, b, depth = todo.pop()
        ends = a + 1 + np.flatnonzero(shared[a : b - 1] < depth)
        for x, y in zip([a, *ends.tolist()], [*ends.tolist(), b]):
            if 1 < y - x <= DEEP:
                i, j = np.triu_indices(y - x, 1)
                pair(x + i[j - i > 1], x + j[j - i > 1], 1, shape.agree)
            elif y - x > DEEP and depth < shape.hashes:
                todo.append((x, y, depth + 1))
    return out, first


def candidates(reps: DataFrame, least: int = 85) -> tuple[DataFrame, DataFrame]:
    """(a, b, first) pairs, a < b, of (doc_id, sig) rows, first: to be confirmed in the first round; and (region,
    doc_id) of the members of large regions."""
    shape, width = forest(least), 4 * DEPTH
    key = F.xxhash64("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})"))
    rows = reps.select("doc_id", "sig", F.explode(F.sequence(F.lit(0), F.lit(shape.trees - 1))).alias("tree")).select("doc_id", "tree", key.alias("region"))
    shared = kept(rows.groupBy("region").count().where("count > 1").select(F.col("region").alias("_r"), (F.col("count") > SMALL).alias("large")), "regions")
    members = rows.join(shared.hint("merge"), F.col("region") == F.col("_r")).drop("_r")
    sigs = reps.select(F.col("doc_id").alias("_d"), "sig")
    members = kept(members.join(sigs.hint("merge"), members.doc_id == sigs._d).select("region", "doc_id", "large", F.expr(f"concat(substring(sig, tree * {width} + 1), substring(sig, 1, tree * {width}))").alias("path")), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        region, found = None, []

        def close() -> None:
            if len(held) > 1 or (held and full):
                ids = np.array([d for d, _ in held], np.int64)
                sig = np.frombuffer(b"".join(p for _, p in held), ">u4").reshape(len(held), shape.hashes).astype(np.uint32)
                pairs, hub = region_pairs(ids, sig, least)
                found.extend(np.column_stack([np.full(len(p), region), p]) for p in pairs)
                if full:
                    # The block's hub, with itself: blocks meet through their hubs.
                    found.append(np.array([[region, ids[hub], ids[hub], 0]]))
            held.clear()

        full = False
        for batch in batches:
            for r, d, large, p in zip(*(batch.column(c).to_pylist() for c in ("region", "doc_id", "large", "path"))):
                if r != region or len(held) >= BLOCK:
                    close()
                    region, full = r, large
                held.append((d, p))
            if found:
                yield _pairs(found)
                found.clear()
        close()
        if found:
            yield _pairs(found)

    def paired(part: DataFrame) -> DataFrame:
        return part.sortWithinPartitions("region", "path", "doc_id").select("region", "doc_id", "large", "path").mapInArrow(run, "region long, a long, b long, later int")

    tasks = max(1, ceil(members.count() / PER_TASK))
    small, large = members.where("NOT large"), members.where("large")
    # A large region's rows are dealt by ranges of its order, so none lies in one task.
    found = kept(paired(small.repartition(tasks, "region")).unionByName(paired(large.repartitionByRange(tasks, "region", "path", "doc_id"))), "found")
    hubs = found.where("a = b").select("region", F.col("a").alias("hub")).distinct()
    chained = hubs.join(hubs.groupBy(F.col("region").alias("_r")).agg(F.min("hub").alias("least")), F.col("region") == F.col("_r")).where("least < hub").select(F.col("least").alias("a"), F.col("hub").alias("b"), F.lit(0).alias("later"))
    pairs = found.where("a < b").select("a", "b", "later").unionByName(chained)
    return pairs.groupBy("a", "b").agg((F.min("later") == 0).alias("first")), large.select("region", "doc_id")


def rare_pairs(texts: DataFrame, least: int = 85) -> DataFrame:
    """(a, b) pairs, in different components, of (doc_id, text, component) rows that share one of either's rarest
    shingles, which a pair of that similarity has to, and whose sizes and places of that shingle allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                h, offsets = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("component"), T.lists(T.signed(h), offsets, pa.int64())], ["doc_id", "component", "h"])

    sets = texts.select("doc_id", "component", "text").mapInArrow(run, "doc_id long, component long, h array<long>")
    rows = kept(sets.select("doc_id", "component", F.size("h").alias("n"), F.explode("h").alias("h")), "member-shingles")
    held = kept(rows.groupBy("h").count().where("count > 1").select(F.col("h").alias("_h"), "count"), "shared-shingles")
    by_doc = Window.partitionBy("doc_id")
    shared = rows.join(held.hint("merge"), F.col("h") == F.col("_h")).withColumns({"k": F.row_number().over(by_doc.orderBy("count", "h")), "all": F.count(F.lit(1)).over(by_doc)})
    # Shingles of one row come first in the order of rarity; they take up places but pair nothing.
    place = F.col("k") + F.col("n") - F.col("all")
    prefix = kept(shared.where(place <= F.col("n") - F.ceil(F.col("n") * least / 100) + 1).select("h", "doc_id", "component", "n", place.alias("place")), "prefixes")
    groups = prefix.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")).where("x <> y").select(F.col("h").alias("_h"), "blocks")
    groups = kept(groups, "prefix-groups")  # a plain table, so that Spark can split a shingle that very many hold
    dealt = prefix.join(groups.hint("merge"), F.col("h") == F.col("_h")).withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.col("blocks")).cast("int"))
    side = lambda x, cells: dealt.select(F.col("h").alias(f"h{x}"), F.col("block").alias(f"block{x}"), F.explode(cells).alias(f"with{x}"), *(F.col(c).alias(f"{c}{x}") for c in ("doc_id", "component", "n", "place")))
    one, two = side(1, F.sequence("block", F.col("blocks") - 1)), side(2, F.sequence(F.lit(0), "block"))
    # At a pair's first shared shingle, those from there on are all that it can share.
    left = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) + 1
    met = (F.col("h1") == F.col("h2")) & (F.col("block1") == F.col("with2")) & (F.col("with1") == F.col("block2")) & (F.col("component1") != F.col("component2"))
    met &= ((F.col("block1") < F.col("block2")) | (F.col("doc_id1") < F.col("doc_id2"))) & (100 * left >= least * (F.col("n1") + F.col("n2") - left))
    return one.hint("merge").join(two, met).select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b")).distinct()


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(found).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1:3].min(1)), pa.array(x[:, 1:3].max(1)), pa.array(x[:, 3].astype(np.int32))], ["region", "a", "b", "later"])


def confirmed(pairs: DataFrame, texts: DataFrame, least: int = 85) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= least * union; texts: (doc_id, text)."""
    one, two = texts.select(F.col("doc_id").alias("_a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("_b"), F.col("text").alias("tb"))
    # Sort-merge at every size: the sides grow with the corpus, and Spark can split a hub's rows.
    both = pairs.select("a", "b").hint("merge").join(one, F.col("a") == F.col("_a")).select("a", "b", "ta").hint("merge").join(two, F.col("b") == F.col("_b")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "ta"):
                n = part.num_rows
                sets = [shingles(part.column(c)) for c in ("ta", "tb")]
                size = [np.diff(offsets) for _, offsets in sets]
                row = np.concatenate([np.repeat(np.arange(n), s) for s in size])
                h = np.concatenate([s[0] for s in sets])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                inter = np.bincount(row[1:][same], minlength=n)
                ok = (100 * inter >= least * (size[0] + size[1] - inter)) & (inter > 0)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, least: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every row."""
    with arrow_batches(documents.sparkSession, BATCH):
        return _near_duplicates(documents, least)


def _near_duplicates(documents: DataFrame, least: int) -> DataFrame:
    rows = kept(sketches(documents, least), "sketches")
    sets = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = kept(sets.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    pairs, large = candidates(classes.select(F.col("rep").alias("doc_id"), "sig"), least)
    pairs = kept(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_id")).union(large.select("doc_id")).distinct()
    texts = kept(documents.select("doc_id", "text").join(ends.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi"), "texts")
    links = kept(confirmed(pairs.where("first"), texts, least), "links")
    found = components(links)
    a, b = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    open_pairs = pairs.where("NOT first").join(a, "a", "left").join(b, "b", "left").where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b")))
    # A large region whose members are one component by now has nothing left to find.
    placed = kept(large.join(found.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("region", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    mixed = placed.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(F.col("region").alias("_r"))
    unsure = placed.join(kept(mixed, "mixed-regions").hint("merge"), F.col("region") == F.col("_r"), "left_semi").groupBy(F.col("doc_id").alias("_l")).agg(F.first("component").alias("component"))
    named_texts = texts.join(unsure.hint("merge"), F.col("doc_id") == F.col("_l")).select("doc_id", "text", "component")
    open_pairs = open_pairs.select("a", "b").union(rare_pairs(named_texts, least)).distinct()
    more = kept(confirmed(kept(open_pairs, "open-pairs"), texts, least), "more-links")
    if not more.isEmpty():
        # Later links join components of the first round.
        joined = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        top = components(joined, "joined").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        nodes = found.select("node", "component").union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
        found = nodes.join(top, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    named = kept(classes.select("a", "b", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.coalesce("component", "rep").alias("component_id")), "named")
    linked = sets.select("doc_id", "n_shingles", "a", "b").join(named.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(documents: DataFrame, least: int = 85) -> DataFrame:
    """The rows of documents, all columns, that are first of their component."""
    dropped = kept(near_duplicates(documents, least).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")), "dropped").hint("merge")
    return documents.join(dropped, documents["doc_id"] == dropped["_id"], "left_anti")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document, and whether it is the one to keep."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
 sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) s FROM d, unnest(range(1, greatest(len(d.w) - 3, 2))) t(i) WHERE len(d.w) > 0),
 n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
 links AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
 reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) n_shingles, m AS component_id, doc_id = m AS kept FROM documents JOIN (SELECT a, min(b) m FROM reach GROUP BY 1) ON a = doc_id LEFT JOIN n USING (doc_id)
"""
