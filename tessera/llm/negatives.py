"""Hard-negative mining (operator 11): exact inner-product search over candidates in buckets of falling norm.

An anchor's score with a row is at most the product of their norms.  Candidates meet a block of anchors in order of their
norm, `BUCKET` at a time, so a bucket's first norm bounds all its scores and those of every bucket after it: an anchor's
window is done with a bucket, and with the rest, once that bound is below the window's lower limit or below its running
k-th score.  Only anchors with an open window are multiplied with a bucket, as matrices.

Two searches: the best rows of the anchor's label are its positives; each of them opens a window of scores in which the best
rows of other labels are its negatives.  Anchors are held in blocks of `ANCHORS` (a few dozen MB with what they have found),
candidates stream past them; a candidate is sent to a block only if the block's label suits it and its norm reaches the
block's lower limits.  Each block's candidates are dealt to lanes at random, so no label, norm or copy of a vector decides a
task's size, and each lane gives k rows a window at most.  Nothing is cut: what isn't multiplied can't be among the results.

Inner products are exact: in 32-bit floats where the norms bound every partial sum by 2^24, in 64-bit ones up to 2^53, beyond
that in Python's integers.

Defined results: rows with a null key, label or vector or a null or non-finite component take no part; vectors meet only those
of their own length; rows of the anchor's own key aren't its positives; repeated rows are rows of their own, as candidates and
as anchors; an anchor without positives, and a positive without negatives, give no row; a score that a long can't hold is an
error; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import kept

#: Candidates whose scores are computed at once, anchors that they are computed for at once, anchors of a block.
BUCKET, STEP, ANCHORS = 2048, 512, 16_384
#: Candidates that a lane should have at least: more lanes give more rows to merge, and less to prune by.
LANE = 8192
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(embedding: str, scale: int = 256) -> Column:
    """Each component x as floor(scale * x); null if the vector or a component is null, or one isn't finite."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~wrong, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def products(a: np.ndarray, b: np.ndarray, norm: float) -> np.ndarray:
    """Inner products of the rows of two integer matrices; norm bounds each product of two rows' norms."""
    if norm < 1 << 53:
        kind = np.float32 if norm < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and (exact.max() > _MOST or exact.min() < _LEAST):
        raise OverflowError("an inner product that a long can't hold")
    return exact.astype(np.int64)


class _Block:
    """Anchors of one length, their windows of scores and the best candidates of each window so far."""

    def __init__(self, rows: list[dict], k: int, same: bool) -> None:
        self.k, self.same = k, same
        self.anchor, self.key, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("row", "key", "label"))
        self.norm = np.array([r["norm"] for r in rows])
        self.vectors = np.array([r["vector"] for r in rows], np.int64).reshape(len(rows), -1)
        windows = [(i, w["number"], w["low"], w["high"]) for i, r in enumerate(rows) for w in r["windows"]]
        self.of, self.number, self.low, self.high = (np.array([w[c] for w in windows], np.int64) for c in range(4))
        # A place that isn't taken has the least score, and key 0.
        self.scores, self.keys = np.full((len(windows), k), _LEAST), np.zeros((len(windows), k), np.int64)
        self.least = self.low.copy()  # what a candidate has to score to enter

    def meet(self, keys: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray) -> bool:
        """Lets a bucket of candidates, in order of falling norm, enter the windows; False if none was open, so that none is
        for what follows either."""
        # The bound is rounded up: norms are square roots in floating point.
        reach = self.norm * norms[0] * (1 + 1e-9) + 1e-3
        still = np.flatnonzero(reach[self.of] >= self.least)
        anchors, of = np.unique(self.of[still], return_inverse=True)
        for at in range(0, len(anchors), STEP):
            some, first, last = anchors[at : at + STEP], *np.searchsorted(of, (at, at + STEP))
            scores = products(self.vectors[some], vectors, reach[some].max())
            fits = (self.label[some][:, None] == labels[None, :]) == self.same
            if self.same:
                fits &= self.key[some][:, None] != keys[None, :]
            for part in range(first, last, STEP):
                windows = still[part : min(part + STEP, last)]
                local = of[part : min(part + STEP, last)] - at
                self._enter(windows, scores[local], fits[local], keys)
        return len(still) > 0

    def _enter(self, windows: np.ndarray, scores: np.ndarray, fits: np.ndarray, keys: np.ndarray) -> None:
        row, column = np.nonzero(fits & (scores >= self.least[windows][:, None]) & (scores <= self.high[windows][:, None]))
        if not len(row):
            return
        touched, at = np.unique(row, return_inverse=True)
        windows, n = windows[touched], len(touched)
        of = np.concatenate([np.repeat(np.arange(n), self.k), at])
        found = np.concatenate([self.scores[windows].ravel(), scores[row, column]])
        named = np.concatenate([self.keys[windows].ravel(), keys[column]])
        order = np.lexsort((named, ~found, of))  # ~x falls as x grows, and can't overflow
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = order[rank < self.k]
        self.scores[windows], self.keys[windows] = found[best].reshape(n, self.k), named[best].reshape(n, self.k)
        self.least[windows] = np.maximum(self.low[windows], self.scores[windows, -1])

    def found(self) -> pa.RecordBatch:
        window, place = np.nonzero(self.scores > _LEAST)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.anchor[self.of[window]], self.number[window].astype(np.int32), self.keys[window, place], self.scores[window, place])], ["anchor", "number", "key", "score"])


def search(anchors: DataFrame, candidates: DataFrame, k: int, same: bool, n_blocks: int, n_rows: int) -> DataFrame:
    """(anchor, number, key, score, rank) of the k best candidates, n_rows in all, of each window, ties by key.

    anchors: (block, row, key, label, norm, vector, windows), candidates: the same but block's values in `blocks`, an array,
    and no windows; a candidate meets the anchors of its blocks whose label is the same, or another one."""
    spark = candidates.sparkSession
    lanes = max(1, min(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks), -(-n_rows // LANE)))
    cell = F.col("block") * lanes + F.col("lane")
    rows = ["row", "key", "label", "norm", "vector"]
    held = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(cell.cast("int").alias("cell"), F.lit(0).alias("kind"), *rows, "windows")
    streamed = candidates.withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes))).withColumn("block", F.explode("blocks")).select(cell.cast("int").alias("cell"), F.lit(1).alias("kind"), *rows, F.lit(None).cast(anchors.schema["windows"].dataType).alias("windows"))
    met = held.unionByName(streamed).repartitionById(n_blocks * lanes, F.col("cell")).sortWithinPartitions("kind", F.desc("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[dict]] = {}
        blocks: dict[int, _Block] | None = None
        done: set[int] = set()
        for batch in batches:
            split = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            for row in batch.slice(0, split).to_pylist():
                waiting.setdefault(len(row["vector"]), []).append(row)
            if split == batch.num_rows:
                continue
            blocks = blocks or {size: _Block(rows, k, same) for size, rows in waiting.items()}
            batch = batch.slice(split)
            size = batch.column("vector").value_lengths().to_numpy()
            keys, labels, norms = (batch.column(c).to_numpy() for c in ("key", "label", "norm"))
            for length in set(np.unique(size).tolist()) & blocks.keys() - done:
                rows = np.flatnonzero(size == length)
                for at in range(0, len(rows), BUCKET):
                    some = rows[at : at + BUCKET]
                    vectors = batch.column("vector").take(pa.array(some)).flatten().to_numpy().reshape(len(some), -1)
                    if not blocks[length].meet(keys[some], labels[some], norms[some], vectors):
                        done.add(length)
                        break
        for block in (blocks or {}).values():
            yield block.found()

    found = met.mapInArrow(run, "anchor long, number int, key long, score long")
    best = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _windows(number: Column, low: Column, high: Column) -> Column:
    return F.struct(number.cast("int").alias("number"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (key, label, vector of longs): for each
    row that `anchor` is true for, and each of its best rows of the same label, the best rows of other labels whose scores are
    from `low` to `high` percent of that row's."""
    some = vectors.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    rows = kept(some.select(F.monotonically_increasing_id().alias("row"), F.col("key").cast("long").alias("key"), F.col("label").cast("long").alias("label"), _norm(F.col("vector")).alias("norm"), "vector", F.coalesce(anchor, F.lit(False)).alias("chosen")), "vectors")
    n_rows = rows.count()
    anchors = rows.where("chosen").drop("chosen")
    # A label's anchors fill as many blocks as they need, one after another; where these begin follows from the label.
    labels = kept(anchors.groupBy("label").count().select("label", F.ceil(F.col("count") / ANCHORS).cast("int").alias("wide"), "count"), "anchor-labels")
    n_blocks = max(1, -(-(labels.agg(F.sum("count")).first()[0] or 0) // ANCHORS))

    def block(offset: Column) -> Column:
        return F.pmod(F.xxhash64("label") + offset, F.lit(n_blocks)).cast("int")

    mine = anchors.join(labels, "label").withColumn("block", block(F.pmod(F.xxhash64("row"), F.col("wide")))).withColumn("windows", F.array(_windows(F.lit(0), F.lit(_LEAST), F.lit(_MOST))))
    theirs = rows.join(labels, "label").withColumn("blocks", F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("wide") - 1), block)))
    first = kept(search(mine, theirs, positives, True, n_blocks, n_rows).select("anchor", F.col("rank").alias("number"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    share = F.col("positive_score").cast("decimal(19,0)")
    limits = _windows(F.col("number"), F.ceil(share * low / 100), F.floor(share * high / 100))
    opened = first.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(limits)).alias("windows"))
    mine = kept(anchors.join(opened, "row").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")), "anchors")
    # The least norm that reaches a block; 16 bytes for each 16,384 anchors.
    least = F.coalesce(F.try_divide(F.array_min(F.transform("windows", lambda w: w["low"])), F.col("norm")), F.lit(0.0))
    reach = mine.groupBy("block").agg((F.min(least) * (1 - 1e-8)).alias("reach"))
    theirs = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(F.broadcast(reach), "block").where("norm >= reach").withColumn("blocks", F.array("block")).drop("block")
    second = search(mine, theirs, negatives, False, n_blocks, n_rows)
    named = second.join(first, ["anchor", "number"]).join(anchors.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors; a seventh of the labels is wrong on purpose."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").alias("key"), label.alias("label"), quantised("embedding").alias("vector")), F.col("key") % 100 == 0)


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows AS a JOIN rows AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INT AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 10
"""
