"""Vector columns: dot products, norms and exact top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors that a block of queries may take.
BLOCK_BYTES = 64 << 20
#: Queries that are multiplied with rows at once, and these rows.
STEP, WIDTH = 512, 2048


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2(v) -> Column:
    """F39; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def encoder(encode: Callable[[list], np.ndarray]):
    """A model as a column function: `encode` takes a batch's values and gives a row of numbers for each."""

    @F.pandas_udf("array<float>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(c.tolist()), np.float32)), dtype=object)

    return run


def embed_rows(rows: DataFrame, key: str, value: str, encode: Callable[[list], list]) -> DataFrame:
    """(key, embedding) of the rows that can be encoded; `encode` gives None for the others, which are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = encode(batch.column(value).to_pylist())
            some = [i for i, x in enumerate(found) if x is not None]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, value).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def top_k(queries: DataFrame, gallery: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, group: str | None = None) -> DataFrame:
    """V1: (query_id, key, score, rank) of the k gallery rows of largest dot product, ties by key; queries: (query_id,
    embedding), gallery: (key, embedding).  With `group`, a column of both, only rows of the query's group count.

    Queries are dealt to blocks of about `block_bytes`, with `group` those of a group to as few as hold them, and a block's
    part of the gallery to lanes at random.  A task gets the block first, then streams its lane past it, multiplies both as
    matrices and keeps k rows a query.  Nothing passes through the driver but counts, and no group decides a task's size.

    A null id, key, group or embedding takes no part, nor does one with a component that is null or NaN; vectors of different lengths don't meet."""
    spark = gallery.sparkSession
    kept, of = (["_group"], [F.col(group).alias("_group")]) if group else ([], [])
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    queries, gallery = (rows.where(F.col(name).isNotNull() & sound).select(F.col(name).alias("name"), "embedding", *of) for rows, name in ((queries, "query_id"), (gallery, "key")))
    sizes = queries.groupBy(*kept).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("size"))
    a_block = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.greatest("size", F.lit(1)))))
    sizes = sizes.withColumn("wide", F.greatest(F.lit(1), F.ceil(F.col("n") / a_block)).cast("int"))
    n_blocks = max(1, sizes.agg(F.ceil(F.sum(F.col("n") / a_block))).first()[0] or 1)
    lanes = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))
    if group:
        # A group's queries fill as many blocks as they need, one after another; where these begin follows from the group.
        sizes = sizes.select("_group", "wide")
        queries, gallery = queries.join(sizes, "_group"), gallery.join(sizes, "_group")
        begin = F.xxhash64("_group")
    else:
        queries, gallery, begin = queries.withColumn("wide", F.lit(n_blocks)), gallery.withColumn("wide", F.lit(n_blocks)), F.lit(0).cast("long")

    def block(offset: Column) -> Column:
        return F.pmod(begin + offset, F.lit(n_blocks)).cast("int")

    cell = (F.col("block") * lanes + F.col("lane")).cast("int").alias("cell")
    held = queries.withColumn("block", block(F.pmod(F.xxhash64("name"), "wide"))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(cell, F.lit(0).alias("kind"), "name", "embedding", *kept)
    blocks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("wide") - 1), block))
    streamed = gallery.withColumn("block", F.explode(blocks)).withColumn("lane", F.pmod(F.xxhash64("name", F.lit(lanes)), F.lit(lanes))).select(cell, F.lit(1).alias("kind"), "name", "embedding", *kept)
    met = held.unionByName(streamed).repartitionById(n_blocks * lanes, F.col("cell")).sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        best: dict[int, _Best] | None = None
        for batch in batches:
            split = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if split:
                waiting.append(batch.slice(0, split))
            if split == batch.num_rows:
                continue
            if best is None:
                best = {size: _Best(*columns, k) for size, columns in _by_length(pa.Table.from_batches(waiting).combine_chunks().to_batches() if waiting else [])}
                waiting = []
            for size, (names, vectors, groups) in _by_length([batch.slice(split)]):
                if size in best:
                    best[size].meet(names, vectors, groups)
        for b in (best or {}).values():
            yield b.found()

    found = met.mapInArrow(run, "query_id long, key long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_length(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]]]:
    """Names, vectors as a matrix and groups of the rows of each length."""
    for batch in batches:
        vectors = batch.column("embedding")
        lengths = vectors.value_lengths().to_numpy()
        for size in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == size)
            matrix = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), size)
            yield size, (batch.column("name").to_numpy(zero_copy_only=False)[some], matrix, batch.column("_group").to_numpy(zero_copy_only=False)[some] if "_group" in batch.schema.names else None)


class _Best:
    """The k best rows so far of each query of a block; with groups, the queries of a group stand together."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, groups: np.ndarray | None, k: int) -> None:
        self.places = None
        if groups is not None:
            order = np.argsort(groups, kind="stable")
            names, vectors = names[order], vectors[order]
            each, begin = np.unique(groups[order], return_index=True)
            self.places = dict(zip(each.tolist(), zip(begin.tolist(), [*begin.tolist()[1:], len(names)])))
        self.names, self.vectors, self.k = names, vectors, k
        self.keys, self.scores = np.zeros((len(names), k), np.int64), np.full((len(names), k), -np.inf)
        self.filled = np.zeros((len(names), k), bool)

    def meet(self, keys: np.ndarray, vectors: np.ndarray, groups: np.ndarray | None) -> None:
        if groups is None:
            return self._meet(0, len(self.names), keys, vectors)
        order = np.argsort(groups, kind="stable")
        each, begin = np.unique(groups[order], return_index=True)
        for group, some in zip(each.tolist(), np.split(order, begin[1:])):
            if group in self.places:
                self._meet(*self.places[group], keys[some], vectors[some])

    def _meet(self, begin: int, end: int, keys: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(begin, end, STEP):
            for first in range(0, len(keys), WIDTH):
                self._enter(slice(at, min(at + STEP, end)), keys[first : first + WIDTH], vectors[first : first + WIDTH])

    def _enter(self, some: slice, keys: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.vectors[some] @ vectors.T
        enters = (scores >= self.scores[some, -1:]) | ~self.filled[some, -1:]
        if len(keys) > self.k and not self.filled[some, -1].all():
            # What isn't among the k best of these rows alone can't enter either; NaN would count as the best there.
            best = np.partition(scores, -self.k, 1)[:, -self.k :]
            if not np.isnan(best).any():
                enters &= scores >= best[:, :1]
        row, column = np.nonzero(enters)
        if not len(row):
            return
        touched, of = np.unique(row, return_inverse=True)
        mine = touched + some.start
        n, old = len(touched), self.filled[mine].ravel()
        of = np.concatenate([np.repeat(np.arange(n), self.k)[old], of])
        score = np.concatenate([self.scores[mine].ravel()[old], scores[row, column]])
        key = np.concatenate([self.keys[mine].ravel()[old], keys[column]])
        order = np.lexsort((key, -score, of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.keys[mine[of[order]], rank], self.scores[mine[of[order]], rank], self.filled[mine[of[order]], rank] = key[order], score[order], True

    def found(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.filled)
        return pa.RecordBatch.from_arrays([pa.array(self.names[query]), pa.array(self.keys[query, place]), pa.array(self.scores[query, place])], ["query_id", "key", "score"])
