"""Dominant colours of each image (F12, F13): k-means in Lab over an image's own pixels, background left out.

Images are rows and stay where they are; a task clusters the images of some keys at once, about `PIXELS` of them, so memory
is that of a batch.  Each key's numbers are added in its own order, so they don't depend on the keys beside it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.colour import SRGB_7, WHITE, lab_to_hex, nearest_swatch

#: Clusters, rounds and their end; how far from the border's median the foreground is and the least share it has; the least
#: share of a cluster.
CLUSTERS, ROUNDS, TOLERANCE = 5, 15, 1e-3
BACKGROUND, LEAST_FOREGROUND, LEAST_AREA = 12.0, 0.05, 0.03
#: Pixels that are clustered at once; a key with more is clustered alone.
PIXELS = 1 << 16


@lru_cache(1)
def _linear() -> np.ndarray:
    c = np.arange(256) / 255.0
    return np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)


def lab_of(packed: np.ndarray) -> np.ndarray:
    """Lab of pixels 0xRRGGBB, a row each."""
    r, g, b = (_linear()[packed >> shift & 255] for shift in (16, 8, 0))
    t = np.stack([(m[0] * r + m[1] * g + m[2] * b) / white for m, white in zip(SRGB_7, WHITE)])
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * (29 / 6) ** 2 / 3 + 4 / 29)
    return np.stack([116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])], 1)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of some runs, one run after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def foreground(lab: np.ndarray, lengths: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Which pixels of some images, one after another, are far from the median of their image's border ring; all of an
    image's, if those are too few."""
    starts, ground = np.cumsum(lengths) - lengths, np.empty((len(lengths), 3))
    for n, width in np.unique(np.stack([lengths, widths], 1), axis=0):
        at = np.flatnonzero((lengths == n) & (widths == width))
        grid = np.arange(n).reshape(-1, width)
        border = np.concatenate([grid[0], grid[-1], grid[:, 0], grid[:, -1]])
        ground[at] = np.median(lab[starts[at][:, None] + border], 1)
    of = np.repeat(np.arange(len(lengths)), lengths)
    far = np.linalg.norm(lab - ground[of], axis=1) > BACKGROUND
    return far | (np.bincount(of, far, len(lengths)) / lengths < LEAST_FOREGROUND)[of]


@lru_cache(4096)
def first_centres(n: int, k: int, seed: int) -> np.ndarray:
    """Places of k of n pixels, chosen by digest of seed and place."""
    return np.array(sorted(range(n), key=lambda i: hashlib.sha1(f"{seed}:{i}".encode()).digest())[:k])


def clusters_of(pixels: np.ndarray, lengths: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """the centres of each run of pixels, (run, k, 3), and each pixel's cluster, the nearest centre's before its run's last
    round.  A cluster without pixels keeps its centre; k pixels or fewer are clusters of their own."""
    m, starts = len(lengths), np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(m), lengths)
    centres, nearest = np.zeros((3, k, m)), np.arange(len(pixels)) - starts[of]
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        first = first_centres(int(n), k, seed) if n > k else np.arange(n)
        centres[:, : len(first), at] = pixels[starts[at] + first[:, None]].transpose(2, 0, 1)
    live = np.flatnonzero(lengths[of] > k)
    run, values = of[live], pixels[live].T.copy()
    for _ in range(rounds):
        if not len(live):
            break
        for j in range(k):
            a, b, c = (np.square(values[i] - centres[i, j][run]) for i in range(3))
            far = a + b + c
            if j:
                less = far < least
                least, near = np.where(less, far, least), np.where(less, j, near)
            else:
                least, near = far, np.zeros(len(live), np.int64)
        bins = near * m + run
        n = np.bincount(bins, minlength=k * m)
        sums = np.stack([np.bincount(bins, v, k * m) for v in values])
        moved = np.where(n > 0, sums / np.maximum(n, 1), centres.reshape(3, -1)).reshape(centres.shape)
        still = (np.abs(moved - centres) <= TOLERANCE + 1e-5 * np.abs(centres)).all((0, 1))
        nearest[live], centres = near, moved
        on = ~still[run]
        if not on.all():
            live, run, values = live[on], run[on], values[:, on]
    return centres.transpose(2, 1, 0), nearest


def clusters(pixels: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """the same for one run."""
    centres, nearest = clusters_of(pixels, np.array([len(pixels)]), k, rounds, seed)
    return centres[0][: len(pixels)], nearest


def dominant(packed: np.ndarray, lengths: np.ndarray, widths: np.ndarray, cropped: np.ndarray, keys: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, rank from 1, centre, share) of the clusters of each key's pixels together, the largest first, none below the least
    share; of images one after another, in the order of their keys, without those that can't be read."""
    lab = lab_of(packed)
    kept, ring = np.ones(len(packed), bool), np.flatnonzero(~cropped)
    at = _runs((np.cumsum(lengths) - lengths)[ring], lengths[ring])
    kept[at] = foreground(lab[at], lengths[ring], widths[ring])
    found, sizes = np.unique(np.repeat(keys, lengths)[kept], return_counts=True)
    centres, nearest = clusters_of(lab[kept], sizes, k, rounds, seed)
    share = np.bincount(np.repeat(np.arange(len(found)), sizes) * k + nearest, minlength=len(found) * k).reshape(-1, k) / sizes[:, None]
    order = np.argsort(-share, axis=1, kind="stable")
    row, rank = np.nonzero(np.take_along_axis(share, order, 1) >= LEAST_AREA)
    cluster = order[row, rank]
    return found[row], rank + 1, centres[row, cluster], share[row, cluster]


def _readable(images: pa.Array) -> tuple[np.ndarray, ...]:
    """The pixels of those images of a column that can be read, one after another, and their lengths, widths, whether they are
    cropped, and the places of their rows."""
    width, lists, cropped = images.flatten().flatten()
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width, cropped = width.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), cropped.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(images)), images.value_lengths().to_numpy(zero_copy_only=False))
    # What isn't cropped has full rows.
    good = (n > 0) & (cropped | (width > 0) & (n % np.maximum(width, 1) == 0))
    packed = lists.flatten().to_numpy()[np.repeat(good, n)]
    return packed, n[good], width[good], cropped[good], rows[good]


def dominant_colours(images: DataFrame, key: str, per_key: int = 3, colours: int = 3, seed: int = 0) -> DataFrame:
    """(key, rank, lab, share, hex, canonical): of each key's first `per_key` images the primary colour (rank 1) and the
    secondary ones.

    images: (key, at, width, pixels, cropped); pixels are numbers 0xRRGGBB in rows of `width`; where `cropped` isn't true
    the background is estimated and left out.  An image without pixels, or whose rows aren't full, isn't read; a key without
    images gives no row; nulls in `at` come first."""
    rows = images.select(F.col(key).alias("_key"), "at", F.struct("width", "pixels", F.coalesce("cropped", F.lit(False)).alias("cropped")).alias("image"))
    some = rows.withColumn("k", F.row_number().over(Window.partitionBy("_key").orderBy(F.asc_nulls_first("at")))).where(F.col("k") <= per_key)
    whole = some.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("k", "image"))).alias("images")).select("_key", F.transform("images", lambda x: x["image"]).alias("images"))
    kind = images.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, n, width, cropped, rows = _readable(batch.column("images"))
            ends, parts, first = np.cumsum(n), [], 0
            while first < len(n):
                # Up to PIXELS, but whole keys, and one at least.
                last = max(np.searchsorted(ends, ends[first] - n[first] + PIXELS, "right"), first + 1) - 1
                last = np.searchsorted(rows, rows[last] + (rows[last] == rows[first] or last + 1 == len(n)), "left")
                parts.append(dominant(packed[ends[first] - n[first] : ends[last - 1]], n[first:last], width[first:last], cropped[first:last], rows[first:last], seed=seed))
                first = last
            at, rank, lab, share = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3)), np.empty(0))
            some = rank <= colours
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at[some])), pa.array(rank[some].astype(np.int32)), *(pa.array(lab[some, c]) for c in range(3)), pa.array(share[some])], ["_key", "rank", "L", "a", "b", "share"])

    found = whole.mapInArrow(run, f"_key {kind.simpleString()}, rank int, L double, a double, b double, share double")
    lab = F.struct("L", "a", "b")
    return found.select(F.col("_key").alias(key), "rank", lab.alias("lab"), "share", lab_to_hex(lab).alias("hex"), nearest_swatch(lab).alias("canonical"))
