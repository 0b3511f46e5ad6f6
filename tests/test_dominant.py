"""Dominant colours against plain loops; images that can't be read, few pixels, grounds that hide the figure."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest

from tessera.operators import dominant as D

SCHEMA = "key int, at int, width int, pixels array<int>, cropped boolean"


def lab(p):
    line = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in (p >> 16, p >> 8 & 255, p & 255)]
    t = [sum(m * c for m, c in zip(row, line)) / w for row, w in zip(D.SRGB_7, D.WHITE)]
    f = [math.cbrt(v) if v > (6 / 29) ** 3 else v * (29 / 6) ** 2 / 3 + 4 / 29 for v in t]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def brute(images, k=5):
    """Loops over pixels, clusters and rounds."""
    pixels = []
    for width, packed, cropped in images:
        own = [lab(p) for p in packed]
        if not cropped:
            rows = [own[i : i + width] for i in range(0, len(own), width)]
            ring = rows[0] + rows[-1] + [r[0] for r in rows] + [r[-1] for r in rows]
            ground = [statistics.median(p[c] for p in ring) for c in range(3)]
            far = [p for p in own if math.dist(p, ground) > 12]
            own = far if len(far) >= 0.05 * len(own) else own
        pixels += own
    if len(pixels) <= k:
        centres, of = pixels, list(range(len(pixels)))
    else:
        centres = [pixels[i] for i in sorted(range(len(pixels)), key=lambda i: hashlib.sha1(f"0:{i}".encode()).digest())[:k]]
        for _ in range(15):
            of = [min(range(k), key=lambda j: (math.dist(p, centres[j]), j)) for p in pixels]
            moved = []
            for j in range(k):
                mine = [p for p, x in zip(pixels, of) if x == j]
                moved.append(tuple(sum(p[c] for p in mine) / len(mine) for c in range(3)) if mine else centres[j])
            still = all(abs(a - b) <= 1e-3 + 1e-5 * abs(b) for u, v in zip(moved, centres) for a, b in zip(u, v))
            centres = moved
            if still:
                break
    share = [of.count(j) / len(of) for j in range(len(centres))]
    return [(centres[j], share[j]) for j in sorted(range(len(centres)), key=lambda j: -share[j]) if share[j] >= 0.03]


def picture(rng, kind):
    width, height = rng.randint(4, 9), rng.randint(4, 9)
    ground, inks = rng.randrange(1 << 24), [rng.randrange(1 << 24) for _ in range(rng.randint(1, 7))]
    if kind == "flat":
        return width, [ground] * (width * height), False
    inside = lambda x, y: 0 < x < width - 1 and 0 < y < height - 1
    return width, [rng.choice(inks) if kind == "noise" or inside(x, y) else ground for y in range(height) for x in range(width)], kind == "crop"


def test_against_loops(spark):
    rng = random.Random(13)
    keys = {key: [picture(rng, rng.choice(["figure", "figure", "noise", "flat", "crop"])) for _ in range(rng.randint(1, 3))] for key in range(60)}
    df = spark.createDataFrame([(key, at, *image) for key, images in keys.items() for at, image in enumerate(images)], SCHEMA).repartition(5)
    got = {}
    for r in sorted(D.dominant_colours(df, "key", colours=9).collect(), key=lambda r: (r.key, r["rank"])):
        got.setdefault(r.key, []).append((tuple(r.lab), r.share))
    for key, images in keys.items():
        want = brute(images)
        assert len(got[key]) == len(want)
        for (a, n), (b, m) in zip(got[key], want):
            assert a == pytest.approx(b, abs=1e-6) and n == pytest.approx(m)


def test_grounds(spark):
    red, grey, near = 0xC00000, 0x808080, 0x828282
    figure = [red if 0 < x < 9 and 0 < y < 9 else grey for y in range(10) for x in range(10)]
    white = [near if (x, y) == (5, 5) else grey for y in range(10) for x in range(10)]
    one = [red if (x, y) == (5, 5) else grey for y in range(10) for x in range(10)]
    rows = [(1, 0, 10, figure, False), (2, 0, 10, white, False), (3, 0, 10, one, False), (4, 0, 10, figure, True), (5, 0, 10, figure, None)]
    got = {}
    for r in D.dominant_colours(spark.createDataFrame(rows, SCHEMA), "key").collect():
        got.setdefault(r.key, {})[r.hex] = round(r.share, 2)
    # The ground goes, unless hardly anything would be left or the image is a crop; what is under 3 % isn't given.
    assert got[1] == got[5] == {"#c00000": 1.0} and set(got[3]) == {"#808080"} and len(got[2]) == 1 and got[4] == {"#c00000": 0.64, "#808080": 0.36}


def test_odd_images(spark):
    rows = [(1, 0, 3, [1, 2, 3, 4], False), (2, 0, 3, None, False), (3, 0, None, [0xFFFFFF], True), (3, 1, 0, [], False), (4, 0, 0, [0x102030], False), (None, 0, 1, [0xFF0000], True), *((5, at, 1, [0x0000FF if at < 3 else 0x00FF00] * 4, True) for at in range(6)), (6, 0, 2, [0xFF0000, 0x00FF00], True), (6, 0, 2, [0xFF0000, 0x00FF00], True)]
    got = sorted(((r.key or 0, r["rank"], r.hex, r.canonical, round(r.share, 3)) for r in D.dominant_colours(spark.createDataFrame(rows, SCHEMA), "key").collect()))
    assert [g[:3] + g[4:] for g in got] == [(0, 1, "#ff0000", 1.0), (3, 1, "#ffffff", 1.0), (5, 1, "#0000ff", 1.0), (6, 1, "#ff0000", 0.25), (6, 2, "#00ff00", 0.25), (6, 3, "#ff0000", 0.25)]
    assert D.dominant_colours(spark.createDataFrame([], SCHEMA), "key").count() == 0


def test_empty_cluster_keeps_its_centre():
    same = np.array([[1.0, 2, 3]] * 6 + [[50.0, 0, 0]])
    centres, of = D.clusters(same, 3)
    assert len(centres) == 3 and set(map(tuple, centres)) <= {(1.0, 2, 3), (50.0, 0, 0)} and len(set(of)) == len(np.unique(centres, axis=0))


def test_many_keys_at_once(spark, monkeypatch):
    """A key's colours are the same, to the last bit, alone and beside others, wherever the images of a task are cut."""
    rng = random.Random(14)
    keys = {key: [picture(rng, rng.choice(["figure", "noise", "flat", "crop"])) for _ in range(rng.randint(1, 3))] for key in range(40)}
    rows = [(key, at, *image) for key, images in keys.items() for at, image in enumerate(images)] + [(40, 0, 3, [1, 2, 3, 4], False), (41, 0, 2, None, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for most in (1, 60, 1000, 1 << 16):
        monkeypatch.setattr(D, "PIXELS", most)
        results.append(sorted((r.key, r["rank"], *r.lab, r.share) for r in D.dominant_colours(df, "key", colours=9).collect()))
    assert results[0] == results[1] == results[2] == results[3] and {r[0] for r in results[0]} == set(keys)
    runs = [np.array([lab(rng.randrange(1 << 24)) for _ in range(rng.randint(1, 60))]) for _ in range(50)]
    centres, nearest = D.clusters_of(np.concatenate(runs), np.array([len(run) for run in runs]))
    ends = np.cumsum([len(run) for run in runs])
    for i, run in enumerate(runs):
        alone, of = D.clusters(run)
        assert np.array_equal(centres[i][: len(alone)], alone) and np.array_equal(nearest[ends[i] - len(run) : ends[i]], of)
