"""Colour columns (F5-F10); a Lab colour is a struct of L, a and b."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.constants import PALETTE

# sRGB to XYZ (D65), with seven and with four digits.
SRGB_7 = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
SRGB_4 = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)


def rgb_to_lab(r: Column, g: Column, b: Column, matrix: tuple = SRGB_7) -> Column:
    """CIELAB of 8-bit sRGB."""
    line = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, 2.4)).otherwise(c / 255.0 / 12.92) for c in (r, g, b)]
    xyz = [sum((m * c for m, c in zip(row[1:], line[1:])), row[0] * line[0]) / w for row, w in zip(matrix, WHITE)]
    f = [F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * (29 / 6) ** 2 / 3 + 4 / 29) for t in xyz]
    return F.struct((116 * f[1] - 16).alias("L"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def delta_76(x: Column, y: Column) -> Column:
    return F.sqrt(sum((F.pow(x[c] - y[c], 2) for c in ("a", "b")), F.pow(x["L"] - y["L"], 2)))


def similarity(x: Column, y: Column, falloff: float = 25.0) -> Column:
    """F9."""
    return F.exp(-F.pow(delta_76(x, y) / falloff, 2))


def ciede2000(x: Column, y: Column) -> Column:
    """the CIEDE2000 colour difference, as published by Sharma, Wu and Dalal (2005)."""
    chroma = lambda c: F.sqrt(F.pow(c["a"], 2) + F.pow(c["b"], 2))
    c7 = F.pow((chroma(x) + chroma(y)) / 2, 7)
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = (1 + g) * x["a"], (1 + g) * y["a"]
    c1, c2 = F.sqrt(a1 * a1 + F.pow(x["b"], 2)), F.sqrt(a2 * a2 + F.pow(y["b"], 2))
    hue = lambda b, a: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, a)) + 360, F.lit(360.0)))
    h1, h2 = hue(x["b"], a1), hue(y["b"], a2)
    grey = c1 * c2 == 0
    diff = h2 - h1
    turn = F.when(grey, 0.0).when(diff > 180, diff - 360).when(diff < -180, diff + 360).otherwise(diff)
    d_l, d_c, d_h = y["L"] - x["L"], c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2))
    l_m, c_m = (x["L"] + y["L"]) / 2, (c1 + c2) / 2
    total = h1 + h2
    h_m = F.when(grey, total).when(F.abs(diff) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    cos = lambda k, shift: F.cos(F.radians(k * h_m + shift))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    s_l = 1 + 0.015 * F.pow(l_m - 50, 2) / F.sqrt(20 + F.pow(l_m - 50, 2))
    s_c, s_h = 1 + 0.045 * c_m, 1 + 0.015 * c_m * t
    m7 = F.pow(c_m, 7)
    r_t = -2 * F.sqrt(m7 / (m7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-F.pow((h_m - 275) / 25, 2))))
    return F.sqrt(F.pow(d_l / s_l, 2) + F.pow(d_c / s_c, 2) + F.pow(d_h / s_h, 2) + r_t * (d_c / s_c) * (d_h / s_h))


def lab_to_hex(lab: Column) -> Column:
    """F8: #rrggbb, channels clipped and rounded half to even."""
    fy = (lab["L"] + 16) / 116
    back = lambda f: F.when(f > 6 / 29, F.pow(f, 3)).otherwise((f - 4 / 29) * 3 * (6 / 29) ** 2)
    x, y, z = (back(f) * w for f, w in zip((fy + lab["a"] / 500, fy, fy - lab["b"] / 200), WHITE))
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    out = []
    for m in rows:
        v = F.greatest(m[0] * x + m[1] * y + m[2] * z, F.lit(0.0))
        v = F.when(v > 0.0031308, 1.055 * F.pow(v, 1 / 2.4) - 0.055).otherwise(12.92 * v)
        out.append(F.lpad(F.lower(F.hex(F.bround(F.least(v, F.lit(1.0)) * 255, 0).cast("int"))), 2, "0"))
    return F.concat(F.lit("#"), *out)


def _lab(rgb: tuple[int, int, int], matrix: tuple = SRGB_7) -> tuple[float, float, float]:
    line = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in rgb]
    t = [sum(m * c for m, c in zip(row, line)) / w for row, w in zip(matrix, WHITE)]
    f = [math.cbrt(v) if v > (6 / 29) ** 3 else v * (29 / 6) ** 2 / 3 + 4 / 29 for v in t]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def nearest_swatch(lab: Column, palette: dict[str, tuple[int, int, int]] | None = None) -> Column:
    """the swatch of least distance, the first of equals."""
    found = []
    for k, (name, rgb) in enumerate((palette or PALETTE).items()):
        ll, a, b = _lab(rgb)
        found.append(F.struct((F.pow(lab["L"] - ll, 2) + F.pow(lab["a"] - a, 2) + F.pow(lab["b"] - b, 2)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")))
    return F.array_min(F.array(*found))["name"]


def nearest_rgb(r: Column, g: Column, b: Column, palette: dict[str, tuple[int, int, int]] | None = None) -> Column:
    """the palette's name of least squared RGB distance, the first of equals."""
    found = [F.struct((F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, (x, y, z)) in enumerate((palette or PALETTE).items())]
    return F.array_min(F.array(*found))["name"]
