"""Pixel values and scores, as column expressions over one pixel or over arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel means and deviations.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Stain vectors in optical density, rows haematoxylin, eosin, DAB.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def on_white(v: Column, alpha: Column) -> Column:
    """A channel composited on white, half to even."""
    return F.bround(v * alpha / 255.0 + (255.0 - alpha)).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h 0..179, s, v 0..255) of 8-bit channels, half to even."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (v - low).cast("double")
    deg = F.when(d == 0, 0.0).when(v == r, 60.0 * (g - b) / d).when(v == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    h = F.bround(F.when(deg < 0, deg + 360.0).otherwise(deg) / 2.0) % 180
    s = F.when(v == 0, 0.0).otherwise(F.bround(255.0 * d / v))
    return F.struct(h.cast("int").alias("h"), s.cast("int").alias("s"), v.cast("int").alias("v"))


def inverted_gray(r: Column, g: Column, b: Column) -> Column:
    return (255 - F.bround(0.299 * r + 0.587 * g + 0.114 * b)).cast("int")


def artifact(h: Column, s: Column, v: Column, sat_min: float = 0.35, value_min: float = 0.20, bands: tuple = ((0.70, 0.95), (0.0, 0.10))) -> Column:
    """Ink, saturated outside of the stain's hues, or near black."""
    hue = h / 180.0
    stain = F.lit(False)
    for lo, hi in bands:
        stain = stain | hue.between(lo, hi)
    return ((s / 255.0 > sat_min) & ~stain) | (v / 255.0 < value_min)


def normalised(v: Column, channel: int) -> Column:
    return (v / 255.0 - MEAN[channel]) / STD[channel]


def _inverse(m) -> list[list[float]]:
    """Of a 3 x 3 matrix, by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def stain_jitter(rgb: list[Column], scale: list[Column], shift: list[Column]) -> list[Column]:
    """Channels with each stain's density scaled and shifted, cut to whole numbers from 0 to 255.

    Densities are unmixed into stains, changed and mixed again; per pixel that is one affine map of the densities.
    """
    unmix = _inverse(STAINS)
    od = [-F.ln(F.greatest(v / 255.0, F.lit(1e-6))) for v in rgb]
    stains = [sum((od[i] * unmix[i][k] for i in range(1, 3)), od[0] * unmix[0][k]) * scale[k] + shift[k] for k in range(3)]
    out = [stains[0] * STAINS[0][j] + stains[1] * STAINS[1][j] + stains[2] * STAINS[2][j] for j in range(3)]
    return [F.floor(F.least(F.greatest(F.exp(-x) * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int") for x in out]


def gaussian(u: Column, v: Column, size: int, sigma: float, floor: float = 1e-3) -> Column:
    """The weight of cell (u, v) of a window: a Gaussian about the centre, and a floor."""
    c = (size - 1) / 2.0
    line = lambda x: F.exp(-F.pow(x - c, F.lit(2.0)) / (2.0 * sigma * sigma))
    return line(u) * line(v) + floor


def rot90(u: Column, v: Column, n: int, turns: Column, flip: Column) -> Column:
    """struct(u, v): where a cell goes under quarter turns, then a flip of u."""
    t = turns % 4
    a = F.when(t == 0, u).when(t == 1, v).when(t == 2, n - 1 - u).otherwise(n - 1 - v)
    b = F.when(t == 0, v).when(t == 1, n - 1 - u).when(t == 2, n - 1 - v).otherwise(u)
    return F.struct(F.when(flip, n - 1 - a).otherwise(a).alias("u"), b.alias("v"))


def soft_dice(inter: Column, p: Column, t: Column, smooth: float = 1.0) -> Column:
    return (2.0 * inter + smooth) / (p + t + smooth)


def bce(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Cross entropy of a logit, in the form that doesn't overflow."""
    soft = F.ln(1.0 + F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1.0 - target) * logit + (1.0 + (pos_weight - 1.0) * target) * soft


def focal(logit: Column, target: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = sigmoid(logit)
    pt = p * target + (1.0 - p) * (1.0 - target)
    return (alpha * target + (1.0 - alpha) * (1.0 - target)) * F.pow(1.0 - pt, F.lit(gamma)) * bce(logit, target)


def warmup_cosine(epoch: Column, warmup: int, total: int, least: float = 1e-6 / 3e-4) -> Column:
    progress = (epoch - warmup) / float(max(total - warmup, 1))
    return F.when(epoch < warmup, (epoch + 1) / float(max(warmup, 1))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
