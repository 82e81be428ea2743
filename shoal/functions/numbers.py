"""Column expressions on numbers and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ for D65, and its white point.
XYZ = [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]
WHITE = [0.95047, 1.00000, 1.08883]


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def closeness(value: Column, target: Column, tolerance: float) -> Column:
    if tolerance <= 0:
        return (value == target).cast("double")
    return clamp(1 - F.abs(value - target) / tolerance)


def linear(channel: Column) -> Column:
    return F.when(channel <= 0.04045, channel / 12.92).otherwise(F.pow((channel + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> Column:
    """sRGB of 0 to 255 -> array of L, a, b."""
    rgb = [linear(c / 255.0) for c in (r, g, b)]
    f = []
    for row, white in zip(XYZ, WHITE, strict=True):
        t = (rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]) / white
        f.append(F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116))
    return F.array(116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2]))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def delta_e(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """RGB of 0 to 1 -> struct of hue in degrees, saturation, value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sector = F.when(d == 0, F.lit(0.0)).when(r == top, F.pmod(F.try_divide(g - b, d), F.lit(6.0)))
    sector = sector.when(g == top, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    return F.struct((sector * 60).alias("h"), F.coalesce(F.try_divide(d, top), F.lit(0.0)).alias("s"), top.alias("v"))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def hue_spread(hues: Column) -> Column:
    """The widest circular distance of two hues, as a share of half the circle; 0 for fewer than two."""
    widest = F.array_max(F.flatten(F.transform(hues, lambda a: F.transform(hues, lambda b: hue_distance(a, b)))))
    return F.when(F.size(hues) < 2, 0.0).otherwise(widest / 180.0)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0


def lerp(a: Column, b: Column, t: float) -> Column:
    return a + (b - a) * t


def blend(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: lerp(x, y, t))


def hex_to_rgb(code: Column) -> Column:
    h = F.ltrim(code, F.lit("#"))
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.array(*[F.conv(F.substring(h, k, 2), 16, 10).cast("int") for k in (1, 3, 5)])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(clamp(F.bround(c), 0, 255).cast("long")), 2, "0")) for c in (r, g, b)])


def nearest_mean(own: Column, weights: Column | None, targets: Column, empty: float) -> Column:
    """The (weighted) mean over ``own`` of the distance to the nearest target; ``empty`` if either is."""
    near = F.transform(own, lambda a: F.array_min(F.transform(targets, lambda t: delta_e(a, t))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if weights is None:
        mean = F.try_divide(total(near), F.size(own).cast("double"))
    else:
        mean = F.try_divide(total(F.zip_with(near, weights, lambda d, w: d * w)), total(weights))
    return F.when((F.size(own) > 0) & (F.size(targets) > 0), F.coalesce(mean, F.lit(float(empty)))).otherwise(float(empty))


def fold_tempo(bpm: Column) -> Column:
    """Doubled or halved into 78 to 165, then held within 60 to 180."""
    up = F.when((bpm > 0) & (bpm < 78), bpm * F.pow(F.lit(2.0), F.ceil(F.log2(78 / bpm)))).otherwise(bpm)
    down = F.when(up > 165, up / F.pow(F.lit(2.0), F.ceil(F.log2(up / 165)))).otherwise(up)
    return clamp(down, 60, 180)


def quality(w: Column, h: Column, brightness: Column, contrast: Column, is_video: Column, duration: Column) -> Column:
    """Resolution, crop, exposure and flatness, from 0 to 1; short clips count less."""
    area, aspect = (w * h).cast("double"), F.try_divide(w.cast("double"), h)
    res = F.least(F.lit(1.0), area / 2073600) * F.when(area < 700000, 0.55).otherwise(1.0)
    crop = F.when(aspect <= 9 / 16, 1.0).otherwise(F.greatest(F.lit(0.30), F.pow((9 / 16) / aspect, F.lit(0.45))))
    exposure = (1 - 0.6 * F.least(F.lit(1.0), F.abs(brightness - 0.52) / 0.52)) * F.when((brightness < 0.06) | (brightness > 0.96), 0.3).otherwise(1.0)
    flat = F.when(contrast > 0.08, 1.0).otherwise(0.45)
    length = F.when(~is_video, 1.0).when(duration < 1.2, 0.4).when(duration < 2.5, 0.8).otherwise(1.0)
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(clamp((0.4 * res + 0.2 * crop + 0.25 * exposure + 0.15 * flat) * length))


def energy(colourfulness: Column, contrast: Column, brightness: Column, is_video: Column) -> Column:
    centred = 1 - F.least(F.lit(1.0), 2 * F.abs(brightness - 0.5))
    return clamp(0.40 * colourfulness + 0.38 * contrast + 0.12 * centred + F.when(is_video, 0.10).otherwise(0.0))


def diversity_penalty(worst: Column, diversity: float) -> Column:
    return min(1.0, max(0.0, diversity)) * F.greatest(F.lit(0.0), worst - 0.45) / 0.55 * 0.60
