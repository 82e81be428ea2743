"""Time series: framing, band energies, onset envelope, tempo, phase; and crop windows on grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import numbers

RATE, HOP, FRAME, BANDS = 22050, 512, 1024, 8
SIGMA_WEAK, SIGMA_STRONG, COLOUR = 0.28, 0.75, 0.35


def smooth(df: DataFrame, by: str, order: str, value: str, radius: int = 3) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn(value, F.avg(value).over(w))


def flux(df: DataFrame, by: str, band: str, order: str, value: str) -> DataFrame:
    """The summed rise over all bands from each step to the next; the first step has none."""
    w = Window.partitionBy(by, band).orderBy(order)
    rise = df.select(by, order, F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(w)).alias("rise"), F.lag(value).over(w).isNotNull().alias("ok"))
    return rise.where("ok").groupBy(by, order).agg(F.sum("rise").alias("flux"))


def normalize(df: DataFrame, by: str, value: str) -> DataFrame:
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.when(high - low <= 1e-9, 0.0).otherwise((F.col(value) - low) / (high - low)))


def frames(samples: DataFrame, track: str = "track", n: str = "n", value: str = "value", hop: int = HOP, size: int = FRAME) -> DataFrame:
    """(track, frame, values) of the overlapping frames that are whole."""
    last = F.floor(F.col(n) / hop).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col(n) - size + 1) / hop).cast("int"))
    placed = samples.select(track, n, value, F.explode(F.sequence(first, last)).alias("frame"))
    grouped = placed.groupBy(track, "frame").agg(F.array_sort(F.collect_list(F.struct(n, value))).alias("v"))  # ``size`` samples each
    return grouped.where(F.size("v") == size).select(track, "frame", F.transform("v", lambda x: x[value]).alias("values"))


def goertzel(frame: np.ndarray, k: float) -> float:
    """Energy at one frequency bin, by the second-order recurrence."""
    c, a, b = 2 * math.cos(2 * math.pi * k / len(frame)), 0.0, 0.0
    for x in frame:
        a, b = x + c * a - b, a
    return (a * a + b * b - c * a * b) / len(frame)


def band_energies(rows: DataFrame, rate: int = RATE, bands: int = BANDS, track: str = "track") -> DataFrame:
    """frames -> (track, frame, band, energy): log energy at geometrically spaced centres, 0 beyond half the rate."""

    def run(batches):
        for pdf in batches:
            out = []
            for t, frame, values in pdf.itertuples(index=False):
                x = np.asarray(values, float)
                x = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / (len(x) - 1)))
                for b in range(bands):
                    centre = 40.0 * 2.4 ** (b + 0.5)
                    if centre >= rate / 2:
                        out.append((t, frame, b, 0.0))
                        continue
                    z = np.exp(-2j * np.pi * centre / rate * np.arange(len(x)))
                    out.append((t, frame, b, float(np.log1p(1000.0 * abs(x @ z) ** 2 / len(x)))))
            yield pd.DataFrame(out, columns=[track, "frame", "band", "energy"])

    slim = rows.select(track, "frame", "values")
    return slim.mapInPandas(run, f"{track} {slim.schema[track].dataType.simpleString()}, frame int, band int, energy double")


def onset_envelope(samples: DataFrame, track: str = "track") -> DataFrame:
    """(track, i, value): how much begins at each frame, smoothed and scaled to 0 to 1. Under four frames: none."""
    f = frames(samples, track)
    e = flux(band_energies(f, track=track), track, "band", "frame", "energy")
    e = e.select(track, (F.col("frame") - 1).alias("i"), F.col("flux").alias("value"))
    enough = e.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(track))).where("_n >= 3").drop("_n")
    return normalize(smooth(enough, track, "i", "value"), track, "value")


def autocorrelation(env: DataFrame, by: str, order: str, value: str, low: int, high: int) -> DataFrame:
    """(by, lag, raw, score): mean-centred products per lag; ``score`` adds half the double and a quarter of the triple lag."""
    w = Window.partitionBy(by)
    x = env.select(by, F.col(order).alias("i"), (F.col(value) - F.avg(value).over(w)).alias("x"))
    lagged = x.select(by, F.col("x").alias("y"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"), F.col("i").alias("j")).withColumn("i", F.col("j") - F.col("lag"))
    raw = x.join(lagged, [by, "i"]).groupBy(by, "lag").agg((F.sum(F.col("x") * F.col("y")) / F.count(F.lit(1))).alias("raw"))
    more = raw
    for k in (2, 3):
        own = raw.select(F.col(by).alias("_by"), F.col("lag").alias("_lag"), F.col("raw").alias(f"raw{k}"))
        more = more.join(own, (F.col(by) == F.col("_by")) & (F.col("lag") * k == F.col("_lag")), "left").drop("_by", "_lag")
    return more.withColumn("score", F.col("raw") + 0.5 * F.coalesce("raw2", F.lit(0.0)) + 0.25 * F.coalesce("raw3", F.lit(0.0))).select(by, "lag", "raw", "score")


def tempo(acf: DataFrame, by: str, per_second: float) -> DataFrame:
    """(by, lag, bpm, confidence): the best lag (the smallest of equals), refined by a parabola through its neighbours."""
    w = Window.partitionBy(by).orderBy("lag")
    a = acf.withColumns({"left": F.lag("raw").over(w), "right": F.lead("raw").over(w)})
    best = a.groupBy(by).agg(F.max_by(F.struct("lag", "raw", "left", "right", "score"), F.struct("score", -F.col("lag"))).alias("b"), F.avg(F.abs("score")).alias("mean"))
    bend = F.col("b.left") - 2 * F.col("b.raw") + F.col("b.right")
    shift = F.coalesce(F.when(bend < 0, numbers.clamp(0.5 * F.try_divide(F.col("b.left") - F.col("b.right"), bend), -0.5, 0.5)), F.lit(0.0))
    bpm = numbers.fold_tempo(60.0 * per_second / (F.col("b.lag") + shift))
    return best.select(by, F.col("b.lag").alias("lag"), bpm.alias("bpm"), numbers.clamp(F.coalesce(F.try_divide(F.col("b.score"), F.col("mean")) - 1, F.lit(0.0)) / 3).alias("confidence"))


def phase(env: DataFrame, by: str, order: str, value: str, period: Column, steps: Column, length: Column) -> DataFrame:
    """(by, step, offset, mean): the phase whose beats meet the highest mean envelope; the smallest of equals.

    ``period`` (in rows), ``steps`` and ``length`` are columns of ``env`` that are one value per ``by``.
    """
    grid = env.groupBy(by).agg(F.first(period).alias("period"), F.first(steps).alias("steps"), F.first(length).alias("n"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("step")).withColumn("offset", F.col("step") * F.col("period") / F.col("steps"))
    grid = grid.select(by, "step", "offset", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1 - F.col("offset")) / F.col("period")).cast("int"))).alias("k"), "period")
    at = grid.select(F.col(by).alias("_by"), "step", "offset", F.floor(F.col("offset") + F.col("k") * F.col("period")).cast("long").alias("_i"))
    means = at.join(env, (F.col("_by") == F.col(by)) & (F.col("_i") == F.col(order))).groupBy(by, "step").agg(F.first("offset").alias("offset"), F.avg(value).alias("mean"))
    return means.groupBy(by).agg(F.max_by(F.struct("step", "offset", "mean"), F.struct("mean", -F.col("step"))).alias("b")).select(by, "b.*")


def interest(pixels: DataFrame, frame: list[str], luma: str = "luma", saturation: str = "saturation") -> DataFrame:
    """Per pixel: differences to the right and below (none at the edge) and saturation."""
    right = F.lead(luma).over(Window.partitionBy(*frame, "row").orderBy("col"))
    below = F.lead(luma).over(Window.partitionBy(*frame, "col").orderBy("row"))
    return pixels.withColumn("interest", F.abs(F.col(luma) - F.coalesce(right, F.col(luma))) + F.abs(F.col(luma) - F.coalesce(below, F.col(luma))) + COLOUR * 255.0 * F.col(saturation))


def profiles(pixels: DataFrame, frame: list[str], value: str = "interest") -> DataFrame:
    """Column and row totals in one pass: exactly one of row and col is null."""
    cols = [F.col(c) for c in frame]
    return pixels.groupingSets([[*cols, F.col("col")], [*cols, F.col("row")]], *cols, "col", "row").agg(F.sum(value).alias("total"))


def best_window(profile: DataFrame, by: str, order: str, value: str, window: int) -> DataFrame:
    """(by, centre, confidence): the best place of a window along a profile, drawn to the middle the less sure it is.

    A window as long as the profile, or no evidence at all, gives the middle.
    """
    w = Window.partitionBy(by).orderBy(order)
    p = profile.withColumns({"_s": F.sum(value).over(w.rowsBetween(0, window - 1)), "_k": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(by))})
    p = p.where((F.col("_k") + window <= F.col("_n")) & (window > 0))
    stats = Window.partitionBy(by)
    conf = numbers.clamp(F.coalesce(F.try_divide(F.max("_s").over(stats), F.avg("_s").over(stats)) - 1, F.lit(0.0)))
    p = p.withColumn("_c", F.when(F.avg("_s").over(stats) > 0, conf).otherwise(0.0))
    sigma = SIGMA_WEAK + (SIGMA_STRONG - SIGMA_WEAK) * F.col("_c")
    centre = (F.col("_k") + window / 2.0) / F.col("_n")
    biased = F.col("_s") * F.exp(-F.pow(centre - 0.5, F.lit(2)) / (2 * sigma * sigma))
    best = p.groupBy(by).agg(F.max_by(centre, F.struct(biased, -F.col("_k"))).alias("centre"), F.max("_c").alias("confidence"), F.max("_n").alias("_n"))
    none = (F.col("confidence") <= 0) | (F.col("_n") <= window)
    return best.select(by, F.when(none, 0.5).otherwise(F.col("centre")).alias("centre"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"))


def focus(points: DataFrame, by: str, x: Column, y: Column, confidence: Column) -> DataFrame:
    """Confidence-weighted mean of the frames' centres; the middle and 0 where there is no weight."""
    c = F.sum(confidence)
    return points.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(x * confidence), c), F.lit(0.5)).alias("x"), F.coalesce(F.try_divide(F.sum(y * confidence), c), F.lit(0.5)).alias("y"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"))


def crop_position(x: Column, y: Column, confidence: Column, width: Column, height: Column, target: float, gate: float = 0.12) -> Column:
    """struct(axis, fraction) of the slack to cut before the window, or null if nothing is to be moved."""
    aspect = width / height
    share = F.when(aspect > target, target / aspect).otherwise(aspect / target)
    at = F.when(aspect > target, x).otherwise(y)
    fraction = numbers.clamp(F.try_divide(at - share / 2, 1 - share))
    moved = (confidence >= gate) & (F.abs(aspect - target) > 1e-6)
    return F.when(moved, F.struct(F.when(aspect > target, "x").otherwise("y").alias("axis"), fraction.alias("fraction")))


def crop_offset(fraction: Column, source: Column, window: Column) -> Column:
    """Where a window of so many pixels starts when its centre is at a fraction of the source."""
    return F.greatest(F.lit(0.0), F.least(source - window, F.bround(fraction * source - window / 2))).cast("int")


def frame_focus(profile: DataFrame, by: str, width: int, height: int, target: float) -> DataFrame:
    """(by, x, y, confidence) from ``profiles``: the axis with slack gets the best window, the other the middle."""
    wide = width / height > target
    axis, n = ("col", width) if wide else ("row", height)
    window = max(1, round(height * target if wide else width / target))
    best = best_window(profile.where(F.col(axis).isNotNull()), by, axis, "total", min(window, n))
    middle = F.lit(0.5)
    return best.select(by, (F.col("centre") if wide else middle).alias("x"), (middle if wide else F.col("centre")).alias("y"), "confidence")


def colour_stats(pixels: DataFrame, by: list[str], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """One aggregation: brightness, contrast, saturation, colourfulness, warmth."""
    red, green, blue = F.col(r), F.col(g), F.col(b)
    rg, yb, luma = red - green, 0.5 * (red + green) - blue, numbers.luminance(red, green, blue)
    top = F.greatest(red, green, blue)
    sat = F.coalesce(F.try_divide(top - F.least(red, green, blue), top), F.lit(0.0))
    return pixels.groupBy(*by).agg(
        F.avg(luma).alias("brightness"), F.least(F.lit(1.0), 2.5 * F.stddev_pop(luma)).alias("contrast"), F.avg(sat).alias("saturation"),
        F.least(F.lit(1.0), (F.hypot(F.stddev_pop(rg), F.stddev_pop(yb)) + 0.3 * F.hypot(F.avg(rg), F.avg(yb))) / 150.0).alias("colorfulness"),
        numbers.clamp(F.avg((red - blue) / 255.0), -1, 1).alias("warmth"),
    )


def kmeans(rgb: np.ndarray, k: int = 5, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's clustering of colours -> (rounded centres, weights), heaviest first.

    Seeds: the least colour in lexicographic order, then always the colour farthest from all seeds; ties
    of distance go to the first. Clusters that end empty are dropped.
    """
    x = np.asarray(rgb, float)
    distinct = np.unique(x, axis=0)
    seeds = [distinct[0]]
    while len(seeds) < min(k, len(distinct)):
        seeds.append(distinct[np.min([((distinct - s) ** 2).sum(axis=1) for s in seeds], axis=0).argmax()])
    centre = np.array(seeds)
    for _ in range(rounds):
        own = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        if np.allclose(new, centre):
            break
        centre = new
    own = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    weight = np.bincount(own, minlength=len(centre)) / len(x)
    order = [c for c in np.argsort(-weight, kind="stable") if weight[c] > 0]
    return np.rint(centre[order]).astype(int), weight[order]


def palettes(pixels: DataFrame, by: str, k: int = 5, rounds: int = 12) -> DataFrame:
    """(by, place, r, g, b, weight): each group's clusters. A group is one thumbnail's pixels, a fixed number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, weight = kmeans(pdf[["r", "g", "b"]].to_numpy(), k, rounds)
        return pd.DataFrame({by: pdf[by].iloc[0], "place": range(1, len(weight) + 1), "r": centre[:, 0], "g": centre[:, 1], "b": centre[:, 2], "weight": weight})

    kind = pixels.schema[by].dataType.simpleString()
    return pixels.select(by, "r", "g", "b").groupBy(by).applyInPandas(run, f"{by} {kind}, place int, r int, g int, b int, weight double")
