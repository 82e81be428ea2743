"""Scoring against profiles, and ordered diverse selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import numbers, text
from shoal.session import cut

NEAR_DUPLICATE = 0.90
PARTS = ["palette", "brightness", "saturation", "contrast", "warmth", "hue_spread", "quality", "vertical"]
TOLERANCE = {"brightness": 0.42, "saturation": 0.45, "contrast": 0.5, "warmth": 0.6, "hue_spread": 0.6}


def lab_of(hex_codes: Column) -> Column:
    def one(code):
        rgb = numbers.hex_to_rgb(code)
        return numbers.lab(rgb[0], rgb[1], rgb[2])

    return F.transform(hex_codes, one)


def parts(palette_distance: Column, vertical: Column) -> dict[str, Column]:
    """Of columns a.<feature> against p.<target>."""
    out = {"palette": F.pow(numbers.clamp(1 - palette_distance / 40.0), F.lit(1.3))}
    out |= {k: numbers.closeness(F.col(f"a.{k}"), F.col(f"p.{k}"), tol) for k, tol in TOLERANCE.items()}
    return out | {"quality": F.col("a.quality"), "vertical": vertical}


def score(assets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every asset against every profile (a broadcast dimension of a fixed number of rows).

    assets: path, width, height, quality, brightness, saturation, contrast, warmth, hue_spread, labs
    array<array<double>>, swatch_weights array<double>.
    """
    dim = profiles.select("*", lab_of(F.col("palette_hex")).alias("target_labs"))
    pairs = assets.withColumn("_plain", text.plain(F.col("path"))).alias("a").join(F.broadcast(dim).alias("p"))
    distance = numbers.nearest_mean(F.col("a.labs"), F.col("a.swatch_weights"), F.col("p.target_labs"), 40.0)
    vertical = F.when(F.col("a.height") > F.col("a.width"), 1.0).when(F.coalesce(F.try_divide("a.width", "a.height"), F.lit(0.0)) <= 1.05, 0.55).otherwise(0.3)
    part = parts(distance, vertical)
    total = sum((F.col("p.weights")[k] * part[k] for k in PARTS), F.lit(0.0))
    weight = sum((F.col("p.weights")[k] for k in PARTS), F.lit(0.0))
    bonus = text.keyword_bonus(F.col("a._plain"), F.col("p.keywords"))
    return pairs.select(F.col("p.key").alias("preset"), *[F.col(f"a.{c}") for c in assets.columns], numbers.clamp(F.try_divide(total, weight) + 0.06 * bonus).alias("score"), F.create_map(*[x for k in PARTS for x in (F.lit(k), part[k])]).alias("parts"))


def top_k(scored: DataFrame, k: int, by: str = "preset", path: str = "path") -> DataFrame:
    """The k best of each group; ties by path. Spark turns the rank filter into a group limit before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), path)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity(a: str, b: str) -> Column:
    """How alike pair columns a.*, b.* are; not symmetric. Columns: labs, folder, mtime, stem."""
    near = numbers.nearest_mean(F.slice(F.col(f"{a}.labs"), 1, 3), None, F.slice(F.col(f"{b}.labs"), 1, 3), 30.0)
    burst = (F.abs(F.col(f"{a}.mtime") - F.col(f"{b}.mtime")) < 60) & (F.col(f"{a}.mtime") > 0)
    return numbers.clamp(
        0.7 * numbers.clamp(1 - near / 30.0) + F.when(F.col(f"{a}.folder") == F.col(f"{b}.folder"), 0.18).otherwise(0.0)
        + F.when(burst, 0.22).otherwise(0.0) + F.when(text.shared_stem(F.col(f"{a}.stem"), F.col(f"{b}.stem")), 0.15).otherwise(0.0)
    )


def video_target(count: int, ratio: float) -> int:
    return round(count * min(1.0, max(0.0, ratio)))


def greedy_diverse(scored: DataFrame, count: int, diversity: float = 0.55, ratio: float = 0.35, by: str = "preset") -> DataFrame:
    """Ordered selection of ``count`` per group: score less a penalty for likeness to what is chosen.

    The loop runs on all groups in step: each step keeps a running maximum of likeness per candidate, so
    it does count * n comparisons, not count^2 * n. A step is an aggregate with map-side combining and a
    join with one row per group; its result is checkpointed, so that plans stay short.
    """
    target = video_target(count, ratio)
    keep = [by, "path", "labs", "folder", "mtime", "stem", "kind", "score"]
    base = cut(scored.select(*keep, F.lit(0.0).alias("worst"), F.lit(0).alias("taken"), F.lit(0).alias("videos")))
    chosen = []
    for step in range(count):
        needed = F.greatest(F.lit(0), F.lit(target) - F.col("videos"))
        slots = count - step
        nudge = F.when(F.col("kind") == "video", 0.12 * numbers.clamp(needed / slots)).when(needed >= slots, -0.10).otherwise(0.0)
        value = F.col("score") - numbers.diversity_penalty(F.col("worst"), diversity) + nudge
        key = F.struct(F.when(F.col("worst") < NEAR_DUPLICATE, 0).otherwise(1).alias("f"), (-value).alias("v"), (-F.col("score")).alias("s"), F.col("path").alias("p"))
        best = base.where("taken = 0").groupBy(by).agg(F.min_by(F.struct(*keep[1:]), key).alias("pick")).select(by, "pick.*")
        best = cut(best)
        chosen.append(best.select(by, F.lit(step + 1).alias("place"), "path", "score"))
        if step + 1 < count:
            joined = base.alias("x").join(best.alias("y"), F.col(f"x.{by}") == F.col(f"y.{by}"))
            base = cut(joined.select(
                *[F.col(f"x.{c}") for c in keep],
                F.greatest(F.col("x.worst"), similarity("x", "y")).alias("worst"),
                F.when(F.col("x.path") == F.col("y.path"), 1).otherwise(F.col("x.taken")).alias("taken"),
                (F.col("x.videos") + F.when(F.col("y.kind") == "video", 1).otherwise(0)).alias("videos"),
            ))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def weave(selection: DataFrame, by: str, energy: str, score: str, path: str = "path") -> DataFrame:
    """Loudest first, next loudest last, between them quiet ones rising and loud ones falling in turn."""
    w = Window.partitionBy(by)
    ranked = selection.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(energy), F.desc(score), path)), "_n": F.count(F.lit(1)).over(w)})
    m = F.col("_n") - 2
    loud, j = F.floor(m / 2), F.col("_r") - 3
    place = F.when(F.col("_n") <= 2, F.col("_r")).when(F.col("_r") == 1, 1).when(F.col("_r") == 2, F.col("_n")).when(j < loud, 3 + 2 * j).otherwise(2 + 2 * (m - 1 - j))
    return ranked.withColumn("place", place.cast("long")).drop("_r", "_n")


def summarize(selection: DataFrame, by: str = "preset") -> DataFrame:
    return selection.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("kind") != "video").alias("photos"),
        F.bround(F.avg("score"), 4).alias("mean_score"), F.bround(F.min("score"), 4).alias("min_score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )


def warnings(summary: DataFrame, count: int) -> DataFrame:
    found = F.array(F.when(F.col("n") < count, "too few"), F.when((F.col("mean_score") > 0) & (F.col("mean_score") < 0.42), "weak match"))
    return summary.withColumn("warnings", F.array_compact(found))

