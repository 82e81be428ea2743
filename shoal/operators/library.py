"""The catalogue of assets: incremental refresh, eligibility, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions import text

SCHEMA = (
    "path string, kind string, fingerprint string, width int, height int, duration double, fps double, codec string, has_audio boolean, bytes bigint, mtime double, created string, source string, "
    "palette struct<swatches:array<struct<hex:string,rgb:array<int>,weight:double>>,brightness:double,contrast:double,saturation:double,colorfulness:double,warmth:double,hue_spread:double>, "
    "focus struct<x:double,y:double,confidence:double>, quality double, error string"
)


def usable(error: Column, width: Column, height: Column) -> Column:
    return error.isNull() & (width > 0) & (height > 0)


def derived(assets: DataFrame) -> DataFrame:
    p, w, h = F.col("path"), F.col("width"), F.col("height")
    return assets.withColumns({
        "name": text.name(p), "folder": text.folder(p), "aspect": F.coalesce(F.try_divide(w, h), F.lit(0.0)), "is_vertical": h > w,
        "usable": F.coalesce(usable(F.col("error"), w, h), F.lit(False)),
        "dominant": F.coalesce(F.try_element_at("palette.swatches", F.lit(1))["rgb"], F.array(F.lit(128), F.lit(128), F.lit(128))),
    })


def refresh_plan(found: DataFrame, cached: DataFrame) -> DataFrame:
    """Candidates (path, bytes, mtime) against the cached index -> state: unchanged, changed or new.

    Cached rows of files that weren't found are not in the result, so the index becomes what was found.
    """
    c = cached.select(F.col("path").alias("_path"), F.col("bytes").alias("_bytes"), F.col("mtime").alias("_mtime"), F.col("fingerprint").alias("_print"))
    same = (F.col("bytes") == F.col("_bytes")) & (F.abs(F.col("mtime") - F.col("_mtime")) <= 1.0) & (F.coalesce("_print", F.lit("")) != "")
    state = F.when(F.col("_path").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return found.join(c, F.col("path") == F.col("_path"), "left").select(found["*"], state.alias("state"))


def refresh(found: DataFrame, cached: DataFrame, analyse) -> DataFrame:
    """Cached rows of unchanged files and ``analyse`` of all others; errors are rows, not failures."""
    plan = refresh_plan(found, cached)
    kept = cached.join(plan.where("state = 'unchanged'").select("path"), "path", "left_semi").select(cached.columns)
    return kept.unionByName(analyse(plan.where("state <> 'unchanged'").drop("state")).select(cached.columns))


def eligible(assets: DataFrame, blocked: DataFrame | None = None, min_quality: float = 0.35, min_pixels: int = 500_000, allow_video: bool = True) -> DataFrame:
    video = F.col("kind") == "video"
    ok = usable(F.col("error"), F.col("width"), F.col("height")) & (~video | (F.lit(allow_video) & (F.col("duration") >= 1.0)))
    out = assets.where(ok & (F.col("width") * F.col("height") >= min_pixels) & (F.col("quality") >= min_quality))
    return out if blocked is None else out.join(blocked.select(F.col("asset").alias("path")), "path", "left_anti").select(assets.columns)


def stats(assets: DataFrame) -> DataFrame:
    """One pass, grouping sets: all, by kind, by source."""
    ok = F.coalesce(usable(F.col("error"), F.col("width"), F.col("height")), F.lit(False))
    return assets.withColumn("_ok", ok).groupingSets([[F.col("kind")], [F.col("source")], []], "kind", "source").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("usable"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("_ok") & (F.col("height") > F.col("width"))).alias("vertical"),
        F.coalesce(F.bround(F.sum(F.when(F.col("_ok") & (F.col("kind") == "video"), F.col("duration"))), 1), F.lit(0.0)).alias("footage_seconds"),
    )


def failure_breakdown(assets: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Failures by suffix, most first; with ``advice`` (suffix, advice) the remedy or a general one."""
    out = assets.where("error is not null").groupBy(F.coalesce(F.nullif(text.suffix(F.col("path")), F.lit("")), F.lit("(none)")).alias("suffix"))
    out = out.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("_first"))
    if advice is not None:
        out = out.join(advice, "suffix", "left").withColumn("advice", F.coalesce("advice", F.lit("could not be decoded")))
    return out.orderBy(F.desc("n"), "_first").drop("_first")
