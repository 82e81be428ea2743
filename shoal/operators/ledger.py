"""History of uses: posts(slug, preset, created_at seconds, assets array<string>, output, duration)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "slug string, preset string, created_at double, assets array<string>, output string, duration double"
DAY = 86400.0


def uses(posts: DataFrame) -> DataFrame:
    return posts.select("slug", "preset", "created_at", F.explode("assets").alias("asset"))


def usage_counts(used: DataFrame) -> DataFrame:
    """Of ``uses``, or any table with a row per use: repeats within a post count."""
    return used.groupBy("asset").agg(F.count(F.lit(1)).alias("uses"))


def last_used(used: DataFrame) -> DataFrame:
    return used.groupBy("asset").agg(F.max("created_at").alias("last_used"))


def cooling(posts: DataFrame, days: float, now: Column) -> DataFrame:
    """Assets used within so many days, the limit included; none for ``days`` of 0 or less."""
    recent = posts.where((F.lit(days) > 0) & (F.col("created_at") >= now - days * DAY))
    return recent.select(F.explode("assets").alias("asset")).distinct()


def available(assets: DataFrame, blocked: DataFrame, path: str = "path", asset: str = "asset") -> DataFrame:
    return assets.join(blocked, assets[path] == blocked[asset], "left_anti")


def preset_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("preset").agg(F.count(F.lit(1)).alias("posts"))


def summary(posts: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """One row: all posts, those of the last seven days, distinct assets."""
    per_post = posts.agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("created_at") >= now - 7 * DAY).alias("posts_last_7_days"))
    return per_post.crossJoin(used.agg(F.count_distinct("asset").alias("distinct_assets")))  # one row each


def upsert(posts: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Rows of ``new`` replace those with their key."""
    return posts.join(new.select(key).distinct(), key, "left_anti").select(posts.columns).unionByName(new.select(posts.columns))


def recent(posts: DataFrame, limit: int, preset: str | None = None) -> DataFrame:
    chosen = posts if preset is None else posts.where(F.col("preset") == preset)
    return chosen.orderBy(F.desc("created_at"), "slug").limit(limit)
