"""Content tables of a website: opening hours, redirects, events, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import text

# Weekday (Monday 0), opening and closing time.
HOURS = [(0, "09:00", "21:00"), (1, "09:00", "21:00"), (2, "09:00", "21:00"), (3, "09:00", "22:00"), (4, "09:00", "22:00"), (5, "08:00", "22:00"), (6, "08:00", "20:00")]


def open_now(moments: DataFrame, hours: DataFrame, ts: str = "ts") -> DataFrame:
    """hours(day, open, close): is each moment within its weekday's half-open range?"""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    h = hours.select("day", text.clock_minutes(F.col("open")).alias("_open"), text.clock_minutes(F.col("close")).alias("_close"))
    out = moments.join(F.broadcast(h), F.weekday(ts) == F.col("day"), "left")  # seven rows
    return out.withColumn("open_now", F.coalesce((minutes >= F.col("_open")) & (minutes < F.col("_close")), F.lit(False))).drop("day", "_open", "_close")


def parse_redirects(lines: DataFrame) -> DataFrame:
    """``from to code`` lines (value, n) -> rule, source, prefix, target, code. Comments and blanks are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select("n", p.alias("p"))
    wild = F.col("p")[0].endswith("/*")
    return rows.select(F.col("n").alias("rule"), F.col("p")[0].alias("source"), F.when(wild, F.regexp_replace(F.col("p")[0], r"\*$", "")).alias("prefix"), F.col("p")[1].alias("target"), F.coalesce(F.try_element_at("p", F.lit(3)).try_cast("int"), F.lit(301)).alias("code"))


def redirect(requests: DataFrame, rules: DataFrame, path: str = "path", key: str = "request_id") -> DataFrame:
    """The first rule in file order that matches each path, exactly or by prefix.

    Exact rules are an equi-join. Prefix rules are joined on each of a path's leading folders, so that
    neither needs a nested loop.
    """
    exact = requests.join(rules.where("prefix is null"), F.col(path) == F.col("source")).select(key, "rule", "target", "code")
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    led = requests.select(key, F.explode(folders).alias("_lead")).join(rules.where("prefix is not null"), F.col("_lead") == F.col("prefix")).select(key, "rule", "target", "code")
    return exact.unionByName(led).groupBy(key).agg(F.min_by(F.struct("rule", "target", "code"), "rule").alias("m")).select(key, "m.*")


def published(events: DataFrame) -> DataFrame:
    """Missing counts as published; order 99 if missing."""
    return events.where(~F.col("published").eqNullSafe(F.lit(False))).withColumn("order", F.coalesce("order", F.lit(99))).orderBy("order", "title")


def featured(events: DataFrame) -> DataFrame:
    return published(events).where(F.coalesce("featured", F.lit(False)))


def announcement(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("enabled", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))


def active_nav(pages: DataFrame, nav: DataFrame) -> DataFrame:
    return pages.join(nav, "url", "left").withColumn("active", F.col("label").isNotNull())


def sitemap(pages: DataFrame, base: str) -> DataFrame:
    keep = pages.where(F.col("url").isNotNull() & ~F.coalesce("noindex", F.lit(False)))
    return keep.select(F.concat(F.lit("<url><loc>"), absolute(F.col("url"), base), F.lit("</loc></url>")).alias("value"))


def absolute(url: Column, base: str) -> Column:
    return F.when(url.rlike("^[a-z]+://"), url).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(url, F.lit("/"))))


def business_document(site: DataFrame, hours: DataFrame) -> DataFrame:
    """One nested JSON document: the site's fields and an entry per day."""
    days = hours.agg(F.array_sort(F.collect_list(F.struct("day", "open", "close"))).alias("openingHours"))
    return site.crossJoin(days).select(F.to_json(F.struct("*")).alias("document"))  # one row each


def loop_marks(rows: DataFrame, by: str, order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"index": F.row_number().over(w), "last": F.lead(order).over(w).isNull()})


def short_day(name: Column) -> Column:
    return F.left(name, F.lit(3))
