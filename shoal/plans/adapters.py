"""The driver's tables as the engine's: assets, posts, paths, hourly envelopes, boards. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.plans import profiles

FOLDERS = ["Envato Elements", "pexels", "DCIM/Camera", "Library/x", ".cache", "misc", "adobestock", "photos library"]
ENDINGS = [".JPG", ".mov", ".txt", ".mp3", "", ".heic", ".webm", ".avif", ".png"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> page_id, path, bytes."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("."), F.lit(1))
    mark = F.when(i % 13 == 0, "_Thumb").when(i % 17 == 0, "_LR").otherwise("")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    path = F.concat(F.lit("/media/"), pick(FOLDERS), F.lit("/"), host, mark, F.lit("_"), i.cast("string"), pick(ENDINGS))
    return p.select("page_id", path.alias("path"), F.length("html").cast("long").alias("bytes"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PATHS = f"""paths AS (SELECT page_id, '/media/' || list_extract({_list(FOLDERS)}, 1 + page_id % {len(FOLDERS)}) || '/' || split_part(split_part(url, '//', 2), '.', 1)
    || CASE WHEN page_id % 13 = 0 THEN '_Thumb' WHEN page_id % 17 = 0 THEN '_LR' ELSE '' END || '_' || page_id || list_extract({_list(ENDINGS)}, 1 + page_id % {len(ENDINGS)}) AS path,
    length(html)::BIGINT AS bytes FROM pages)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> assets with features."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    labs = F.array(*[F.array((s * 2 - j * 9).cast("double"), (k * (j + 3) % 41 - 20).cast("double"), (k * (j + 5) % 37 - 18).cast("double")) for j in range(3)])
    return p.select(
        k.alias("id"), F.concat(F.lit("lib/"), F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), k.cast("string")).alias("path"),
        F.when(k % 4 == 0, "video").otherwise("image").alias("kind"), (600 + s * 30).cast("int").alias("width"), (700 + k % 7 * 200).cast("int").alias("height"),
        F.when(k % 4 == 0, k % 10 * 0.9).otherwise(0.0).alias("duration"), (k % 97 / 96.0).alias("quality"), (s / 50.0).alias("brightness"),
        (k % 11 / 10.0).alias("saturation"), (k % 13 / 12.0).alias("contrast"), (k % 9 / 8.0 - 0.5).alias("warmth"), (k % 5 / 4.0).alias("hue_spread"), labs.alias("labs"),
        F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("swatch_weights"), F.lower("p_type").alias("source"), (k * 37.0).alias("mtime"),
        F.when(k % 29 == 0, "decode").alias("error"), F.concat(F.lit("lib/"), F.lower("p_type")).alias("folder"), F.concat(F.translate("p_name", " ", "_"), F.lit("_"), k.cast("string")).alias("stem"),
    )


ASSETS = """assets AS (SELECT p_partkey AS id, 'lib/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey AS path,
    CASE WHEN p_partkey % 4 = 0 THEN 'video' ELSE 'image' END AS kind, 600 + p_size * 30 AS width, 700 + p_partkey % 7 * 200 AS height,
    CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 10)::DOUBLE * 0.9::DOUBLE ELSE 0.0::DOUBLE END AS duration, (p_partkey % 97)::DOUBLE / 96 AS quality, p_size::DOUBLE / 50 AS brightness,
    (p_partkey % 11)::DOUBLE / 10 AS saturation, (p_partkey % 13)::DOUBLE / 12 AS contrast, (p_partkey % 9)::DOUBLE / 8 - 0.5::DOUBLE AS warmth, (p_partkey % 5)::DOUBLE / 4 AS hue_spread,
    [[(p_size * 2 - 0)::DOUBLE, (p_partkey * 3 % 41 - 20)::DOUBLE, (p_partkey * 5 % 37 - 18)::DOUBLE], [(p_size * 2 - 9)::DOUBLE, (p_partkey * 4 % 41 - 20)::DOUBLE, (p_partkey * 6 % 37 - 18)::DOUBLE],
     [(p_size * 2 - 18)::DOUBLE, (p_partkey * 5 % 41 - 20)::DOUBLE, (p_partkey * 7 % 37 - 18)::DOUBLE]] AS labs, lower(p_type) AS source,
    CASE WHEN p_partkey % 29 = 0 THEN 'decode' END AS error FROM part)"""


def now(orders: DataFrame) -> Column:
    """The latest order's time in seconds, as a scalar subquery."""
    return orders.agg(F.max(seconds(F.col("o_orderdate")))).scalar()


def seconds(ts: Column) -> Column:
    """Epoch seconds of a time without zone."""
    return F.unix_date(F.to_date(ts)).cast("double") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> posts without their assets, which are the lines: see ``uses``."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("preset"), seconds(F.col("o_orderdate")).alias("created_at"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line: asset, created_at."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    used = li.select("l_orderkey", F.col("l_partkey").cast("string").alias("asset"))
    return used.join(o.select("o_orderkey", seconds(F.col("o_orderdate")).alias("created_at")), F.col("l_orderkey") == F.col("o_orderkey")).select("asset", "created_at")


USES = "uses AS (SELECT o_orderkey::VARCHAR AS slug, o_orderpriority AS preset, epoch(o_orderdate)::DOUBLE AS created_at, l_partkey::VARCHAR AS asset FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> event_type, i (hour since the first), value (summed), every hour of every type."""
    e = table(spark, sf_dir, "events").withColumn("h", F.unix_date(F.to_date("ts")) * 24 + F.hour("ts"))
    span = e.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = e.select("event_type").distinct().join(F.broadcast(span)).select("event_type", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))  # one row
    sums = e.groupBy("event_type", "h").agg(F.sum("value").alias("value"))
    return grid.join(sums, ["event_type", "h"], "left").select("event_type", (F.col("h") - F.col("lo")).alias("i"), F.coalesce("value", F.lit(0.0)).alias("value"))


HOURLY = """e AS (SELECT event_type, value, (epoch_us(ts) // 3600000000)::INT AS h FROM events),
    span AS (SELECT min(h) AS lo, max(h) AS hi FROM e), types AS (SELECT DISTINCT event_type FROM e),
    grid AS (SELECT event_type, lo, unnest(range(lo, hi + 1))::INT AS h FROM types, span),
    hourly AS (SELECT g.event_type, g.h - g.lo AS i, coalesce(s.value, 0.0::DOUBLE) AS value FROM grid g LEFT JOIN (SELECT event_type, h, sum(value) AS value FROM e GROUP BY ALL) s USING (event_type, h))"""


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> board, index, path, source, beats; a beat is half a second."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("board"), F.col("turn").alias("index"), F.col("role").alias("path"), F.when(F.col("role") == "user", "camera").otherwise("local").alias("source"), (1 + F.length("text") % 4).cast("int").alias("beats"))


BOARDS = "boards AS (SELECT conv_id AS board, turn AS index, role AS path, CASE WHEN role = 'user' THEN 'camera' ELSE 'local' END AS source, 1 + length(text) % 4 AS beats FROM conversations)"


def _lab(code: str) -> list[float]:
    rgb = [int(code[k : k + 2], 16) / 255 for k in (1, 3, 5)]
    lin = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb]
    from shoal.functions.numbers import WHITE, XYZ

    xyz = [sum(m * c for m, c in zip(row, lin, strict=True)) / w for row, w in zip(XYZ, WHITE, strict=True)]
    f = [t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in xyz]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def profiles_sql() -> str:
    d = lambda x: f"{float(x)!r}::DOUBLE"
    lines = []
    for p in profiles.rows():
        labs = "[" + ", ".join("[" + ", ".join(map(d, _lab(c))) + "]" for c in p["palette_hex"]) + "]"
        targets = ", ".join(d(p[k]) for k in ("brightness", "saturation", "contrast", "warmth", "hue_spread"))
        lines.append(f"('{p['key']}', {_list(p['palette_hex'])}, {labs}, {targets}, {', '.join(d(p['weights'][k]) for k in profiles.WEIGHTS)}, {_list(p['keywords'])})")
    names = "key, palette_hex, labs, brightness, saturation, contrast, warmth, hue_spread, " + ", ".join(f"w_{k}" for k in profiles.WEIGHTS) + ", keywords"
    return f"profiles({names}) AS (VALUES {', '.join(lines)})"


PROFILES = profiles_sql()
