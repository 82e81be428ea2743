"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import numbers, text
from shoal.operators import ledger, library, report, selection, signal, timeline, website
from shoal.plans import adapters as A
from shoal.plans.profiles import profiles
from shoal.plans.profiles import rows as profile_rows
from shoal.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r4(c, name: str):
    return F.bround(c, 4).alias(name)


# --- paths: classification, pruning, incremental refresh --------------------------------------

_CASES = " ".join(f"WHEN contains(lower(path), '{m}') THEN '{s}'" for m, s in text.SOURCE_MARKS)
_NAME = "regexp_extract(path, '[^/]*$')"
_SUFFIX = f"lower(regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1))"
_STEM = f"regexp_replace({_NAME}, '([^.])\\.[^.]+$', '\\1')"
_KIND = f"CASE WHEN {_SUFFIX} IN ({', '.join(map(repr, text.IMAGE_SUFFIXES))}) THEN 'image' WHEN {_SUFFIX} IN ({', '.join(map(repr, text.VIDEO_SUFFIXES))}) THEN 'video' WHEN {_SUFFIX} IN ({', '.join(map(repr, text.AUDIO_SUFFIXES))}) THEN 'audio' END"
_JUNK = f"(starts_with({_NAME}, '._') OR lower({_NAME}) = '.ds_store' OR " + " OR ".join(f"contains(lower({_STEM}), '{m}')" for m in text.JUNK_MARKS) + ")"
_PRUNED = f"(list_has_any(string_split(substr(regexp_replace(path, '/[^/]*$', ''), 7), '/'), {A._list(text.PRUNED_FOLDERS)}) OR contains(substr(regexp_replace(path, '/[^/]*$', ''), 7), '/.'))"


@query(f"WITH {A.PATHS} SELECT CASE {_CASES} ELSE 'local' END AS source, count(*) AS n FROM paths GROUP BY ALL")
def source_classify(spark, sf_dir):
    return A.paths(spark, sf_dir).groupBy(text.source_label(F.col("path")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.PATHS} SELECT coalesce({_KIND}, 'other') AS kind, {_SUFFIX} AS suffix, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM paths GROUP BY ALL")
def kind_by_suffix(spark, sf_dir):
    p = F.col("path")
    return A.paths(spark, sf_dir).groupBy(F.coalesce(text.kind(p), F.lit("other")).alias("kind"), text.suffix(p).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(f"WITH {A.PATHS} SELECT page_id, path FROM paths WHERE ({_KIND}) IN ('image', 'video') AND NOT {_JUNK}")
def junk_filter(spark, sf_dir):
    p = F.col("path")
    return A.paths(spark, sf_dir).where(text.kind(p).isin("image", "video") & ~text.is_junk(p)).select("page_id", "path")


@query(f"WITH {A.PATHS} SELECT {_PRUNED} AS pruned, count(*) AS n FROM paths GROUP BY ALL")
def path_segments_prune(spark, sf_dir):
    return A.paths(spark, sf_dir).groupBy(text.is_pruned(F.col("path"), "/media").alias("pruned")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'unchanged' ELSE 'changed' END AS state,
    count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ALL""")
def incremental_scan(spark, sf_dir):
    """Against a cache that lacks every fifth document and has others with another size, time or no fingerprint."""
    d = A.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    found = d.select(i.cast("string").alias("path"), F.col("n_chars").alias("bytes"), F.lit(1000.0).alias("mtime"))
    cache = d.where(i % 5 != 0).select(i.cast("string").alias("path"), (F.col("n_chars") + F.when(i % 7 == 0, 1).otherwise(0)).alias("bytes"), F.when(i % 11 == 0, 1002.0).otherwise(1000.5).alias("mtime"), F.when(i % 13 == 0, "").otherwise("f").alias("fingerprint"))
    return library.refresh_plan(found, cache).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(f"WITH {A.PATHS} SELECT page_id, {_NAME} AS name, {_STEM} AS stem, regexp_replace(path, '/[^/]*$', '') AS folder FROM paths")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return A.paths(spark, sf_dir).select("page_id", text.name(p).alias("name"), text.stem(p).alias("stem"), text.folder(p).alias("folder"))


# --- the catalogue of assets ------------------------------------------------------------------

_ELIGIBLE = "error IS NULL AND width > 0 AND height > 0 AND (kind <> 'video' OR duration >= 1.0) AND width * height >= 500000 AND quality >= 0.35::DOUBLE"
_COOLING = f"cooling AS (SELECT DISTINCT asset FROM uses WHERE created_at >= (SELECT max(epoch(o_orderdate)) FROM orders) - 21 * 86400.0)"


def _cooling(spark, sf_dir, days: float = 21):
    """Orders are filtered before lines are joined: only recent ones meet the lines."""
    o, li = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "lineitem")
    limit = o.agg((F.max("o_orderdate") - F.make_dt_interval(days=F.lit(days).cast("int"))).alias("limit")).scalar()
    recent = o.where(F.col("o_orderdate") >= limit)
    return li.join(recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").cast("string").alias("asset")).distinct()


@query(f"WITH {A.ASSETS}, {A.USES}, {_COOLING} SELECT id, path, quality FROM assets WHERE {_ELIGIBLE} AND id::VARCHAR NOT IN (SELECT asset FROM cooling)")
def eligible_filter(spark, sf_dir):
    blocked = _cooling(spark, sf_dir)
    a = A.assets(spark, sf_dir)
    own = library.eligible(a)
    return own.join(blocked, F.col("id").cast("string") == F.col("asset"), "left_anti").select("id", "path", "quality")


@query(f"""WITH {A.ASSETS}, ok AS (SELECT *, error IS NULL AND width > 0 AND height > 0 AS u FROM assets)
    SELECT kind, source, (2 * grouping(kind) + grouping(source))::BIGINT AS level, count(*) AS n, count_if(u)::BIGINT AS usable, count(error) AS failed, count_if(u AND height > width)::BIGINT AS vertical,
    coalesce(round_even(sum(duration) FILTER (u AND kind = 'video'), 1), 0.0::DOUBLE) AS footage_seconds FROM ok GROUP BY GROUPING SETS ((kind), (source), ())""")
def library_stats(spark, sf_dir):
    return library.stats(A.assets(spark, sf_dir))


@query("SELECT coalesce(lang, '(none)') AS lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL GROUP BY ALL")
def failure_breakdown(spark, sf_dir):
    d, lab = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").where("quality is null").groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


@query(f"WITH {A.PATHS}, bad AS (SELECT * FROM paths WHERE bytes % 3 = 0) SELECT coalesce(nullif({_SUFFIX}, ''), '(none)') AS suffix, count(*) AS n, CASE WHEN {_SUFFIX} IN ('.heic', '.avif') THEN 'convert' ELSE 'could not be decoded' END AS advice FROM bad GROUP BY ALL")
def failure_advice(spark, sf_dir):
    bad = A.paths(spark, sf_dir).withColumn("error", F.when(F.col("bytes") % 3 == 0, "decode"))
    advice = spark.createDataFrame([(".heic", "convert"), (".avif", "convert")], "suffix string, advice string")
    return library.failure_breakdown(bad, F.broadcast(advice)).select("suffix", "n", "advice")


@query(f"""WITH {A.ASSETS}, q AS (SELECT id, kind, width, height, duration, brightness, contrast, width::DOUBLE / height AS aspect, (width * height)::DOUBLE AS area FROM assets)
    SELECT id, round_even(greatest(0, least(1, (0.4::DOUBLE * least(1, area / 2073600) * CASE WHEN area < 700000 THEN 0.55::DOUBLE ELSE 1 END + 0.2::DOUBLE * CASE WHEN aspect <= 9.0::DOUBLE / 16 THEN 1 ELSE greatest(0.3::DOUBLE, pow((9.0::DOUBLE / 16) / aspect, 0.45::DOUBLE)) END
    + 0.25::DOUBLE * (1 - 0.6::DOUBLE * least(1, abs(brightness - 0.52::DOUBLE) / 0.52::DOUBLE)) * CASE WHEN brightness < 0.06::DOUBLE OR brightness > 0.96::DOUBLE THEN 0.3::DOUBLE ELSE 1 END + 0.15::DOUBLE * CASE WHEN contrast > 0.08::DOUBLE THEN 1 ELSE 0.45::DOUBLE END)
    * CASE WHEN kind <> 'video' THEN 1 WHEN duration < 1.2::DOUBLE THEN 0.4::DOUBLE WHEN duration < 2.5::DOUBLE THEN 0.8::DOUBLE ELSE 1 END)), 4)::DOUBLE AS quality_score FROM q""")
def quality_score(spark, sf_dir):
    c = F.col
    return A.assets(spark, sf_dir).select("id", r4(numbers.quality(c("width"), c("height"), c("brightness"), c("contrast"), c("kind") == "video", c("duration")), "quality_score"))


# --- history of uses --------------------------------------------------------------------------

@query(f"WITH {A.USES} SELECT asset, count(*) AS uses FROM uses GROUP BY ALL")
def usage_counts(spark, sf_dir):
    return ledger.usage_counts(A.uses(spark, sf_dir))


@query(f"WITH {A.USES} SELECT asset, max(created_at) AS last_used FROM uses GROUP BY ALL")
def last_used(spark, sf_dir):
    return ledger.last_used(A.uses(spark, sf_dir))


@query(f"WITH {A.USES}, {_COOLING} SELECT asset FROM cooling")
def cooling_parts(spark, sf_dir):
    return _cooling(spark, sf_dir)


@query(f"WITH {A.USES}, {_COOLING} SELECT count(*) AS available FROM part WHERE p_partkey::VARCHAR NOT IN (SELECT asset FROM cooling)")
def available_parts(spark, sf_dir):
    a = A.assets(spark, sf_dir).select(F.col("id").cast("string").alias("path"))
    return ledger.available(a, _cooling(spark, sf_dir)).agg(F.count(F.lit(1)).alias("available"))


@query("""WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT count(*) AS posts, count_if(o_orderdate >= now - INTERVAL 7 DAY)::BIGINT AS posts_last_7_days,
    (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS distinct_assets FROM orders, n""")
def ledger_summary(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return ledger.summary(A.posts(spark, sf_dir), A.uses(spark, sf_dir), A.now(o))


@query("SELECT o_orderpriority AS preset, count(*) AS posts FROM orders GROUP BY ALL")
def preset_counts(spark, sf_dir):
    return ledger.preset_counts(A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("preset")))


@query("""SELECT o_orderkey AS slug, o_orderpriority AS preset, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 3
    UNION ALL SELECT o_orderkey, 'revised', o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 3""")
def ledger_upsert(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderpriority").alias("preset"), F.col("o_totalprice").alias("price"))
    return ledger.upsert(o, o.where("slug % 10 = 3").select("slug", F.lit("revised").alias("preset"), (F.col("price") + 1).alias("price")))


@query("SELECT o_orderpriority AS preset, o_orderkey AS slug, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 10")
def recent_posts(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = A.table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return o.select(F.col("o_orderpriority").alias("preset"), F.col("o_orderkey").alias("slug"), "rank")


# --- scoring and selection --------------------------------------------------------------------

_CLOSE = "greatest(0::DOUBLE, least(1::DOUBLE, 1 - abs(a.{k} - p.{k}) / {t}::DOUBLE))"
_NEAR = "list_min(list_transform({targets}, lambda t: sqrt(pow({own}[1] - t[1], 2) + pow({own}[2] - t[2], 2) + pow({own}[3] - t[3], 2))))"
_DIST = " + ".join(f"{w}::DOUBLE * " + _NEAR.format(targets="p.labs", own=f"a.labs[{k + 1}]") for k, w in enumerate((0.5, 0.3, 0.2)))
_PARTS = {"palette": f"pow(greatest(0::DOUBLE, least(1::DOUBLE, 1 - ({_DIST}) / 40)), 1.3::DOUBLE)"} | {k: _CLOSE.format(k=k, t=t) for k, t in selection.TOLERANCE.items()} | {
    "quality": "a.quality", "vertical": "CASE WHEN a.height > a.width THEN 1::DOUBLE WHEN a.width::DOUBLE / a.height <= 1.05::DOUBLE THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END"}
_SCORE = (
    "greatest(0::DOUBLE, least(1::DOUBLE, (" + " + ".join(f"p.w_{k} * {v}" for k, v in _PARTS.items()) + ") / (" + " + ".join(f"p.w_{k}" for k in _PARTS) + ")"
    " + 0.06::DOUBLE * least(1::DOUBLE, len(list_filter(p.keywords, lambda k: contains(translate(lower(a.path), '_-', '  '), k)))::DOUBLE / 2)))"
)
_SCORED = f"{A.ASSETS}, {A.PROFILES}, scored AS (SELECT p.key AS preset, a.id, a.path, a.kind, a.source, {_SCORE} AS score FROM assets a, profiles p WHERE {_ELIGIBLE.replace('error', 'a.error')})"


def _scored(spark, sf_dir):
    return selection.score(library.eligible(A.assets(spark, sf_dir)), profiles(spark))


@query(f"WITH {_SCORED} SELECT preset, id, round_even(score, 4) AS score FROM scored")
def cross_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("preset", "id", r4(F.col("score"), "score"))


@query(f"WITH {_SCORED}, {A.USES}, {_COOLING} SELECT preset, id, rank, round_even(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY score DESC, path)::INT AS rank FROM scored WHERE id::VARCHAR NOT IN (SELECT asset FROM cooling)) WHERE rank <= 8")
def boards_top(spark, sf_dir):
    """The flagship: what isn't cooling, scored against every profile, the best eight of each."""
    a = library.eligible(A.assets(spark, sf_dir))
    a = a.join(_cooling(spark, sf_dir), F.col("id").cast("string") == F.col("asset"), "left_anti")
    return selection.top_k(selection.score(a, profiles(spark)), 8).select("preset", "id", "rank", r4(F.col("score"), "score"))


@query(f"""WITH {_SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY score DESC, path) AS rank FROM scored) WHERE rank <= 8)
    SELECT preset, count(*) AS n, count_if(kind = 'video')::BIGINT AS videos, count_if(kind <> 'video')::BIGINT AS photos, round_even(avg(score), 4) AS mean_score, round_even(min(score), 4) AS min_score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM top GROUP BY ALL""")
def boards_leaderboard(spark, sf_dir):
    return selection.summarize(selection.top_k(_scored(spark, sf_dir), 8)).orderBy(F.desc("mean_score"), "preset")


@query(f"WITH {A.PROFILES} SELECT doc_id, key, least(1::DOUBLE, len(list_filter(keywords, lambda k: contains(translate(lower(text), '_-', '  '), k)))::DOUBLE / 2) AS bonus FROM documents, profiles")
def keyword_bonus(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", text.plain(F.col("text")).alias("plain"))
    each = [F.struct(F.lit(p["key"]).alias("key"), text.literal_bonus(F.col("plain"), p["keywords"]).alias("bonus")) for p in profile_rows()]
    return d.select("doc_id", F.inline(F.array(*each)))


@query("""WITH t(k, v) AS (VALUES (0, [0.2::DOUBLE, 0.1::DOUBLE, 0.0::DOUBLE]), (1, [-0.1::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE]), (2, [0.0::DOUBLE, -0.2::DOUBLE, 0.05::DOUBLE])),
    s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) >= 12), sw AS (SELECT vec_id, [e[1 + 3 * j], e[2 + 3 * j], e[3 + 3 * j]] AS v, 4 - j AS w
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) , (SELECT unnest(range(4)) AS j)),
    n AS (SELECT vec_id, w, (SELECT min(sqrt(pow(sw.v[1] - t.v[1], 2) + pow(sw.v[2] - t.v[2], 2) + pow(sw.v[3] - t.v[3], 2))) FROM t) AS d FROM sw)
    SELECT vec_id, round_even(sum(w * d) / sum(w), 4) AS distance FROM n GROUP BY ALL""")
def nearest_palette(spark, sf_dir):
    """Weighted mean distance of four 3-d swatches of a vector to the nearest of three targets."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    own = F.array(*[F.slice("e", 1 + 3 * j, 3) for j in range(4)])
    targets = F.array(*[F.array(*map(F.lit, v)) for v in ([0.2, 0.1, 0.0], [-0.1, 0.0, 0.1], [0.0, -0.2, 0.05])])
    return e.select("vec_id", r4(numbers.nearest_mean(own, F.array(*[F.lit(4.0 - j) for j in range(4)]), targets, 100.0), "distance"))


_LAB_NEAR = "list_min(list_transform(b.labs, lambda t: sqrt(pow(a.labs[{k}][1] - t[1], 2) + pow(a.labs[{k}][2] - t[2], 2) + pow(a.labs[{k}][3] - t[3], 2))))"


@query(f"WITH {A.PROFILES} SELECT a.key AS a, b.key AS b, round_even(({' + '.join(_LAB_NEAR.format(k=k) for k in range(1, 7))}) / 6, 4) AS distance FROM profiles a, profiles b")
def lab_delta_e(spark, sf_dir):
    """Every profile's palette against every other's; the dimension has a fixed number of rows."""
    p = profiles(spark).select("key", selection.lab_of(F.col("palette_hex")).alias("labs"))
    pairs = p.alias("x").join(F.broadcast(p.alias("y")))
    return pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), r4(numbers.nearest_mean(F.col("x.labs"), None, F.col("y.labs"), 100.0), "distance"))


def _like(a: str, b: str) -> str:
    """SQL of the likeness of two assets."""
    near = lambda k: f"list_min(list_transform({b}.labs[1:3], lambda t: sqrt(pow({a}.labs[{k}][1] - t[1], 2) + pow({a}.labs[{k}][2] - t[2], 2) + pow({a}.labs[{k}][3] - t[3], 2))))"
    short = f"least(length({a}.stem), length({b}.stem))"
    same = f"greatest(8, floor({short} * 0.75::DOUBLE)::INT)"
    return (
        f"greatest(0::DOUBLE, least(1::DOUBLE, 0.7::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, 1 - ({' + '.join(near(k) for k in (1, 2, 3))}) / 3 / 30))"
        f" + CASE WHEN {a}.folder = {b}.folder THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN abs({a}.mtime - {b}.mtime) < 60 AND {a}.mtime > 0 THEN 0.22::DOUBLE ELSE 0 END"
        f" + CASE WHEN {a}.stem = {b}.stem OR ({short} >= 8 AND left({a}.stem, {same}) = left({b}.stem, {same})) THEN 0.15::DOUBLE ELSE 0 END))"
    )


_KIN = f"{A.ASSETS}, kin AS (SELECT id, path, kind, labs, 'lib/' || source AS folder, id * 37.0::DOUBLE AS mtime, substr(path, length(source) + 6) AS stem FROM assets)"


@query(f"WITH {_KIN} SELECT a.id AS a, b.id AS b, round_even({_like('a', 'b')}, 4) AS similarity FROM kin a JOIN kin b ON a.folder = b.folder AND b.id > a.id AND b.id - a.id <= 40")
def pair_similarity(spark, sf_dir):
    """Neighbours of a folder, by a band join: the folder is the equality, the distance of the ids the band."""
    x = A.assets(spark, sf_dir).withColumn("bucket", F.floor(F.col("id") / 41))
    on = (F.col("x.folder") == F.col("y.folder")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("y.id") > F.col("x.id")) & (F.col("y.id") - F.col("x.id") <= 40)
    later = x.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"))))
    pairs = x.alias("x").join(later.alias("y"), on)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), r4(selection.similarity("x", "y"), "similarity"))


@query("""WITH g AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text) SELECT first, n FROM g WHERE n > 1""")
def copied_texts(spark, sf_dir):
    """Groups of equal texts, by digest: the texts themselves aren't shuffled."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("first", "n")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND b.t >= a.t AND b.t - a.t < 60000000 AND a.event_id <> b.event_id AND (b.t > a.t OR a.event_id < b.event_id)""")
def burst_pairs(spark, sf_dir):
    """Events of one user less than a minute apart: a band join as an equi-join on user and minute (own and next)."""
    e = A.table(spark, sf_dir, "events")
    t = A.seconds(F.col("ts")).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col("ts")) * 1_000_000).cast("long") % 1_000_000
    e = e.select("event_id", "user_id", t.alias("t"), F.floor(t / 60_000_000).alias("m"))
    a = e.select(F.col("event_id").alias("a"), "user_id", F.col("t").alias("ta"), F.explode(F.array(F.col("m"), F.col("m") + 1)).alias("m"))
    b = e.select(F.col("event_id").alias("b"), "user_id", F.col("t").alias("tb"), "m")
    near = a.join(b, ["user_id", "m"]).where("tb >= ta and tb - ta < 60000000 and a <> b and (tb > ta or a < b)")
    return near.select("a", "b")


def _greedy_sql(count: int, target: int) -> str:
    """One table of candidates and one of picks a step."""
    out = [f"{_KIN.removeprefix(A.ASSETS + ', ')}, c0 AS (SELECT s.preset, s.score, k.*, 0::DOUBLE AS worst, false AS taken, 0 AS videos FROM scored s JOIN kin k USING (id))"]
    for n in range(count):
        need, slots = f"greatest(0, {target} - videos)", count - n
        nudge = f"CASE WHEN kind = 'video' THEN 0.12::DOUBLE * least(1::DOUBLE, {need} / {slots}::DOUBLE) WHEN {need} >= {slots} THEN -0.10::DOUBLE ELSE 0 END"
        value = f"score - 0.55::DOUBLE * greatest(0::DOUBLE, worst - 0.45::DOUBLE) / 0.55::DOUBLE * 0.60::DOUBLE + {nudge}"
        out.append(f"p{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY worst >= 0.9::DOUBLE, {value} DESC, score DESC, path) AS rn FROM c{n} WHERE NOT taken) WHERE rn = 1)")
        if n + 1 < count:
            out.append(
                f"c{n + 1} AS (SELECT a.preset, a.score, a.id, a.path, a.kind, a.labs, a.folder, a.mtime, a.stem, greatest(a.worst, {_like('a', 'b')}) AS worst, a.taken OR a.path = b.path AS taken, "
                f"a.videos + (b.kind = 'video')::INT AS videos FROM c{n} a JOIN p{n} b USING (preset))"
            )
    picks = " UNION ALL ".join(f"SELECT preset, {n + 1} AS place, path, round_even(score, 4) AS score FROM p{n}" for n in range(count))
    return f"WITH {_SCORED}, {', '.join(out)} {picks}"


@query(_greedy_sql(4, 1))
def greedy_diverse(spark, sf_dir):
    """Four for each profile, each as unlike those before as it can be."""
    return selection.greedy_diverse(_scored(spark, sf_dir), 4).select("preset", "place", "path", r4(F.col("score"), "score"))


@query(f"""WITH {_SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY score DESC, path) AS rank FROM scored) WHERE rank <= 8),
    e AS (SELECT t.*, greatest(0::DOUBLE, least(1::DOUBLE, 0.40::DOUBLE * a.saturation + 0.38::DOUBLE * a.contrast + 0.12::DOUBLE * (1 - least(1, 2 * abs(a.brightness - 0.5::DOUBLE))) + CASE WHEN a.kind = 'video' THEN 0.10::DOUBLE ELSE 0 END)) AS energy FROM top t JOIN assets a USING (id)),
    r AS (SELECT preset, id, row_number() OVER (PARTITION BY preset ORDER BY energy DESC, score DESC, path) AS r, count(*) OVER (PARTITION BY preset) AS n FROM e)
    SELECT preset, id, CASE WHEN n <= 2 THEN r WHEN r = 1 THEN 1 WHEN r = 2 THEN n WHEN r - 3 < (n - 2) // 2 THEN 3 + 2 * (r - 3) ELSE 2 + 2 * (n - 2 - 1 - (r - 3)) END::BIGINT AS place FROM r""")
def weave_order(spark, sf_dir):
    c = F.col
    top = selection.top_k(_scored(spark, sf_dir), 8).withColumn("energy", numbers.energy(c("saturation"), c("contrast"), c("brightness"), c("kind") == "video"))
    return selection.weave(top, "preset", "energy", "score").select("preset", "id", "place")


# --- colours ----------------------------------------------------------------------------------

@query("""WITH p AS (SELECT label, abs(embedding[1])::DOUBLE * 255 AS r, abs(embedding[2])::DOUBLE * 255 AS g, abs(embedding[3])::DOUBLE * 255 AS b FROM embeddings)
    SELECT label, round_even(avg((0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255), 4) AS brightness, round_even(least(1, 2.5::DOUBLE * stddev_pop((0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255)), 4)::DOUBLE AS contrast,
    round_even(avg(coalesce((greatest(r, g, b) - least(r, g, b)) / nullif(greatest(r, g, b), 0), 0)), 4) AS saturation,
    round_even(least(1, (sqrt(pow(stddev_pop(r - g), 2) + pow(stddev_pop(0.5::DOUBLE * (r + g) - b), 2)) + 0.3::DOUBLE * sqrt(pow(avg(r - g), 2) + pow(avg(0.5::DOUBLE * (r + g) - b), 2))) / 150), 4)::DOUBLE AS colorfulness,
    round_even(greatest(-1, least(1, avg((r - b) / 255))), 4)::DOUBLE AS warmth FROM p GROUP BY label""")
def colour_stats(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    p = e.select("label", *[(F.abs(F.col("embedding")[k]).cast("double") * 255).alias(c) for k, c in enumerate("rgb")])
    s = signal.colour_stats(p, ["label"])
    return s.select("label", *[r4(F.col(c), c) for c in s.columns[1:]])


@query("""WITH h AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: (x::DOUBLE + 1) * 180) AS h FROM embeddings)
    SELECT vec_id, round_even(list_max(flatten(list_transform(h, lambda a: list_transform(h, lambda b: least(abs(a - b) % 360, 360 - abs(a - b) % 360))))) / 180, 4) AS spread FROM h""")
def hue_spread(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: (x.cast("double") + 1) * 180).alias("h"))
    return e.select("vec_id", r4(numbers.hue_spread(F.col("h")), "spread"))


@query(f"""WITH {A.PROFILES}, c AS (SELECT key, unnest(palette_hex) AS hex FROM profiles), v AS (SELECT key, hex, ('0x' || hex[2:3])::INT AS r, ('0x' || hex[4:5])::INT AS g, ('0x' || hex[6:7])::INT AS b FROM c)
    SELECT key, hex, r, g, b, round_even((0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255, 4) AS luma,
    round_even(60 * CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0::DOUBLE WHEN r = greatest(r, g, b) THEN ((g - b)::DOUBLE / (greatest(r, g, b) - least(r, g, b)) + 6) % 6 WHEN g = greatest(r, g, b) THEN (b - r)::DOUBLE / (greatest(r, g, b) - least(r, g, b)) + 2 ELSE (r - g)::DOUBLE / (greatest(r, g, b) - least(r, g, b)) + 4 END, 4) AS hue, hex AS back FROM v""")
def colour_codes(spark, sf_dir):
    c = profiles(spark).select("key", F.explode("palette_hex").alias("hex")).withColumn("c", numbers.hex_to_rgb(F.col("hex")))
    r, g, b = (F.col("c")[k] for k in range(3))
    return c.select("key", "hex", r.alias("r"), g.alias("g"), b.alias("b"), r4(numbers.luminance(r, g, b), "luma"), r4(numbers.hsv(r / 255.0, g / 255.0, b / 255.0)["h"], "hue"), numbers.rgb_to_hex(r, g, b).alias("back"))


@query()
def kmeans_palette(spark, sf_dir):
    """Clusters of three vector components as colours, per label and block of vectors; checked by planted clusters in the tests."""
    e = A.table(spark, sf_dir, "embeddings")
    p = e.select(F.floor(F.col("vec_id") / 64).alias("frame"), *[(F.abs(F.col("embedding")[k]).cast("double") * 255).alias(c) for k, c in enumerate("rgb")])
    return signal.palettes(p, "frame", k=4)


@query("""SELECT l_returnflag, l_linestatus, round_even(sum(l_quantity), 2) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""")
def profile_totals(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    return li.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus").agg(F.bround(F.sum("l_quantity"), 2).alias("total"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, greatest(0, embedding[3]::DOUBLE) AS c FROM embeddings) SELECT label, round_even(coalesce(sum(x * c) / nullif(sum(c), 0), 0.5), 4)::DOUBLE AS x, round_even(coalesce(sum(y * c) / nullif(sum(c), 0), 0.5), 4)::DOUBLE AS y, round_even(avg(c), 4) AS confidence FROM p GROUP BY label""")
def focus_weighted_mean(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    x, y, c = (F.col("embedding")[k].cast("double") for k in range(3))
    f = signal.focus(e, "label", x, y, F.greatest(F.lit(0.0), c))
    return f.select("label", r4(F.col("x"), "x"), r4(F.col("y"), "y"), r4(F.col("confidence"), "confidence"))


# --- time series ------------------------------------------------------------------------------

_FLUX = f"""{A.HOURLY}, rise AS (SELECT i, greatest(0, value - lag(value) OVER (PARTITION BY event_type ORDER BY i)) AS r, lag(value) OVER (PARTITION BY event_type ORDER BY i) AS p FROM hourly),
    flux AS (SELECT i, sum(r) AS f FROM rise WHERE p IS NOT NULL GROUP BY i)"""


@query(f"""WITH {_FLUX}, s AS (SELECT i, avg(f) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM flux)
    SELECT i, round_even((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 4) AS value FROM s""")
def onset_flux(spark, sf_dir):
    """A series is one track: its hours, some hundreds, share a window."""
    h = A.hourly(spark, sf_dir).withColumn("track", F.lit(1))
    f = signal.flux(h, "track", "event_type", "i", "value")
    return signal.normalize(signal.smooth(f, "track", "i", "flux"), "track", "flux").select("i", r4(F.col("flux"), "value"))


_ACF = f"""{A.HOURLY}, x AS (SELECT event_type, i, value - avg(value) OVER (PARTITION BY event_type) AS x FROM hourly),
    raw AS (SELECT a.event_type, l.lag, sum(a.x * b.x) / count(*) AS raw FROM x a, (SELECT unnest(range(2, 49))::INT AS lag) l, x b WHERE a.event_type = b.event_type AND b.i = a.i + l.lag GROUP BY ALL),
    acf AS (SELECT r.event_type, r.lag, r.raw, r.raw + 0.5::DOUBLE * coalesce(d.raw, 0) + 0.25::DOUBLE * coalesce(t.raw, 0) AS score FROM raw r LEFT JOIN raw d ON d.event_type = r.event_type AND d.lag = 2 * r.lag LEFT JOIN raw t ON t.event_type = r.event_type AND t.lag = 3 * r.lag)"""


@query(f"WITH {_ACF} SELECT event_type, lag, round_even(score, 2) AS score FROM acf")
def autocorrelation(spark, sf_dir):
    a = signal.autocorrelation(A.hourly(spark, sf_dir), "event_type", "i", "value", 2, 48)
    return a.select("event_type", "lag", F.bround("score", 2).alias("score"))


@query(f"WITH {_ACF} SELECT event_type, arg_max(lag, score) AS lag FROM acf GROUP BY ALL")
def tempo_lag(spark, sf_dir):
    a = signal.autocorrelation(A.hourly(spark, sf_dir), "event_type", "i", "value", 2, 48)
    return signal.tempo(a, "event_type", 1.0).select("event_type", "lag")


@query(f"""WITH {A.HOURLY}, n AS (SELECT event_type, count(*) AS n FROM hourly GROUP BY ALL), s AS (SELECT event_type, n, unnest(range(0, 48))::INT AS step FROM n), k AS (SELECT *, step * 24.0::DOUBLE / 48 AS off, unnest(range(0, 1 + floor((n - 1 - step * 24.0::DOUBLE / 48) / 24)::BIGINT)) AS k FROM s),
    m AS (SELECT k.event_type, k.step, avg(h.value) AS mean FROM k JOIN hourly h ON h.event_type = k.event_type AND h.i = floor(off + k.k * 24) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, step) AS rn FROM m)
    SELECT event_type, round_even(step / 2.0::DOUBLE, 4) AS offset_hours, round_even(mean, 4) AS mean FROM r WHERE rn = 1""")
def phase_offset(spark, sf_dir):
    h = A.hourly(spark, sf_dir)
    n = h.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    p = signal.phase(h.join(n, "event_type"), "event_type", "i", "value", F.lit(24.0), F.lit(48), F.col("n"))
    return p.select("event_type", r4(F.col("offset"), "offset_hours"), r4(F.col("mean"), "mean"))


@query("""WITH b AS (SELECT p_partkey, p_size * 7.0::DOUBLE AS bpm FROM part), u AS (SELECT p_partkey, bpm, CASE WHEN bpm > 0 AND bpm < 78 THEN bpm * pow(2, ceil(log2(78 / bpm))) ELSE bpm END AS u FROM b)
    SELECT p_partkey, round_even(greatest(60, least(180, CASE WHEN u > 165 THEN u / pow(2, ceil(log2(u / 165))) ELSE u END)), 4)::DOUBLE AS bpm FROM u""")
def fold_tempo(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", r4(numbers.fold_tempo(F.col("p_size") * 7.0), "bpm"))


@query(f"""WITH {A.HOURLY}, s AS (SELECT event_type, i, count(*) OVER (PARTITION BY event_type) AS n, sum(value) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS s FROM hourly),
    w AS (SELECT *, max(s) OVER (PARTITION BY event_type) / avg(s) OVER (PARTITION BY event_type) - 1 AS c FROM s WHERE i + 24 <= n), b AS (SELECT *, (i + 12.0::DOUBLE) / n AS centre, greatest(0, least(1, c)) AS conf FROM w),
    z AS (SELECT *, s * exp(-pow(centre - 0.5::DOUBLE, 2) / (2 * pow(0.28::DOUBLE + 0.47::DOUBLE * conf, 2))) AS v FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, i) AS rn FROM z)
    SELECT event_type, round_even(centre, 4) AS centre, round_even(conf, 4)::DOUBLE AS confidence FROM r WHERE rn = 1""")
def best_window(spark, sf_dir):
    b = signal.best_window(A.hourly(spark, sf_dir), "event_type", "i", "value", 24)
    return b.select("event_type", r4(F.col("centre"), "centre"), r4(F.col("confidence"), "confidence"))


@query("""WITH p AS (SELECT vec_id, (k - 1) // 8 AS row, (k - 1) % 8 AS col, embedding[k]::DOUBLE * 255 AS luma FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)),
    g AS (SELECT vec_id, abs(luma - lead(luma, 1, luma) OVER (PARTITION BY vec_id, row ORDER BY col)) + abs(luma - lead(luma, 1, luma) OVER (PARTITION BY vec_id, col ORDER BY row)) + 0.35::DOUBLE * 255 * 0.1::DOUBLE AS interest FROM p)
    SELECT vec_id, round_even(sum(interest), 4) AS interest FROM g GROUP BY vec_id""")
def interest_gradient(spark, sf_dir):
    """Vectors as 8 by 8 grids of brightness."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    p = e.select("vec_id", F.floor(F.col("k") / 8).alias("row"), (F.col("k") % 8).alias("col"), (F.col("v").cast("double") * 255).alias("luma"), F.lit(0.1).alias("saturation"))
    return signal.interest(p, ["vec_id"]).groupBy("vec_id").agg(r4(F.sum("interest"), "interest"))


# --- timelines --------------------------------------------------------------------------------

_CUTS = f"{A.BOARDS}, cuts AS (SELECT *, sum(beats) OVER (PARTITION BY board ORDER BY index) * 0.5::DOUBLE AS cut FROM boards)"
_TRANS = f"{_CUTS}, d AS (SELECT *, cut - lag(cut, 1, 0) OVER w AS before, lead(cut) OVER w - cut AS after FROM cuts WINDOW w AS (PARTITION BY board ORDER BY index)), trans AS (SELECT *, CASE WHEN after IS NULL THEN 0::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.4::DOUBLE, 0.5::DOUBLE * least(before, after))) END AS t_out FROM d)"
_SPANS = f"{_TRANS}, s AS (SELECT *, lag(cut, 1, 0) OVER w AS start, lag(t_out, 1, 0) OVER w AS t_in FROM trans WINDOW w AS (PARTITION BY board ORDER BY index)), spans AS (SELECT *, greatest(0.05::DOUBLE, cut - start) AS visible, greatest(0.05::DOUBLE, cut - start) + t_in / 2 + t_out / 2 AS length FROM s)"


def _spans(spark, sf_dir):
    cuts = timeline.plan_cuts(A.boards(spark, sf_dir), "board", "index", "beats", F.lit(0.5))
    return timeline.shot_spans(timeline.transition_lengths(cuts, "board", "index", F.lit(0.4)), "board", "index")


@query(f"WITH {_CUTS} SELECT board, index, cut FROM cuts")
def plan_cuts(spark, sf_dir):
    return timeline.plan_cuts(A.boards(spark, sf_dir), "board", "index", "beats", F.lit(0.5)).select("board", "index", "cut")


@query(f"WITH {_TRANS} SELECT board, index, round_even(t_out, 4) AS transition_out FROM trans")
def transition_lengths(spark, sf_dir):
    return _spans(spark, sf_dir).select("board", "index", r4(F.col("transition_out"), "transition_out"))


@query(f"WITH {_SPANS} SELECT board, index, round_even(start, 4) AS start, round_even(visible, 4) AS visible, round_even(length, 4) AS length FROM spans")
def shot_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("board", "index", r4(F.col("start"), "start"), r4(F.col("visible"), "visible"), r4(F.col("length"), "length"))


@query(f"WITH {_SPANS} SELECT board, index, round_even(greatest(0, coalesce(sum(length - t_in) OVER (PARTITION BY board ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - t_in), 4)::DOUBLE AS fade_offset FROM spans")
def fade_offsets(spark, sf_dir):
    return timeline.fade_offsets(_spans(spark, sf_dir), "board", "index").select("board", "index", r4(F.col("fade_offset"), "fade_offset"))


@query(f"WITH {_SPANS}, v AS (SELECT board, abs(sum(length) - sum(t_in) - max(start + visible)) > 0.01 AS bad FROM spans GROUP BY board) SELECT count(*) AS boards, count_if(bad)::BIGINT AS violations FROM v")
def timeline_verify(spark, sf_dir):
    shots = _spans(spark, sf_dir)
    bad = timeline.verify(shots, "board", "index").agg(F.count(F.lit(1)).alias("violations"))
    return shots.agg(F.count_distinct("board").alias("boards")).join(F.broadcast(bad))  # one row each


@query(f"""WITH {A.ASSETS}, a AS (SELECT id, duration AS av, 1 + (id % 5)::DOUBLE * 0.7::DOUBLE AS need, (id % 100)::DOUBLE / 100 AS u FROM assets WHERE kind = 'video')
    SELECT id, round_even(CASE WHEN av >= 1.15::DOUBLE * need THEN least(0.1::DOUBLE * av, 1.5::DOUBLE) + greatest(0, av - least(0.1::DOUBLE * av, 1.5::DOUBLE) - need) * u ELSE 0 END, 4)::DOUBLE AS source_in,
    round_even(CASE WHEN av >= need THEN 1 WHEN need / greatest(av, 0.05::DOUBLE) <= 2 THEN greatest(av, 0.05::DOUBLE) / need ELSE 0.5::DOUBLE END, 4)::DOUBLE AS speed, av < need AND need / greatest(av, 0.05::DOUBLE) > 2 AS warn FROM a""")
def fit_video(spark, sf_dir):
    a = A.assets(spark, sf_dir).where("kind = 'video'")
    f = timeline.fit_video(F.col("duration"), 1 + F.col("id") % 5 * 0.7, F.col("id") % 100 / 100.0)
    return a.select("id", f.alias("f")).select("id", r4(F.col("f.source_in"), "source_in"), r4(F.col("f.speed"), "speed"), F.col("f.warn").alias("warn"))


@query("SELECT o_orderkey, list_extract(['pan', 'zoom', 'still'], 1 + o_orderkey % 3) AS motion FROM orders")
def cyclic_assignment(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", timeline.cycle(["pan", "zoom", "still"], F.col("o_orderkey")).alias("motion"))


@query("""WITH b AS (SELECT o_orderkey AS board, (4 + o_orderkey % 21)::INT AS total, (3 + o_orderkey % 6)::INT AS shots FROM orders), e AS (SELECT *, unnest(range(shots))::INT AS index FROM b),
    p AS (SELECT *, (row_number() OVER (PARTITION BY board ORDER BY CASE WHEN index = 0 THEN 0 WHEN index = shots - 1 THEN 1 ELSE 2 END, sha256(board || ':' || index)) - 1)::INT AS place, greatest(1, total // shots) AS base FROM e),
    one AS (SELECT *, least(shots, total - shots) AS twos FROM p), two AS (SELECT *, total - shots - twos AS left1, least(twos, (total - shots - twos) // 2) AS fours FROM one), four AS (SELECT *, left1 - 2 * fours AS left2 FROM two)
    SELECT board, index, (CASE WHEN total < shots THEN base + (place < total - base * shots)::INT ELSE 1 + (place < twos)::INT + 2 * (place < fours)::INT
      + CASE WHEN place < fours THEN left2 // fours + (place < left2 % fours)::INT WHEN fours > 0 THEN 0 ELSE (place < left2)::INT END END)::INT AS beats FROM four""")
def allocate_beats(spark, sf_dir):
    """Whole beats shared among an order's shots, in levels of one, two and four."""
    key = F.col("o_orderkey")
    b = A.table(spark, sf_dir, "orders").select(key.alias("board"), (4 + key % 21).cast("int").alias("total"), (3 + key % 6).cast("int").alias("shots"), F.array(F.lit(1), F.lit(2), F.lit(4)).alias("options"))
    return timeline.allocate_beats(b)


@query("SELECT p_partkey, round_even(0.25::DOUBLE + round_even((p_retailprice / 100 - 0.25::DOUBLE) / (60.0::DOUBLE / (60 + p_size)), 0) * (60.0::DOUBLE / (60 + p_size)), 4) AS snapped, floor(p_size::DOUBLE / (60.0::DOUBLE / (60 + p_size)))::INT + 1 AS beats FROM part")
def beat_grid(spark, sf_dir):
    bpm = (60 + F.col("p_size")).cast("double")
    grid = timeline.fixed_grid(bpm, F.col("p_size").cast("double"), F.lit(0.25))
    return A.table(spark, sf_dir, "part").select("p_partkey", r4(timeline.snap(F.col("p_retailprice") / 100, F.lit(0.25), bpm), "snapped"), F.size(grid).alias("beats"))


# --- reports ----------------------------------------------------------------------------------

@query(f"""WITH {_SPANS} SELECT board, path, source, CASE source WHEN 'camera' THEN 'own recording' ELSE 'rights to be confirmed' END AS note, count(*)::INT AS n, string_agg(printf('%.3f', round_even(start, 3)) || '+' || printf('%.3f', round_even(visible, 3)), ',' ORDER BY start) AS spans FROM spans GROUP BY ALL""")
def provenance(spark, sf_dir):
    p = report.provenance(_spans(spark, sf_dir), report.source_notes(spark))
    return p.select("board", "path", "source", "note", F.size("uses").alias("n"), F.array_join(F.transform("uses", lambda u: F.format_string("%.3f+%.3f", u["start"], u["length"])), ",").alias("spans"))


@query("""WITH o AS (SELECT doc_id, lang, ['one', 'Two', 'three', 'four'] AS options, CASE WHEN doc_id % 9 = 0 THEN ['one', 'two', 'three', 'four'] ELSE [' TWO ', lang] END AS used FROM documents),
    f AS (SELECT *, list_filter(options, lambda x: NOT list_contains(list_transform(used, lambda u: lower(trim(u))), lower(trim(x)))) AS fresh FROM o),
    c AS (SELECT doc_id, unnest(CASE WHEN len(fresh) > 0 THEN fresh ELSE options END) AS x FROM f) SELECT doc_id, arg_min(x, sha256(doc_id::VARCHAR || chr(31) || x)) AS pick FROM c GROUP BY ALL""")
def caption_pick(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang")
    options = F.array(*map(F.lit, ["one", "Two", "three", "four"]))
    used = F.when(F.col("doc_id") % 9 == 0, F.array(*map(F.lit, ["one", "two", "three", "four"]))).otherwise(F.array(F.lit(" TWO "), F.col("lang")))
    return d.select("doc_id", report.pick(options, used, F.col("doc_id")).alias("pick"))


@query("""WITH RECURSIVE pools AS (SELECT r_regionkey AS rk, r_name AS preset, list(n_name ORDER BY n_name) AS hooks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
    posts AS (SELECT r_name AS preset, 's' || s_suppkey AS slug, row_number() OVER (PARTITION BY r_name ORDER BY s_suppkey) AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    fold(preset, pos, slug, hook, used) AS (
      SELECT preset, 0::BIGINT, '', '', []::VARCHAR[] FROM pools
      UNION ALL
      SELECT preset, pos, slug, hook, list_append(used, lower(trim(hook))) FROM (
        SELECT preset, pos, slug, used, list_sort(list_transform(CASE WHEN len(fresh) > 0 THEN fresh ELSE hooks END, lambda x: {'h': sha256('hook' || chr(31) || preset || chr(31) || slug || chr(31) || x), 'o': x}))[1].o AS hook
        FROM (SELECT q.*, f.used, p.hooks, list_filter(p.hooks, lambda x: NOT list_contains(f.used, lower(trim(x)))) AS fresh FROM fold f JOIN posts q ON q.preset = f.preset AND q.pos = f.pos + 1 JOIN pools p ON p.preset = f.preset)))
    SELECT preset, pos, slug, hook, 'b' || preset AS caption FROM fold WHERE pos > 0""")
def copy_batch(spark, sf_dir):
    """A batch a region: hooks are its nations, each used once before any is used again."""
    n = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    pools = n.groupBy(F.col("r_name").alias("preset")).agg(F.array_sort(F.collect_list("n_name")).alias("hooks"))
    pools = pools.select("preset", F.lit("t").alias("title"), F.concat(F.lit("b"), "preset").alias("blurb"), "hooks", none.alias("captions"), none.alias("ctas"), F.lit("").alias("signoff"), *[none.alias(c) for c in report.REACH])
    s = A.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("r_name").orderBy("s_suppkey")
    posts = s.select(F.col("r_name").alias("preset"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), F.row_number().over(w).cast("long").alias("pos"))
    return report.write_batch(posts, pools).select("preset", "pos", "slug", "hook", "caption")


@query("""WITH t AS (SELECT event_type AS key, CASE WHEN user_id % 3 = 0 THEN 'broad' WHEN user_id % 3 = 1 THEN 'niche' ELSE 'micro' END AS pool, 'u' || user_id AS tag FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, pool ORDER BY sha256(key || chr(31) || tag), tag) AS n FROM t)
    SELECT key, string_agg('#' || tag, ' ' ORDER BY CASE pool WHEN 'broad' THEN 0 WHEN 'niche' THEN 1 ELSE 2 END, n) AS hashtags FROM r WHERE n <= CASE pool WHEN 'niche' THEN 3 ELSE 2 END GROUP BY key""")
def hashtag_mix(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    pool = F.when(F.col("user_id") % 3 == 0, "broad").when(F.col("user_id") % 3 == 1, "niche").otherwise("micro")
    pools = e.select(F.col("event_type").alias("key"), pool.alias("pool"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag")).distinct()
    return report.hashtag_mix(pools, F.col("key"), {"broad": 2, "niche": 3, "micro": 2}).select("key", F.array_join("hashtags", " ").alias("hashtags"))


@query("SELECT p_partkey, coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 16), '-'), ''), 'untitled') AS slug, (floor(round_even(p_retailprice / 7, 1) / 60))::INT || ':' || lpad(printf('%.1f', round_even(p_retailprice / 7, 1) - 60 * floor(round_even(p_retailprice / 7, 1) / 60)), 4, '0') AS length FROM part")
def slug_and_duration(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slug_ascii(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!")), 16).alias("slug"), text.human_duration(F.col("p_retailprice") / 7).alias("length"))


@query("SELECT p_partkey, ('0x' || substr(sha256('plan' || chr(31) || p_partkey), 9, 8))::BIGINT % 2147483648 AS seed FROM part")
def stable_seeds(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", text.seed31(F.lit("plan"), F.col("p_partkey")).alias("seed"))


_WIDTH = "CASE " + " ".join(f"WHEN c = '{c.replace(chr(39), chr(39) * 2)}' THEN {w}" for c, w in text.WIDTHS.items() if c != "\t") + " WHEN c SIMILAR TO '[0-9]' THEN 560 WHEN c SIMILAR TO '[A-Z]' THEN 680 ELSE 545 END"


@query(f"WITH c AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand || '!', '')) AS c FROM part) SELECT p_partkey, round_even(sum({_WIDTH}) * 68::DOUBLE / 1000, 4) AS width FROM c GROUP BY ALL")
def text_measure(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return p.select("p_partkey", r4(text.width(F.concat("p_name", F.lit(" "), "p_brand", F.lit("!")), 68.0), "width"))


@query()
def text_fit(spark, sf_dir):
    """Benchmark items laid out in three lines at most; invariants are checked in the tests."""
    from shoal.operators.layout import fit_column

    b = A.table(spark, sf_dir, "benchmark")
    return b.select("item_id", fit_column(F.col("text"), 68, 1080).alias("f")).select("item_id", F.size("f.lines").alias("lines"), "f.size", r4(F.col("f.width"), "width"))


@query("SELECT event_type, (json_extract_string(props, '$.k'))::BIGINT AS k, split_part(event_type || ':' || (user_id % 4), ':', 1) AS name, split_part(event_type || ':' || (user_id % 4), ':', 2) AS placement, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    name, place = text.tracking_parts(F.concat("event_type", F.lit(":"), (F.col("user_id") % 4).cast("string")))
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), name.alias("name"), place.alias("placement")).agg(F.count(F.lit(1)).alias("n"))


_HOURS = ", ".join(f"({d}, {int(o[:2]) * 60 + int(o[3:])}, {int(c[:2]) * 60 + int(c[3:])})" for d, o, c in website.HOURS)


@query(f"WITH h(d, o, c) AS (VALUES {_HOURS}) SELECT (isodow(ts) - 1)::INT AS weekday, (hour(ts) * 60 + minute(ts) >= o AND hour(ts) * 60 + minute(ts) < c) AS open_now, count(*) AS n FROM events JOIN h ON isodow(ts) - 1 = d GROUP BY ALL")
def open_now(spark, sf_dir):
    hours = spark.createDataFrame(website.HOURS, "day int, open string, close string")
    e = website.open_now(A.table(spark, sf_dir, "events"), hours)
    return e.groupBy(F.weekday("ts").alias("weekday"), "open_now").agg(F.count(F.lit(1)).alias("n"))


RULES = ["# moved pages", "/en/* /english/ 301", "/fr/1* /never/ 301", "/de/* /german/ 302", "/de/7 /seven/ 301", "/es /spanish/"]


@query("""WITH p AS (SELECT page_id, '/' || split_part(split_part(split_part(split_part(url, '//', 2), '#', 1), '?', 1), '/', 2) || '/' || split_part(split_part(split_part(split_part(url, '//', 2), '#', 1), '?', 1), '/', 3) AS path FROM pages)
    SELECT page_id, CASE WHEN starts_with(path, '/en/') THEN '/english/' WHEN starts_with(path, '/de/') THEN '/german/' WHEN path = '/es' THEN '/spanish/' END AS target, (CASE WHEN starts_with(path, '/de/') THEN 302 ELSE 301 END)::INT AS code FROM p WHERE starts_with(path, '/en/') OR starts_with(path, '/de/') OR path = '/es'""")
def redirect_lookup(spark, sf_dir):
    clean = F.split_part(F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    path = F.concat(F.lit("/"), F.split_part(clean, F.lit("/"), F.lit(2)), F.lit("/"), F.split_part(clean, F.lit("/"), F.lit(3)))
    pages = A.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    rules = website.parse_redirects(spark.createDataFrame(list(enumerate(RULES)), "n int, value string"))
    return website.redirect(pages, rules, key="page_id").select("page_id", "target", "code")


EVENTS = [("Tuesday", 20, True, None), ("Friday", 10, None, True), ("Hidden", 1, False, True), ("Late", None, True, False)]


@query("SELECT * FROM (VALUES ('Friday', 10, true), ('Tuesday', 20, false), ('Late', 99, false)) t(title, \"order\", featured)")
def events_order(spark, sf_dir):
    e = spark.createDataFrame(EVENTS, "title string, order int, published boolean, featured boolean")
    return website.published(e).select("title", "order", F.coalesce("featured", F.lit(False)).alias("featured"))


@query("SELECT '<url><loc>' || url || '</loc></url>' AS value FROM pages WHERE url IS NOT NULL AND page_id % 10 <> 0")
def sitemap(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 10 == 0).alias("noindex"))
    return website.sitemap(p, "https://x")


@query("SELECT (i)::INT AS i, printf('post-2024-01-01-%02d', i + 1) AS slug, list_extract(['a', 'b', 'c'], 1 + i % 3) AS preset FROM (SELECT unnest(range(7)) AS i)")
def week_plan(spark, sf_dir):
    return report.plan_week(spark, 7, ["a", "b", "c"], "2024-01-01")


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def click_counts(spark, sf_dir):
    """Tumbling windows; the streaming form is in shoal.streaming."""
    from shoal.streaming import live

    c = live.click_counts(A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return c.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")


# --- probes, captions, crops, pages: operators of a row ---------------------------------------------

@query("""SELECT p_partkey, round_even(CASE WHEN p_size % 7 <= 1 OR p_size / 25.0::DOUBLE <= 0.2 THEN NULL ELSE 0.05::DOUBLE * (p_size / 25.0::DOUBLE) + 0.9::DOUBLE * (p_size / 25.0::DOUBLE) * k / greatest(1, p_size % 7 - 1) END, 4) AS at
    FROM (SELECT p_partkey, p_size, unnest(CASE WHEN p_size % 7 <= 1 OR p_size / 25.0::DOUBLE <= 0.2 THEN [0] ELSE range(p_size % 7) END) AS k FROM part)""")
def seek_points(spark, sf_dir):
    points = files.seek_points(F.col("p_size") / 25.0, F.col("p_size") % 7)
    return A.table(spark, sf_dir, "part").select("p_partkey", F.explode(points).alias("at")).select("p_partkey", r4(F.col("at"), "at"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 4 IN (1, 3) THEN 100 + p_size ELSE 200 + p_size END::INT AS width, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 4 IN (1, 3) THEN 200 + p_size ELSE 100 + p_size END::INT AS height,
    CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.5::DOUBLE ELSE 0 END::DOUBLE AS duration, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_size % 4 = 0 THEN 0 ELSE round_even(30000.0::DOUBLE / (1000 + p_size), 4) END::DOUBLE AS fps, p_partkey % 6 = 0 AS has_audio, CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_size END AS created FROM part""")
def probe_rows(spark, sf_dir):
    """Probe JSON with turned frames, missing streams and odd rates, read to typed columns."""
    k, s = F.col("p_partkey"), F.col("p_size")
    video = F.format_string(
        '{"codec_type": "video", "width": %d, "height": %d, "avg_frame_rate": "%s", "tags": {"rotate": "%d"}}', s + 200, s + 100,
        F.when(s % 4 == 0, "0/0").otherwise(F.concat(F.lit("30000/"), (s + 1000).cast("string"))), k % 4 * 90,
    )
    streams = F.array_join(F.array_compact(F.array(F.when(k % 6 == 0, '{"codec_type": "audio"}'), F.when(k % 5 != 0, video))), ", ")
    head = F.array_join(F.array_compact(F.array(F.when(k % 3 == 0, F.concat(F.lit('"duration": "'), (s * 0.5).cast("string"), F.lit('"'))), F.when(k % 2 == 0, F.format_string('"tags": {"Creation_Time": "d%d"}', s)))), ", ")
    info = files.probe_info(F.concat(F.lit('{"format": {'), head, F.lit('}, "streams": ['), streams, F.lit("]}")))
    p = A.table(spark, sf_dir, "part").select("p_partkey", info.alias("i"))
    return p.select("p_partkey", "i.width", "i.height", "i.duration", r4(F.col("i.fps"), "fps"), "i.has_audio", "i.created")


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS body, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN split_part(lower(p_name), ' ', 1) ELSE 'see more' END AS cta, '#' || lower(p_brand) AS tag, least(1::DOUBLE, p_size::DOUBLE / 40) AS v FROM part)
    SELECT p_partkey, body || CASE WHEN contains(body, cta) THEN '' ELSE chr(10) || chr(10) || cta END || chr(10) || chr(10) || tag || ' #x' AS caption, array_to_string(list_transform(string_split(body, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title,
    array_to_string(list_transform(string_split(body, ' '), lambda w: array_to_string(string_split(w, ''), ' ')), '   ') AS spaced, repeat('#', round_even(v * 20, 0)::INT) || repeat('-', 20 - round_even(v * 20, 0)::INT) AS meter FROM p""")
def caption_texts(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    body, s = F.lower("p_name"), F.col("p_size")
    cta = F.when(s % 3 == 0, "").when(s % 3 == 1, F.split_part(body, F.lit(" "), F.lit(1))).otherwise("see more")
    tags = F.array(text.hashtag(F.lower("p_brand")), text.hashtag(F.lit("#x")))
    return p.select("p_partkey", text.full_caption(body, cta, tags).alias("caption"), text.title_case(body).alias("title"), text.tracked(body, 6).alias("spaced"), text.meter(s / 40.0).alias("meter"))


_SEEDED = "('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4"


@query(f"SELECT o_orderkey, list_extract([{', '.join(repr(f'{d} {h}') for d, h in report.WINDOWS)}], 1 + {_SEEDED}) AS posting_window FROM orders")
def posting_windows(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", report.suggested_window(F.col("o_orderkey")).alias("posting_window"))


@query("""SELECT p_partkey, greatest(3, round_even((p_size + 4) / greatest(0.6::DOUBLE, least(2.4::DOUBLE, 1.5::DOUBLE * (60.0::DOUBLE / (60 + p_size)))), 0))::INT AS shots FROM part""")
def shot_counts(spark, sf_dir):
    s = F.col("p_size")
    n = timeline.suggest_shot_count(s + 4, (s + 60).cast("double"), F.array(F.lit(1), F.lit(2)), F.lit(0.6), F.lit(2.4))
    return A.table(spark, sf_dir, "part").select("p_partkey", n.alias("shots"))


@query("""WITH p AS (SELECT p_partkey, (1 + p_size) * 20 AS w, 640 AS h, (p_partkey % 21)::DOUBLE / 20 AS x, (p_partkey % 13)::DOUBLE / 12 AS y, (p_partkey % 10)::DOUBLE / 10 AS conf, 0.5625::DOUBLE AS t FROM part),
    a AS (SELECT *, w::DOUBLE / h AS aspect, w::DOUBLE / h > t AS wide, CASE WHEN w::DOUBLE / h > t THEN t / (w::DOUBLE / h) ELSE (w::DOUBLE / h) / t END AS share FROM p)
    SELECT p_partkey, CASE WHEN moved THEN CASE WHEN wide THEN 'x' ELSE 'y' END END AS axis, CASE WHEN moved THEN round_even(greatest(0::DOUBLE, least(1::DOUBLE, (CASE WHEN wide THEN x ELSE y END - share / 2) / (1 - share))), 4) END AS fraction,
    greatest(0, least(w - 360, round_even(x * w - 180, 0)))::INT AS start FROM (SELECT *, conf >= 0.12::DOUBLE AND abs(aspect - t) > 1e-6::DOUBLE AS moved FROM a) z""")
def crop_positions(spark, sf_dir):
    k, w = F.col("p_partkey"), (F.col("p_size") + 1) * 20
    x, y = k % 21 / 20.0, k % 13 / 12.0
    at = signal.crop_position(x, y, k % 10 / 10.0, w, F.lit(640), 0.5625)
    p = A.table(spark, sf_dir, "part").select("p_partkey", at.alias("c"), signal.crop_offset(x, w, F.lit(360)).alias("start"))
    return p.select("p_partkey", "c.axis", r4(F.col("c.fraction"), "fraction"), "start")


@query("SELECT conv_id, turn, (row_number() OVER w)::INT AS index, lead(turn) OVER w IS NULL AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def loop_marks(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return website.loop_marks(c, "conv_id", "turn").select("conv_id", "turn", F.col("index").cast("int").alias("index"), "last")


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source, 'none') AS shown FROM documents WHERE doc_id % 2 = 0 AND coalesce(lang, '') <> ''""")
def announcements(spark, sf_dir):
    """What is enabled and has a text, with the first of several options that isn't empty."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("lang").alias("text"), (F.col("doc_id") % 2 == 0).alias("enabled"))
    shown = text.first_truthy(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source"), F.lit("none"))
    return website.announcement(d).select("doc_id", shown.alias("shown"))


@query("""SELECT n_regionkey AS plan, n::INT AS n, '## ' || n || '. ' || n_name || chr(10) || '- shots: ' || n_nationkey || chr(10) || '- sources: a, ' || lower(n_name) || chr(10) || '- caption: c' AS section
    FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS n FROM nation)""")
def posting_sections(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    posts = n.select(F.col("n_regionkey").alias("plan"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("string").alias("shots"), F.array(F.lit("a"), F.lower("n_name")).alias("sources"), F.lit("c").alias("caption"))
    return report.posting_plan(posts, "title")


@query("""SELECT ts_day, website_day, count(*) AS n FROM (SELECT dayname(ts) AS ts_day, substr(dayname(ts), 1, 3) AS website_day FROM events) GROUP BY ALL""")
def short_days(spark, sf_dir):
    day = F.date_format("ts", "EEEE")
    return A.table(spark, sf_dir, "events").groupBy(day.alias("ts_day"), website.short_day(day).alias("website_day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.key AS a, b.key AS b, round_even(a.labs[1][1] + (b.labs[1][1] - a.labs[1][1]) * 0.25::DOUBLE, 4) AS lightness FROM profiles a, profiles b""".replace("SELECT a", f"WITH {A.PROFILES} SELECT a", 1))
def blended_colours(spark, sf_dir):
    """A quarter of the way from one profile's first colour to another's; the dimension has a fixed number of rows."""
    p = profiles(spark).select("key", selection.lab_of(F.col("palette_hex"))[0].alias("lab"))
    mixed = numbers.blend(F.col("x.lab"), F.col("y.lab"), 0.25)
    return p.alias("x").join(F.broadcast(p.alias("y"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), r4(mixed[0], "lightness"))

