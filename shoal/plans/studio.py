"""Parametrised pipelines: refreshing the catalogue, one board, a batch that shares its history, status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import numbers, text
from shoal.operators import ledger, library, report, selection, signal, timeline
from shoal.plans.profiles import profiles
from shoal.session import cut
from shoal.sources import files

INDEX_VERSION = 1
MOTIONS = ["push", "pull", "left", "right", "still"]


@dataclass
class Request:
    preset: str
    slug: str
    duration: float = 12.0
    bpm: float = 100.0
    offset: float = 0.0
    cooldown_days: float = 21.0
    min_quality: float = 0.35
    now: float = 0.0
    hooks: list[str] = field(default_factory=list)
    used: list[str] = field(default_factory=list)  # hooks to avoid while others are left
    seed: int = 0


@dataclass
class Board:
    """What a request makes: ordered shots, one-row copy, provenance, the new history row."""

    shots: DataFrame
    copy: DataFrame
    provenance: DataFrame
    post: DataFrame
    warnings: list[str]


def scan(spark: SparkSession, roots: list[str], index: str, analyse: Callable[[DataFrame], DataFrame], force: bool = False, limit: int | None = None) -> DataFrame:
    """Refresh the saved index: unchanged files keep their rows, all others are analysed; the rest of the old index goes.

    ``analyse`` maps (path, bytes, mtime, kind, source, fingerprint) to rows of the library's schema; what it can't
    read it returns with ``error`` set, so one bad file is a row and not a failed job.
    """
    old = files.read_table(spark, index, library.SCHEMA, INDEX_VERSION)
    found = files.candidates(spark, roots, limit)
    p = F.col("path")

    def described(df: DataFrame) -> DataFrame:
        return analyse(df.join(files.fingerprints(df), "path", "left").withColumns({"kind": text.kind(p), "source": text.source_label(p)}))

    fresh = cut(library.refresh(found, old.limit(0) if force else old, described))
    files.save_table(fresh, index, INDEX_VERSION)
    return files.read_table(spark, index, library.SCHEMA, INDEX_VERSION)


def from_probes(found: DataFrame) -> DataFrame:
    """An ``analyse`` for ``scan``: rows of the library's schema from the probe JSON beside each file. Colours and focus, which need
    decoded frames, stay null, and the quality is that of an ordinary exposure; a file without a probe is a row with an error."""
    rows = files.probe_sidecars(found).withColumn("info", files.probe_info(F.col("payload")))
    c = lambda name: F.col(f"info.{name}")
    quality = numbers.quality(c("width"), c("height"), F.lit(0.52), F.lit(0.2), F.col("kind") == "video", c("duration"))
    error = F.when(F.col("payload").isNull(), "no probe").when((c("width") <= 0) | (c("height") <= 0), "no picture")
    made = {n: c(n) for n in ("width", "height", "duration", "fps", "codec", "has_audio", "created")} | {"quality": quality, "error": error}
    want = found.sparkSession.createDataFrame([], library.SCHEMA).schema
    return rows.select(*[(made[f.name] if f.name in made else F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def features(assets: DataFrame) -> DataFrame:
    """Saved index rows -> the flat columns that scoring reads."""
    pal = F.col("palette")
    labs = F.transform(pal["swatches"], lambda s: numbers.lab(s["rgb"][0], s["rgb"][1], s["rgb"][2]))
    return library.derived(assets).select(
        "path", "kind", "width", "height", "duration", "quality", "error", "source", "mtime", "folder", text.stem(F.col("path")).alias("stem"), F.coalesce(labs, F.array().cast("array<array<double>>")).alias("labs"),
        F.coalesce(F.transform(pal["swatches"], lambda s: s["weight"]), F.array().cast("array<double>")).alias("swatch_weights"),
        *[pal[c].alias(c) for c in ("brightness", "contrast", "saturation", "warmth", "hue_spread")], pal["colorfulness"].alias("colorfulness"),
    )


def grid(spark: SparkSession, samples: DataFrame | None, bpm: float, duration: float) -> tuple[float, float, list[str]]:
    """(bpm, offset, warnings): a steady grid, or that of a track's samples (track, n, value)."""
    if samples is None:
        return min(300.0, max(20.0, bpm)), 0.0, []
    env = cut(signal.onset_envelope(samples))
    n, fps = env.count(), signal.RATE / signal.HOP
    if n < 16:
        return 100.0, 0.0, ["track too short"]
    low, high = max(2, int(fps * 60 / 180)), min(n - 2, int(fps))
    t = signal.tempo(signal.autocorrelation(env, "track", "i", "value", low, high), "track", fps).first()
    period = fps * 60 / t["bpm"]
    at = signal.phase(env, "track", "i", "value", F.lit(period), F.lit(max(16, int(4 * period))), F.lit(n)).first()
    return t["bpm"], at["offset"] / fps, ["tempo unsure"] if t["confidence"] < 0.15 else []


def make(spark: SparkSession, request: Request, assets: DataFrame, posts: DataFrame, dimension: DataFrame | None = None) -> Board:
    """Select, order and time a board that avoids what the history has cooling. Unknown profiles are an error."""
    dim = (profiles(spark) if dimension is None else dimension).where(F.col("key") == request.preset)
    preset = dim.first()
    if preset is None:
        raise KeyError(f"unknown profile {request.preset}; known: {', '.join(r['key'] for r in profiles(spark).select('key').collect())}")
    count = spark.range(1).select(timeline.suggest_shot_count(F.lit(request.duration), F.lit(request.bpm), F.array(*map(F.lit, preset["beats_per_shot"])), F.lit(preset["min_shot"]), F.lit(preset["max_shot"]))).first()[0]
    blocked = ledger.cooling(posts, request.cooldown_days, F.lit(request.now))
    pool = library.eligible(features(assets), blocked, min_quality=request.min_quality)
    scored = selection.score(pool, dim)
    chosen = cut(selection.greedy_diverse(scored, count, ratio=preset["video_ratio"]))
    n = chosen.count()
    if not n:
        raise ValueError("nothing is left to choose from")
    picked = chosen.select("path", F.col("score").alias("own_score")).join(pool, "path")
    loud = numbers.energy(F.col("colorfulness"), F.col("contrast"), F.col("brightness"), F.col("kind") == "video")
    ordered = selection.weave(picked.withColumns({"slug": F.lit(request.slug), "energy": loud}), "slug", "energy", "own_score")
    total = max(n, round(request.duration / (60.0 / request.bpm)))
    beats = timeline.allocate_beats(spark.createDataFrame([(request.slug, total, n, list(preset["beats_per_shot"]))], "board string, total int, shots int, options array<int>"))
    timed = ordered.join(beats.select((F.col("index") + 1).cast("long").alias("place"), "beats"), "place")
    cuts = timeline.plan_cuts(timed, "slug", "place", "beats", F.lit(60.0 / request.bpm))
    shots = timeline.shot_spans(timeline.transition_lengths(cuts, "slug", "place", F.lit(preset["transition_seconds"])), "slug", "place")
    unit = F.pmod(text.seed31(F.lit(request.slug), F.lit(request.seed), F.col("path")), F.lit(1000)) / 1000.0
    clip = timeline.fit_video(F.col("duration"), F.col("length"), unit)
    shots = cut(shots.withColumns({"motion": timeline.cycle(MOTIONS, F.col("place")), "transition": timeline.cycle(list(preset["transitions"]), F.col("place")), "clip": F.when(F.col("kind") == "video", clip)}))
    bad = timeline.verify(shots, "slug", "place").collect()
    if bad:
        raise ValueError(f"timeline: {bad}")
    listed = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    hook = report.pick(listed(request.hooks), listed(request.used), F.lit(f"{request.slug}:{request.seed}"))
    copy = spark.range(1).select(F.lit(request.slug).alias("slug"), hook.alias("hook"), report.suggested_window(F.lit(request.slug)).alias("window"))
    origin = report.provenance(shots.withColumn("board", F.col("slug")), report.source_notes(spark))
    post = shots.groupBy("slug").agg(F.lit(request.preset).alias("preset"), F.lit(float(request.now)).alias("created_at"), F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("assets"), F.lit("").alias("output"), F.max("cut").alias("duration"))
    warn = [w for r in selection.warnings(selection.summarize(chosen.join(pool.select("path", "kind", "source"), "path")), count).collect() for w in r["warnings"]]
    return Board(shots, copy, origin, post.select("slug", "preset", "created_at", "assets", "output", "duration"), warn)


def make_batch(spark: SparkSession, requests: list[Request], assets: DataFrame, posts: DataFrame) -> tuple[list[Board], list[str], DataFrame]:
    """Boards in order, each avoiding the assets and hooks of those before it; a request that fails is reported and the rest go on."""
    boards, errors, said = [], [], {}
    for r in requests:
        try:
            board = make(spark, replace(r, used=[*r.used, *said.get(r.preset, [])]), assets, posts)
        except (KeyError, ValueError) as e:
            errors.append(f"{r.slug}: {e}")
            continue
        boards.append(board)
        said.setdefault(r.preset, []).extend(x["hook"] for x in board.copy.select("hook").collect() if x["hook"])  # one row
        posts = cut(ledger.upsert(posts, board.post))
    return boards, errors, posts


def leaderboard(spark: SparkSession, assets: DataFrame, posts: DataFrame, now: float, shots: int = 8, cooldown_days: float = 21.0) -> DataFrame:
    """A row per profile, best mean first; a profile without a selection scores 0."""
    dim = profiles(spark)
    pool = library.eligible(features(assets), ledger.cooling(posts, cooldown_days, F.lit(now)))
    top = selection.greedy_diverse(selection.score(pool, dim), shots)
    found = selection.summarize(top.join(pool.select("path", "kind", "source"), "path"))
    out = dim.select(F.col("key").alias("preset")).join(found, "preset", "left").na.fill(0, ["n", "videos", "photos"]).na.fill(0.0, ["mean_score", "min_score"])
    return out.withColumn("meter", text.meter(F.col("mean_score"))).orderBy(F.desc("mean_score"), "preset")


def status(assets: DataFrame, posts: DataFrame, now: float, cooldown_days: float = 21.0) -> DataFrame:
    """One row: the history's summary and how many assets are available."""
    free = ledger.available(assets, ledger.cooling(posts, cooldown_days, F.lit(now))).agg(F.count(F.lit(1)).alias("available"))
    return ledger.summary(posts, ledger.uses(posts), F.lit(now)).crossJoin(free)  # one row each


def contact_grid(n: int, columns: int = 5) -> tuple[int, int, int]:
    """Columns, rows and blank cells of a sheet of n tiles."""
    cols = min(columns, n) or 1
    rows = -(-n // cols)
    return cols, rows, cols * rows - n


def chunked(items: DataFrame, order: str, size: int) -> DataFrame:
    """chunk: items in order, so many to a chunk. Consecutive numbers of a whole table are one window; for reports."""
    return items.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size))
