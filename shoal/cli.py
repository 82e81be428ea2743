"""Commands over the pipelines: init, scan, presets, boards, preview, make, batch, status, doctor."""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shoal.operators import ledger, library
from shoal.plans import studio
from shoal.plans.profiles import profiles
from shoal.session import session
from shoal.sources import files


def _tables(spark: SparkSession, project: str):
    assets = files.read_table(spark, f"{project}/library", library.SCHEMA, studio.INDEX_VERSION)
    return assets, files.read_table(spark, f"{project}/posts", ledger.SCHEMA)


def _requests(args, presets: list[str], settings) -> list[studio.Request]:
    now = time.time()
    return [studio.Request(p, args.slug or f"{args.prefix}-{k + 1:02d}-{p}", args.duration, args.bpm, now=now, cooldown_days=settings["cooldown_days"], min_quality=settings["min_quality"], hooks=args.hook, seed=args.seed) for k, p in enumerate(presets)]


VERSION = "0.2.0"
# The filters that rendering asks of ffmpeg.
FILTERS = ["xfade", "zoompan", "colorbalance", "vignette", "noise", "drawtext", "gblur", "tpad", "blend", "eq", "scale", "crop", "afade", "atrim"]


def missing_filters(listing: str, required: list[str] = FILTERS) -> list[str]:
    """Required ones that a printed list of filters (flags, name, kinds, text) lacks."""
    have = {parts[1] for parts in map(str.split, listing.splitlines()) if len(parts) > 2}
    return [f for f in required if f not in have]


def _doctor(assets) -> int:
    missing = [t for t in ("ffmpeg", "ffprobe") if shutil.which(t) is None]
    if "ffmpeg" not in missing:
        missing += missing_filters(subprocess.run(["ffmpeg", "-hide_banner", "-filters"], capture_output=True, text=True, timeout=60, check=False).stdout)
    library.stats(assets).show(50)
    library.failure_breakdown(assets).show()
    print("missing:", ", ".join(missing) or "nothing")
    return int(bool(missing))


def _scan(spark: SparkSession, args, settings, path: str) -> int:
    roots = args.roots or settings["roots"] or files.default_roots(os.path.expanduser("~"))
    if not roots:
        print("no folders to scan", file=sys.stderr)
        return 1
    found = studio.scan(spark, roots, f"{args.project}/library", studio.from_probes, force=args.force, limit=args.limit)
    if not settings["roots"]:
        settings.override(roots=roots).save(path)
    if not args.quiet:
        library.stats(found).show(50)
        library.failure_breakdown(found).show()
    if args.verbose:
        found.where("error is not null").select("path", "error").show(1000, truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shoal")
    top.add_argument("--project", default=".shoal")
    top.add_argument("--version", action="version", version=VERSION)
    top.add_argument("--verbose", action="store_true")
    top.add_argument("--quiet", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("roots", nargs="*")
    init.add_argument("--preset")
    scan = sub.add_parser("scan")
    scan.add_argument("roots", nargs="*")
    scan.add_argument("--force", action="store_true")
    scan.add_argument("--limit", type=int)
    for name in ("doctor", "presets", "status"):
        sub.add_parser(name)
    boards = sub.add_parser("boards")
    boards.add_argument("--shots", type=int, default=8)
    for name in ("preview", "make", "batch"):
        p = sub.add_parser(name)
        p.add_argument("--preset", "--presets", action="append", default=[])
        p.add_argument("--hook", action="append", default=[])
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--slug", default="")
        p.add_argument("--prefix", default="post")
        p.add_argument("--duration", type=float, default=12.0)
        p.add_argument("--bpm", type=float, default=100.0)
        p.add_argument("--count", type=int, default=7 if name == "batch" else 1)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    path = f"{args.project}/settings.json"
    settings = files.Settings.load(path)
    if args.command == "init":
        os.makedirs(args.project, exist_ok=True)
        settings.override(roots=args.roots or files.default_roots(os.path.expanduser("~")) or None, preset=args.preset).save(path)
        return 0
    spark = session()
    assets, posts = _tables(spark, args.project)
    if args.command == "presets":
        profiles(spark).select("key", "palette_hex", "keywords").orderBy("key").show(50, truncate=False)
    elif args.command == "status":
        studio.status(assets, posts, time.time(), settings["cooldown_days"]).show()
        ledger.preset_counts(posts).orderBy("preset").show(50)
        ledger.recent(posts, 10).select("slug", "preset", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd").alias("day")).show()
    elif args.command == "doctor":
        return _doctor(assets)
    elif args.command == "scan":
        return _scan(spark, args, settings, path)
    elif args.command == "boards":
        studio.leaderboard(spark, assets, posts, time.time(), args.shots, settings["cooldown_days"]).show(50, truncate=False)
    else:
        keys = [k for p in args.preset for k in p.split(",")] or [settings["preset"] or "parisian"]
        requests = _requests(args, [keys[k % len(keys)] for k in range(args.count)], settings)
        boards, errors, after = studio.make_batch(spark, requests, assets, posts)
        for b in [] if args.quiet else boards:
            b.shots.select("slug", "place", "path", "start", "length", "motion", "transition").orderBy("place").show(50, truncate=False)
        for e in errors:
            print(e, file=sys.stderr)
        if args.command != "preview" and boards:
            files.save_table(after, f"{args.project}/posts")
        return int(not boards)
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except KeyboardInterrupt:
        sys.exit(130)
