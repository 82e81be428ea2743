"""Sources and sinks: file listings, probe results, JSON tables, front matter."""

from __future__ import annotations

import glob
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions import text

EDGE = 65_536
PROBE = (
    "struct<format:struct<duration:string,bit_rate:string,tags:map<string,string>>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,"
    "avg_frame_rate:string,r_frame_rate:string,duration:string,tags:map<string,string>,side_data_list:array<struct<rotation:double>>>>>"
)


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, bytes, mtime of all files below the roots, each once; contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    path = F.regexp_replace("path", "^file:", "")
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").cast("double").alias("mtime")).dropDuplicates(["path"])


def candidates(spark: SparkSession, roots: list[str], limit: int | None = None) -> DataFrame:
    """Images and videos that aren't junk or in pruned folders; filters precede any costly analysis."""
    p = F.col("path")
    keep = text.kind(p).isin("image", "video") & ~text.is_junk(p)
    pruned = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        pruned = pruned | (p.startswith(r + "/") & text.is_pruned(p, r))
    out = listing(spark, roots).where(keep & ~pruned)
    return out if limit is None else out.orderBy("path").limit(limit)


def fingerprints(found: DataFrame) -> DataFrame:
    """(path, bytes, mtime) -> (path, fingerprint): SHA-1 over size, modification second, and the first and last 64 KiB.

    Only these bytes are read, of the given files alone; one that can't be read has an empty fingerprint.
    """

    def one(path: str, size: int, mtime: float) -> str:
        digest = hashlib.sha1(f"{size}{int(mtime)}".encode())
        try:
            with open_file(path) as f:
                digest.update(f.read_at(min(size, EDGE), 0))
                if size > 2 * EDGE:
                    digest.update(f.read_at(EDGE, size - EDGE))
        except OSError:
            return ""
        return digest.hexdigest()

    def run(batches):
        for b in batches:
            path, size, mtime = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(one, path, size, mtime), pa.string())], ["path", "fingerprint"])

    return found.select("path", "bytes", "mtime").mapInArrow(run, "path string, fingerprint string")


def open_file(path: str):
    """A file on any system that pyarrow reaches, for reads at a place."""
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def probe_sidecars(found: DataFrame, ending: str = ".probe.json") -> DataFrame:
    """``found`` with payload: the probe's JSON beside each file, null where there is none."""

    def one(path: str) -> str | None:
        try:
            with open_file(path + ending) as f:
                return f.read().decode()
        except (OSError, UnicodeDecodeError):
            return None

    @F.arrow_udf("string")
    def payload(paths: pa.Array) -> pa.Array:
        return pa.array([one(p) for p in paths.to_pylist()], pa.string())

    return found.withColumn("payload", payload("path"))


def default_roots(home: str) -> list[str]:
    """Folders of a home that are worth scanning when none are named, and the originals inside photo libraries."""
    # Where media usually is.
    usual = ["Downloads", "Pictures", "Movies", "Desktop", "Documents/Envato", "Downloads/Envato Elements"]
    inner = sorted(glob.glob(os.path.join(glob.escape(home), "Pictures", "*.photoslibrary", "originals")))
    return [p for p in [*(os.path.join(home, u) for u in usual), *inner] if os.path.isdir(p)]


def seek_points(duration: Column, n: Column) -> Column:
    """Evenly spaced moments within the middle nine tenths; one null for very short clips or a single frame."""
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 0.05 * duration + 0.9 * duration * i / F.greatest(F.lit(1), n - 1))
    return F.when((duration <= 0.2) | (n <= 1), F.array(F.lit(None).cast("double"))).otherwise(many)


def probe_info(payload: Column) -> Column:
    """Probe JSON -> struct(width, height, duration, fps, codec, has_audio, created); zeros where nothing is there."""
    p = F.from_json(payload, PROBE)
    video = F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    tags = F.coalesce(F.transform_keys(p["format"]["tags"], lambda k, v: F.lower(k)), F.create_map().cast("map<string,string>"))
    own_tags = F.coalesce(video["tags"], F.create_map().cast("map<string,string>"))
    side = F.try_element_at(video["side_data_list"], F.lit(1))["rotation"]
    turn = F.pmod(F.coalesce(F.try_element_at(own_tags, F.lit("rotate")).try_cast("double"), -side, F.lit(0.0)), F.lit(360.0))
    swap = turn.isin(90.0, 270.0)
    w, h = F.coalesce(video["width"], F.lit(0)), F.coalesce(video["height"], F.lit(0))
    seconds = F.coalesce(p["format"]["duration"].try_cast("double"), video["duration"].try_cast("double"), F.lit(0.0))
    return F.struct(
        F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"), seconds.alias("duration"),
        F.coalesce(text.rate(video["avg_frame_rate"]), F.lit(0.0)).alias("fps"), F.coalesce(video["codec_name"], F.lit("")).alias("codec"),
        F.coalesce(F.exists(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"), F.try_element_at(tags, F.lit("creation_time")).alias("created"),
    )


def unpack_rgb(frames: DataFrame) -> DataFrame:
    """frames(path, frame, columns, data binary) -> pixels(path, frame, row, col, r, g, b); a partial last pixel is dropped."""

    def run(batches):
        for b in batches:
            for path, frame, columns, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(data or b"") // 3
                rgb = np.frombuffer(data or b"", np.uint8, 3 * n).reshape(n, 3).astype(np.int32)
                row, col = np.divmod(np.arange(n, dtype=np.int32), np.int32(columns or 1))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), *map(pa.array, (row, col, *rgb.T.copy()))], ["path", "frame", "row", "col", "r", "g", "b"])

    slim = frames.select(F.col("path").cast("string"), F.col("frame").cast("int"), F.col("columns").cast("int"), "data")
    return slim.mapInArrow(run, "path string, frame int, row int, col int, r int, g int, b int")


def read_table(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A saved table, or an empty one if it isn't there or has another version; unknown columns are ignored."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if version is not None:
        df = df.where(F.col("version") == version) if "version" in df.columns else df.limit(0)
    want = spark.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])


def save_table(df: DataFrame, path: str, version: int | None = None) -> None:
    (df if version is None else df.withColumn("version", F.lit(version))).write.mode("overwrite").parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; corrupt files give no rows."""
    df = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt is null").drop("_corrupt")


def front_matter(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Markdown files with ``key: value`` heads -> typed fields and body."""
    whole = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)

    def one(name: str, kind: str) -> Column:
        raw = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
        return F.nullif(F.regexp_replace(raw, "^[\"']|[\"']$", ""), F.lit("")).try_cast(kind).alias(name)

    return whole.select("file", *[one(k, t) for k, t in fields.items()], F.trim(F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---", "")).alias("body"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row, in a folder per slug."""
    df.select("slug", F.col("document").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


class Settings(dict):
    """Settings from a JSON file; unknown keys are ignored, missing ones take defaults, None overrides nothing."""

    DEFAULTS = {"roots": [], "output": "out", "music_dir": "", "handle": "", "preset": "", "min_quality": 0.35, "cooldown_days": 21.0}

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path) as f:
                data = json.load(f)
        except (OSError, ValueError):
            data = {}
        return cls(cls.DEFAULTS | {k: v for k, v in (data if isinstance(data, dict) else {}).items() if k in cls.DEFAULTS})

    def save(self, path: str) -> None:
        with open(path + ".part", "w") as f:
            json.dump(dict(sorted(self.items())), f, indent=2)
        os.replace(path + ".part", path)

    def override(self, **given) -> Settings:
        return Settings(self | {k: v for k, v in given.items() if v is not None})
