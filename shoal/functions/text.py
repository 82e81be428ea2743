"""Column expressions on paths, names and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# File kinds by suffix, folders never entered, marks of junk, and source labels in order of precedence.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".tif", ".tiff", ".bmp", ".avif", ".jxl"]
VIDEO_SUFFIXES = [".mp4", ".mov", ".m4v", ".mkv", ".webm", ".avi", ".mts", ".m2ts", ".mpg", ".mpeg", ".wmv", ".flv"]
AUDIO_SUFFIXES = [".mp3", ".m4a", ".wav", ".aac", ".flac", ".ogg", ".aiff", ".aif"]
PRUNED_FOLDERS = [".git", ".svn", "node_modules", "__pycache__", "Library", ".Trash", ".cache", "venv", ".venv", "renders", "out", "derivatives", "resources", "database", "private", "external"]
JUNK_MARKS = ["thumb", "thumbnail", "preview", "watermark", "sample", "proxy", "screenshot", "_lr", "contact-sheet"]
SOURCE_MARKS = [
    ("envato", "envato"), ("elements", "envato"), ("videohive", "envato"), ("photodune", "envato"), ("artgrid", "artgrid"),
    ("storyblocks", "storyblocks"), ("adobe stock", "adobe-stock"), ("adobestock", "adobe-stock"), ("shutterstock", "shutterstock"),
    ("unsplash", "unsplash"), ("pexels", "pexels"), ("/photos library", "photos-library"), ("photos library.photoslibrary", "photos-library"),
    ("dcim", "camera"), ("/camera roll", "camera"),
]
# Advance widths in thousandths of the type size.
WIDTHS = {" ": 300, "\t": 300, "i": 240, "j": 260, "l": 240, "t": 330, "f": 330, "r": 350, "I": 290, "m": 850, "w": 740, "M": 880, "W": 920, ".": 290, ",": 290, ":": 290, ";": 290, "'": 220, "!": 300, "|": 260, '"': 380, "(": 340, ")": 340, "-": 360, "?": 500}
WIDTH_LOWER, WIDTH_UPPER, WIDTH_DIGIT = 545, 680, 560


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased ``.ext``; empty if there is none (a leading dot starts a name, not a suffix)."""
    return F.lower(F.regexp_extract(name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=[^.])\.[^.]+$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(IMAGE_SUFFIXES), "image").when(s.isin(VIDEO_SUFFIXES), "video").when(s.isin(AUDIO_SUFFIXES), "audio")


def is_junk(path: Column) -> Column:
    n, s = name(path), F.lower(stem(path))
    found = n.startswith("._") | (F.lower(n) == ".ds_store")
    for mark in JUNK_MARKS:
        found = found | s.contains(mark)
    return found


def is_pruned(path: Column, root: str = "") -> Column:
    """Does a folder below ``root`` make the walk skip this file?"""
    parts = F.split(F.substring(folder(path), len(root) + 1, 1 << 20), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, PRUNED_FOLDERS))) | F.exists(parts, lambda p: p.startswith("."))


def source_label(path: Column) -> Column:
    low, out = F.lower(path), None
    for mark, label in SOURCE_MARKS:
        out = (F if out is None else out).when(low.contains(mark), label)
    return out.otherwise("local")


def plain(path: Column) -> Column:
    """Lower case, with blanks for ``_`` and ``-``: what keywords are looked for in."""
    return F.translate(F.lower(path), "_-", "  ")


def keyword_bonus(plain_text: Column, keywords: Column) -> Column:
    """Half for each keyword that a ``plain`` text has, one at most.

    Make ``plain`` a column before a join with keywords: inside the lambda it would be made anew for each.
    """
    return F.least(F.lit(1.0), F.size(F.filter(keywords, lambda k: F.contains(plain_text, k))) / 2.0)


def literal_bonus(plain_text: Column, keywords: list[str]) -> Column:
    """The same for keywords that are known when the query is made: searches without a lambda, compiled into the stage."""
    found = sum((F.contains(plain_text, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    return F.least(F.lit(1.0), found / 2.0)


def common_prefix(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))), F.lit(0))


def shared_stem(a: Column, b: Column) -> Column:
    """Equal stems, or a common beginning of eight characters and three quarters of the shorter at least."""
    shorter = F.least(F.length(a), F.length(b))
    return (a == b) | ((shorter >= 8) & (common_prefix(a, b) >= F.greatest(F.lit(8), F.floor(shorter * 0.75).cast("int"))))


def slug_ascii(text: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.rtrim(F.substring(F.trim(s, F.lit("-")), 1, most), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


@F.pandas_udf(StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slugify(text: Column, most: int = 60) -> Column:
    """Any script: compatibility decomposition has no built-in function."""
    return slug_ascii(_ascii(text), most)


def human_duration(seconds: Column) -> Column:
    s = F.bround(seconds, 1)
    return F.format_string("%d:%04.1f", F.floor(s / 60), s - 60 * F.floor(s / 60))


def stable_seed(*parts: Column) -> Column:
    """The first 64 bits of a SHA-256, as decimal(20,0)."""
    joined = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seed31(*parts: Column) -> Column:
    joined = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.sha2(joined, 256), 9, 8), 16, 10).cast("long"), F.lit(1 << 31))


def full_caption(body: Column, cta: Column, tags: Column) -> Column:
    asked = F.when(~F.contains(body, cta), cta)
    return F.trim(F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.nullif(asked, F.lit("")), F.nullif(F.array_join(tags, " "), F.lit(""))))


def hashtag(word: Column) -> Column:
    return F.when(word.startswith("#"), word).otherwise(F.concat(F.lit("#"), word))


def title_case(text: Column) -> Column:
    """The first letter of each word upper; the rest as it was."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def width(text: Column, size: float = 1000.0) -> Column:
    """Summed advance widths at a type size."""
    total = F.lit(0)
    known = "".join(WIDTHS)
    groups: dict[int, str] = {}
    for c, w in WIDTHS.items():
        groups[w] = groups.get(w, "") + c
    rest = F.translate(text, known, "")
    for w, chars in groups.items():
        total = total + (F.length(text) - F.length(F.translate(text, chars, ""))) * w
    digits = F.length(rest) - F.length(F.regexp_replace(rest, r"\p{Nd}", ""))
    upper = F.length(rest) - F.length(F.regexp_replace(rest, r"\p{Lu}", ""))
    return (total + digits * WIDTH_DIGIT + upper * WIDTH_UPPER + (F.length(rest) - digits - upper) * WIDTH_LOWER) * size / 1000.0


def tracked(text: Column, level: int) -> Column:
    """From level 5 on, letters are set apart by blanks and words by three."""
    if level < 5:
        return text
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.array_join(F.filter(F.split(w, ""), lambda c: c != ""), " ")), "   ")


def meter(value: Column, cells: int = 20) -> Column:
    n = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * cells).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(cells) - n))


def rate(text: Column) -> Column:
    """``30000/1001`` -> 29.97...; 0 where it can't be told."""
    parts = F.split(text, "/")
    top, low = parts[0].try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0))
    return F.coalesce(F.try_divide(top, low), F.lit(0.0))


def safe_double(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def tracking_parts(track: Column) -> tuple[Column, Column]:
    """``name:placement``, the placement empty if there is none."""
    return F.split_part(track, F.lit(":"), F.lit(1)), F.split_part(track, F.lit(":"), F.lit(2))


def clock_minutes(hhmm: Column) -> Column:
    return F.split_part(hhmm, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(hhmm, F.lit(":"), F.lit(2)).cast("int")


def first_truthy(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])
