"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits becomes 16 counts of set bits, one per segment of 4 bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance, so fingerprints within 2 bits lie
within Manhattan distance 2 and share a grid point at distance at most 1 from both. Every distinct
fingerprint therefore goes to its own grid point and the up to 32 points one step away, and only those
that meet another there go on.

These are verified exactly, in time that is linear however many meet: a fingerprint at a grid point reaches the
(at most four) bit strings of these counts that differ from it by one bit, or itself at its own point. Two that reach the
same string are within 2 bits, and any two within 2 bits reach one string at one grid point; so each is linked
with the smallest fingerprint that reaches the string, which connects all that pairing would.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null id
never names a component while another id is there; repeated rows each get a row; extra columns of
the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm import graph, scratch

SEED, SEGMENTS, WIDTH = 42, 16, 4
WORDS = 5
_CHUNK = 1 << 15


def hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of the whole sequence if there are fewer words, none if there are none."""
    toks = text.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    buf = b" ".join(toks)
    if len(toks) <= words:
        return np.array([xxhash.xxh64_intdigest(buf, SEED)] if toks else [], np.uint64)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in toks)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    parts = map(buf.__getitem__, map(slice, starts, ends[words - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(toks) - words + 1)


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of ``h``."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _CHUNK):
        ones += _bit_counts(h[k : k + _CHUNK])
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) of all word shingles."""
    return majority(hashes(text, words))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set; bytes of 0 and 1 are first added 255 at a time, 8 to a machine word."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    packed = bits[:whole].view(np.uint64).reshape(-1, 255, 8).sum(axis=1)
    return packed.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(``id_col``, fp, text_key): fp is the fingerprint as a signed long, text_key a hash of the text."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), _text_key(F.col(text_col)).alias("text_key"))

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), b.column(2)], ["_id", "fp", "text_key"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, fp long, text_key long").withColumnRenamed("_id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grid(fp: Column) -> Column:
    """(cell, bits): the packed counts, 3 bits a segment, and all points one step away, with the bits that lead there."""
    masks = [F.lit(_signed(((1 << WIDTH) - 1) << (WIDTH * s))) for s in range(SEGMENTS)]
    count = [F.bit_count(fp.bitwiseAND(m)) for m in masks]
    own = count[0].cast("long")
    for s in range(1, SEGMENTS):
        own = own + count[s].cast("long") * F.lit(1 << (3 * s))
    point = lambda cell, bits: F.struct(cell.alias("cell"), bits.alias("bits"))
    steps = [point(own, F.lit(0).cast("long"))]
    for s in range(SEGMENTS):
        up, down = F.bitwise_not(fp).bitwiseAND(masks[s]), fp.bitwiseAND(masks[s])
        steps += [F.when(up != 0, point(own + F.lit(1 << (3 * s)), up)), F.when(down != 0, point(own - F.lit(1 << (3 * s)), down))]
    return F.array_compact(F.array(*steps))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) within two bits that connect all such pairs."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = fps.repartition(tasks, "fp").select("fp", F.inline(_grid(F.col("fp"))))
    busy = scratch.stage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell"), "cells", codec="snappy")
    single = F.array(*[F.lit(_signed(1 << k)) for k in range(64)])
    flips = F.when(F.col("bits") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(single, lambda bit: bit.bitwiseAND(F.col("bits")) != 0))
    reach = cells.join(busy, "cell").select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    reach = scratch.stage(reach, "reach")
    first = reach.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "b")
    return reach.join(first, "at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id (smallest id reachable), text_key."""
    prints = scratch.stage(fingerprints(docs, id_col, text_col, words).select(F.col(id_col).alias("_id"), "fp", "text_key"), "prints")
    groups = scratch.stage(prints.groupBy("fp").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("n")), "groups")
    parts = scratch.stage(graph.components(links(groups.select("fp"))), "parts")
    linked = groups.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    of = linked.where("n > 1 or component is not null").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    of = scratch.stage(of, "of")
    name = of.groupBy("component").agg(F.min("low").alias("component_id"))
    names = scratch.stage(of.join(name, "component").select("fp", "component_id"), "names", codec="snappy")
    return prints.join(names, "fp", "left").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "_id").alias("component_id"), "text_key"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (rows that share it all stay)."""
    found = near_duplicates(docs, id_col, text_col, words)
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_k"), F.col("text_key").alias("_t")).distinct()
    gone = scratch.stage(gone, "gone", codec="snappy")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g._k")) & (_text_key(F.col(f"d.{text_col}")) == F.col("g._t"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")
