"""Near copies of texts: all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash
fingerprints and, beyond their reach, by minima.

Each text's fingerprint is the majority of its distinct shingles' hashes. Those within two bits are found as in ``simhash``
(segment popcounts, grid range-join), whose links connect all of them, however many.

A grid can't go much farther: at 0.8 fingerprints of 64 bits are expected to differ in about 10, and a search at such
distances meets nearly everything. So the pairs out of its reach come from ``HASHES`` minima of permuted shingle hashes
(MinHash): ``BANDS`` bands of ``HASHES // BANDS`` minima are cells, and documents that meet in a cell are candidates if at
least ``AGREE`` of their minima agree. A pair at 0.8 meets in no cell with a chance of 5e-8, and agrees less often with about
3e-8. Whatever found a pair, it is linked only if the whole shingle sets reach the threshold.

Most links are found in linear work: each text is compared with what its fingerprint is linked with, and with the one that
agrees best among the leaders (smallest keys) of its cells. What that leaves apart is compared in full, but only across the
components found so far: in a cell, and then in a group of texts that agree, the members outside the largest component meet
all others, in blocks of ``BLOCK``, and a task returns a spanning forest. So a dense cluster costs a comparison a member, no
group has to fit into one task, and no pairs are emitted.

Defined results: words are split and lower-cased as for fingerprints; a text of up to five words is one
shingle, and so is one without words, null included; repeated rows each get a row; null ids never name a component while
another id is there; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import graph, scratch, simhash
from shoal.llm.simhash import SEED, WORDS, _text_key

LEAST, HASHES, BANDS, AGREE, BLOCK = 0.8, 128, 32, 76, 256
MARKS = 1 << 26  # bits of a map of keys, whatever their number: 8 MB
_CHUNK = 512
_RNG = np.random.default_rng(SEED)
_MUL, _ADD = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of all word shingles, sorted."""
    found = simhash.hashes(text, words)
    return np.unique(found) if len(found) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def signature(found: np.ndarray) -> tuple[list[int], bytes]:
    """The cells, a hash of each band's minima; and a byte of each minimum."""
    low = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), _CHUNK):
        np.minimum(low, (found[k : k + _CHUNK, None] * _MUL + _ADD).min(axis=0), out=low)
    raw, width = low.tobytes(), 8 * HASHES // BANDS
    cells = np.array([xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)], np.uint64).view(np.int64)
    return cells.tolist(), (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def _raw(texts) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(_id, _text, text_key) -> (_id, text_key, fp, cells, sig): fp is the fingerprint of the distinct shingles as a signed long."""
    kinds = (pa.list_(pa.int64()), pa.binary())

    def run(batches):
        scratch.held(None)
        for b in _slices(batches):
            sets = [shingles(t, words) for t in _raw(b.column(1))]
            fp = pa.array(np.array([simhash.majority(x) for x in sets], np.uint64).view(np.int64))
            made = zip(*map(signature, sets), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp, *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], ["_id", "text_key", "fp", "cells", "sig"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, text_key long, fp long, cells array<long>, sig binary")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _grouped(batches, keys: int):
    """(key, rows) of runs of rows that agree in their first ``keys`` columns."""
    key, rows = None, []
    for b in _slices(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _edges(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _marks(keys: DataFrame):
    """A map, for workers, of the low bits of the one column's hashes: what isn't marked isn't among them. Joins that follow are exact,
    so it only spares them the rows that would find nothing."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(MARKS)) + 1
    rows = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in rows:
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _met(once: DataFrame) -> DataFrame:
    """once(k, cells) -> (grp, k, b): the cells where texts meet, with their leader, the smallest key."""
    cells = once.select("k", F.explode("cells").alias("grp"))
    lead = cells.groupBy("grp").agg(F.min("k").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "b")
    lead = scratch.stage(lead, "leads", codec="snappy")
    marks = _marks(lead.select("grp"))

    def busy(batches):
        for b in batches:
            grp = b.column(1).flatten().to_numpy()
            hit = _marked(marks.value, grp)
            keys = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(grp[hit])], ["k", "grp"])

    return scratch.stage(once.select("k", "cells").mapInArrow(busy, "k long, grp long").join(lead, "grp"), "met")


def _by_fingerprint(once: DataFrame) -> DataFrame:
    """once(k, fp) -> (a, b): texts with fingerprints within two bits, so that all such are connected; each fingerprint's smallest key stands for it."""
    fps = scratch.stage(once.groupBy("fp").agg(F.min("k").alias("b"), F.count(F.lit(1)).alias("n")), "fps")
    same = once.select(F.col("k").alias("a"), "fp").join(fps.where("n > 1"), "fp").where("a <> b").select("a", "b")
    near = scratch.stage(simhash.links(fps.select("fp")), "fp_links")
    ends = [fps.select(F.col("fp").alias(x), F.col("b").alias(f"{x}_k")) for x in ("a", "b")]
    return same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_k").alias("a"), F.col("b_k").alias("b")))


def _best_leaders(met: DataFrame) -> DataFrame:
    """(a, b): for each text that meets others, the leader that it shares the most cells with."""
    pairs = met.where("k <> b").groupBy(F.col("k").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def _slices(batches, rows: int = 1000):
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those (a, b) whose sets reach ``least``; the set of b goes once to every ``BLOCK`` or so of its a."""
    parts = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    tails = edges.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("a").alias("k"))
    heads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("b").alias("k"))
    dealt = heads.unionByName(tails).join(sets, "k").select("b", "part", "side", "k", "data")
    dealt = dealt.repartition(_tasks(edges), "b", "part").sortWithinPartitions("b", "part", "side")

    def run(batches):
        head, own = None, None
        for batch in _slices(batches):
            found = []
            for b, part, side, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not side:
                    head, own = (b, part), _set(data)
                elif (b, part) == head and similarity(own, _set(data)) >= least:
                    found.append((k, b))
            yield _edges(found)

    return dealt.mapInArrow(run, "a long, b long")


def _across(members: DataFrame, values: DataFrame, join) -> DataFrame:
    """members(grp, k, comp) with values(k, sig, data) -> the links (a, b) that ``join`` gives between different components of a group.

    Members outside a group's largest component meet each other and all others; ``join`` gets the two sides.
    """
    per = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    per = per.groupBy("grp").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    per = per.select("grp", F.col("top.comp").alias("big"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("bigs"), F.ceil((F.col("n") - F.col("top.m")) / BLOCK).cast("int").alias("smalls"))
    per = scratch.stage(per, "across", codec="snappy")
    small = F.col("comp") != F.col("big")
    placed = members.join(per, "grp").join(values, "k").withColumn("own", F.pmod(F.xxhash64("k"), F.when(small, F.col("smalls")).otherwise(F.col("bigs"))).cast("int"))
    own = F.col("own")
    place = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), right.alias("right"))
    among = F.transform(F.sequence(F.lit(0), F.col("smalls") - 1), lambda x: place(F.least(own, x), F.greatest(own, x), own > x))
    to_big = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda x: place(own, -1 - x, F.lit(False)))
    from_small = F.transform(F.sequence(F.lit(0), F.col("smalls") - 1), lambda x: place(x, -1 - own, F.lit(True)))
    dealt = placed.withColumn("at", F.explode(F.when(small, F.concat(among, to_big)).otherwise(from_small)))
    dealt = dealt.select("grp", "at.i", "at.j", "at.right", "k", "comp", "sig", "data")
    dealt = dealt.repartition(_tasks(members), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "k")

    def run(batches):
        for (_, i, j), rows in _grouped(batches, 3):
            left, right = ([r[1:] for r in rows if r[0] == side] for side in (False, True))
            if i == j:  # a block of small ones with itself
                right = left
            if left and right:
                yield _edges(join(left, right))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _agreeing(left: list[tuple], right: list[tuple]):
    """(i, j) of texts of different components whose minima agree, best first."""
    x, y = (np.frombuffer(b"".join(r[2] for r in side), np.uint8).reshape(-1, HASHES) for side in (left, right))
    cx, cy = (np.array([r[1] for r in side], np.int64) for side in (left, right))
    found = []
    for i in range(len(x)):
        n = (y == x[i]).sum(axis=1)
        found += [(-int(n[j]), i, j) for j in np.flatnonzero((n >= AGREE) & (cy != cx[i])).tolist()]
    return [(i, j) for _, i, j in sorted(found)]


class _Sets(dict):
    """Disjoint sets of any values."""

    def root(self, i):
        while self.get(i, i) != i:
            self[i] = i = self.get(self[i], self[i])
        return i

    def link(self, i, j) -> bool:
        a, b = self.root(i), self.root(j)
        self[a] = b
        return a != b


def _near(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    comps = _Sets()
    return [(left[i][0], right[j][0]) for i, j in _agreeing(left, right) if comps.link(left[i][1], right[j][1])]


def _similar(left: list[tuple], right: list[tuple], least: float) -> list[tuple[int, int]]:
    comps, out = _Sets(), []
    for i, j in _agreeing(left, right):
        a, b = left[i], right[j]
        if comps.root(a[1]) != comps.root(b[1]) and similarity(_set(a[3]), _set(b[3])) >= least:
            comps.link(a[1], b[1])
            out.append((a[0], b[0]))
    return out


def _named(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``members`` (k, ...) with comp: the component that ``parts`` gives, else the member itself."""
    return members.join(parts.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("comp", F.coalesce("component", "k")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row per input row: ``id_col``, component_id (smallest id reachable), text_key."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), _text_key(F.col(text_col)).alias("text_key"))
    prints = scratch.stage(signatures(slim, words), "minima")
    groups = scratch.stage(prints.groupBy(F.col("text_key").alias("k")).agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("m")), "groups")
    copied = not groups.where("m > 1").isEmpty()
    single = lambda df, name: scratch.stage(df.dropDuplicates(["k"]) if copied else df, name)
    once = prints.select(F.col("text_key").alias("k"), "fp", "cells", "sig")
    once = single(once, "once") if copied else once
    met = _met(once)
    first = scratch.stage(_best_leaders(met).unionByName(_by_fingerprint(once.select("k", "fp"))).distinct(), "first")
    once = once.select("k", "sig")

    def sets_of(keys: DataFrame) -> DataFrame:
        """The sets of (at least) these keys; texts aren't shuffled."""
        marks = _marks(keys)

        def shingled(batches):
            for b in batches:
                b = b.filter(pa.array(_marked(marks.value, b.column(0).to_numpy())))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).astype("<u8").tobytes() for t in _raw(b.column(1))], pa.binary())], ["k", "data"])

        return single(slim.select("text_key", "_text").mapInArrow(shingled, "k long, data binary"), "sets")

    sets = sets_of(first.select(F.col("a").alias("k")).union(first.select("b")))
    links = scratch.stage(_verified(first, sets, least), "links")
    parts = scratch.stage(graph.components(links), "parts")
    apart = scratch.stage(_across(_named(met.select("grp", "k"), parts), once.withColumn("data", F.lit(b"")), _near), "apart")
    if not apart.isEmpty():
        near = scratch.stage(graph.components(links.unionByName(apart)), "near")
        split = _named(near.select(F.col("node").alias("k"), F.col("component").alias("grp")), parts)
        many = split.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp")
        split = scratch.stage(split.join(many, "grp").select("grp", "k", "comp"), "split")
        lacking = scratch.stage(split.join(sets.select("k"), "k", "left_anti").select("k"), "lacking", codec="snappy")
        more = sets_of(lacking).join(lacking, "k", "left_semi")
        rest = _across(split, once.join(sets.unionByName(more), "k"), lambda x, y: _similar(x, y, least))
        links = scratch.stage(links.unionByName(rest), "links")
        parts = scratch.stage(graph.components(links), "parts")
    linked = groups.join(parts.select(F.col("node").alias("k"), "component"), "k", "left").where("m > 1 or component is not null")
    linked = scratch.stage(linked.select("k", "low", F.coalesce("component", "k").alias("component")), "linked")
    name = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    names = scratch.stage(linked.join(name, "component").select(F.col("k").alias("text_key"), "component_id"), "names", codec="snappy")
    return prints.join(names, "text_key", "left").select(F.col("_id").alias(id_col), F.coalesce("component_id", "_id").alias("component_id"), "text_key")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (rows that share it all stay)."""
    found = near_duplicates(docs, id_col, text_col, words, least)
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_k"), F.col("text_key").alias("_t")).distinct()
    gone = scratch.stage(gone, "gone", codec="snappy")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g._k")) & (_text_key(F.col(f"d.{text_col}")) == F.col("g._t"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")
