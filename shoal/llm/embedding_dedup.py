"""Embedding near-duplicates by randomly rotated binary codes (RaBitQ; Gao and Long, 2024).

A unit vector o is rotated by a fixed random orthogonal matrix and stored as its signs: the code
vector c of entries +-1/sqrt(D), with the correction factor a = <o, c>. For a unit vector q,
<q, c> / a estimates <q, o> without bias, and is off by more than e * sqrt((1 - a^2) / a^2) /
sqrt(D - 1) only with a probability that falls as exp(-e^2 / 2). A pair is recomputed exactly, in
double precision, unless that bound at e = ``CONFIDENCE`` (6: under 1e-7) or the angle between q and
c, which can't exceed that between o and c plus that between q and o, rules it out.

Equal vectors of a label are one class with a multiplicity. A label of up to ``DIRECT`` classes is one
bucket. A larger one is dealt to buckets of about that size by the signs of k random projections, in as
many independent tables as make the chance that a pair at the threshold shares no bucket less than
``MISS`` (1e-6; less still for closer pairs): work grows as n^1.2 or so instead of n^2. A pair counts in
the first table where it shares a bucket.

Buckets are cut into blocks of about ``BLOCK``, so that one of any size is many tasks; each pair of
blocks is one bounded task that returns a row per linked class (how many vectors it links with) and a
spanning forest of its links, never the pairs themselves.

Defined results: null labels, vectors that are null, empty or zero, and vectors with null or
non-finite components link with nothing; vectors of different length don't link; null ids are
vectors like any other; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import graph, scratch

THRESHOLD, BLOCK, DIRECT, MISS, CONFIDENCE, SEED = 0.93, 2048, 16_384, 1e-6, 6.0, 20240527
_SLACK = 1e-6


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated vectors, packed, and the correction factors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def least_product(a: np.ndarray, dim: int, threshold: float, confidence: float = CONFIDENCE) -> np.ndarray:
    """For each correction factor, the least <q, c> at which the pair may still reach ``threshold``."""
    a = np.clip(a, 1e-12, 1.0)
    sure = np.cos(np.minimum(np.arccos(a) + np.arccos(threshold), np.pi))
    likely = a * (threshold - confidence * np.sqrt((1 - a * a) / (a * a)) / np.sqrt(max(dim - 1, 1)))
    return np.maximum(sure, likely if dim > 8 else -1.0) - _SLACK


def block_links(x: np.ndarray, y: np.ndarray, packed: np.ndarray, a: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) with cosine(x[i], y[j]) >= threshold; ``packed`` and ``a`` are y's codes."""
    dim = x.shape[1]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    turned = ((x / nx[:, None]) @ rotation(dim)).astype(np.float32)
    sign = (np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    least = least_product(a, dim, threshold).astype(np.float32)
    left, right = [], []
    for k in range(0, len(x), 512):
        i, j = np.nonzero(turned[k : k + 512] @ sign.T >= least)
        i += k
        for s in range(0, len(i), 100_000):
            p, q = i[s : s + 100_000], j[s : s + 100_000]
            hit = np.einsum("nd,nd->n", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
            left.append(p[hit])
            right.append(q[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def projections(vec: np.ndarray, k: int, tables: range) -> np.ndarray:
    """[vector, table]: the signs of k random projections as one number.

    Vectors and directions are rounded to integers whose sums are exact in double precision, so that the
    same vector gets the same signs whatever it is computed with.
    """
    dim = vec.shape[1]
    x = np.rint(vec / np.linalg.norm(vec, axis=1)[:, None] * (1 << 20))
    out = np.zeros((len(vec), len(tables)), np.int64)
    for c, t in enumerate(tables if k else []):
        way = np.rint(np.random.default_rng([SEED, dim, k, t]).standard_normal((dim, k)) * 1024)
        out[:, c] = (x @ way >= 0) @ (1 << np.arange(k, dtype=np.int64))
    return out


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """_id, key (null: links with nothing), label, vec."""
    slim = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vec_col).cast("array<double>").alias("_vec"))

    def run(batches):
        for b in batches:
            key = []
            for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                ok = label is not None and v.is_valid and len(v.values) and not v.values.null_count
                x = v.values.to_numpy() + 0.0 if ok else np.zeros(0)
                ok = ok and np.isfinite(x).all() and x.any() and 0 < np.dot(x, x) < np.inf
                key.append(hashlib.sha256(label.encode() + b"\0" + x.tobytes()).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.binary())], ["_id", "_label", "_vec", "key"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _label string, _vec array<double>, key binary")


def _buckets(classes: DataFrame, direct: int, threshold: float) -> DataFrame:
    """classes -> label, dim, k, t, code, cid, n, vec: a row for each table."""
    agree = 1 - float(np.arccos(threshold)) / np.pi  # of one sign, at the threshold
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / direct))).cast("int")
    sizes = classes.groupBy("label", "dim").agg(k.alias("k"))
    tables = F.when(F.col("k") == 0, 1).otherwise(F.ceil(F.lit(float(np.log(MISS))) / F.log(1 - F.pow(F.lit(agree), F.col("k"))))).cast("int")
    rows = classes.join(sizes, ["label", "dim"]).select("label", "dim", "k", tables.alias("tables"), "cid", "n", "vec")

    def run(batches):
        for b in batches:
            dim, k, tables = (b.column(c).to_numpy() for c in ("dim", "k", "tables"))
            vecs = b.column("vec")
            for kind in sorted(set(zip(dim.tolist(), k.tolist(), tables.tolist(), strict=True))):
                at = np.flatnonzero((dim == kind[0]) & (k == kind[1]) & (tables == kind[2]))
                part = b.take(pa.array(at))
                code = projections(vecs.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1), kind[1], range(kind[2]))
                for t in range(kind[2]):
                    own = [part.column(c) for c in ("label", "dim", "k")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), t, np.int32)), pa.array(code[:, t]), *(part.column(c) for c in ("cid", "n", "vec"))], ["label", "dim", "k", "t", "code", "cid", "n", "vec"])

    return rows.mapInArrow(run, "label string, dim int, k int, t int, code long, cid long, n long, vec array<double>")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id (smallest id reachable), kept."""
    rows = scratch.stage(_prepared(vectors, id_col, vec_col, label_col), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.first("_vec").alias("vec"), F.first("_label").alias("label"), F.min("_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = scratch.stage(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "classes")
    dealt = _buckets(classes, direct, threshold)
    key = ["label", "dim", "t", "code"]
    crowded = dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    crowded = scratch.stage(crowded, "crowded", codec="snappy")
    placed = dealt.join(crowded, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    i_side = placed.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise(0))
    j_side = placed.where("block > 0").withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).withColumn("side", F.lit(1))
    both = i_side.unionByName(j_side).select(*key, "k", "i", "j", "side", "cid", "n", "vec")

    def task(t: pa.Table) -> pa.Table:
        side, cid, n = (t.column(c).to_numpy() for c in ("side", "cid", "n"))
        vec = t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(first) or not len(second):
            return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        unit = vec[second] / np.linalg.norm(vec[second], axis=1)[:, None]
        p, q = block_links(vec[first], vec[second], *codes(unit), threshold)
        p, q = first[p], second[q]
        keep = cid[p] < cid[q] if side[0] == 2 else cid[p] != cid[q]
        p, q = p[keep], q[keep]
        table, k = t.column("t")[0].as_py(), t.column("k")[0].as_py()
        if table and len(p):  # a pair that shared a bucket in an earlier table was counted there
            linked, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            a, b = np.split(at, 2)
            early = np.zeros(len(p), bool)
            for other in range(table):
                code = projections(vec[linked], k, range(other, other + 1))[:, 0]
                early |= code[a] == code[b]
            p, q = p[~early], q[~early]
        names, at = np.unique(cid, return_inverse=True)
        n_p, n_q, p, q = n[p], n[q], at[p], at[q]
        links = np.bincount(p, weights=n_q, minlength=len(names)) + np.bincount(q, weights=n_p, minlength=len(names))
        root = np.arange(len(names))
        while True:  # labels fall until each component has its smallest class
            old = root.copy()
            np.minimum.at(root, p, old[q])
            np.minimum.at(root, q, old[p])
            root = root[root]
            if (root == old).all():
                break
        some = links > 0
        return pa.table({"cid": names[some], "links": links[some].astype(np.int64), "root": names[root[some]]})

    found = both.groupBy(*key, "i", "j").applyInArrow(task, "cid long, links long, root long")
    found = scratch.stage(found, "links")
    parts = scratch.stage(graph.components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "parts")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "key", "low", "n").join(links, "cid", "left")
    named = named.join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = scratch.stage(named, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = named.join(lowest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = scratch.stage(known, "known")
    out = rows.select("_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
