"""Byte-level BPE by segment trees.

A piece (one match of the public pattern) starts as its bytes. A segment tree over byte positions
holds, in each leaf, the rank of the pair that starts there (a live part and its next live neighbour)
packed with the position, so that the root is the leftmost pair of minimum rank. A merge changes
three leaves (the merged part, its left neighbour, the part that vanished) and their paths to the
root: logarithmic work. The trees of many pieces of like size are kept in one array and take their
merges in step; a very long piece is simply a tree of more levels.

Pieces' ids are kept in the worker, up to a bound; whole texts are encoded and decoded.

Defined results: null counts as empty, with no token and the digests of nothing; of pairs of equal rank the leftmost merges
first; texts and pieces may be of any length (a merge costs the logarithm of the piece's); repeated rows and equal ids
each get a row; an empty table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import bytesplit, scratch
from shoal.llm.inttable import IntTable

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_NONE = np.int64(1) << 40
_UNITS, _PIECES = 500_000, 500_000


class Ranks:
    """Rank file -> token bytes by id, and the rank of each mergeable pair of ids."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.of = {base64.b64decode(a): int(b) for a, b in lines}
        self.token = [b""] * (max(self.of.values()) + 1)
        for t, r in self.of.items():
            self.token[r] = t
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in self.of.items():
            for k in range(1, len(t)):  # any two tokens whose bytes together are a token may merge
                a, b = self.of.get(t[:k]), self.of.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pairs = IntTable()
        self.pairs.insert(keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that two ids make, or _NONE; a negative id is no neighbour."""
        rank = self.pairs.get(np.where((a >= 0) & (b >= 0), a << 20 | b, -1))
        return np.where(rank < 0, _NONE, rank)


def merge_all(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece, as little-endian unsigned 32-bit numbers."""
    out = [b""] * len(pieces)
    single = [int(b).to_bytes(4, "little") for b in ranks.byte]
    groups: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if len(p) == 1:
            out[k] = single[p[0]]
        elif p:
            groups.setdefault((len(p) - 1).bit_length(), []).append(k)
    for level, at in groups.items():
        step = max(1, (1 << 20) >> level)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            for i, ids in zip(part, _merge_group([pieces[i] for i in part], 1 << level, ranks), strict=True):
                out[i] = ids
    return out


def _merge_group(pieces: list[bytes], leaves: int, ranks: Ranks) -> list[bytes]:
    """Pieces of at most ``leaves`` bytes; row i of each array is piece i's."""
    n, shift = len(pieces), np.int64(leaves.bit_length())
    size = np.array([len(p) for p in pieces])
    inside = np.arange(leaves) < size[:, None]
    ids = np.full((n, leaves), -1, np.int64)
    ids[inside] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, leaves + 1), (n, 1))
    after[np.arange(n), size - 1] = leaves  # no neighbour
    before = np.tile(np.arange(-1, leaves - 1), (n, 1))
    tree = np.full((n, 2 * leaves), _NONE << shift, np.int64)
    following = np.hstack([ids[:, 1:], np.full((n, 1), -1, np.int64)])
    rank = ranks.pair(ids.ravel(), following.ravel()).reshape(n, leaves)
    tree[:, leaves:] = rank << shift | np.arange(leaves)
    width = leaves
    while width > 1:
        tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width //= 2
    live = np.arange(n)
    while True:
        root = tree[live, 1]
        live, root = live[root < _NONE << shift], root[root < _NONE << shift]
        if not len(live):
            break
        p = root & ((np.int64(1) << shift) - 1)
        q = after[live, p]  # the part that vanishes into p
        ids[live, p], ids[live, q] = root >> shift, -1
        r = after[live, q]
        after[live, p] = r
        has = r < leaves
        before[live[has], r[has]] = p[has]
        left = before[live, p]
        right_id = np.where(has, ids[live, np.minimum(r, leaves - 1)], -1)
        left_id = np.where(left >= 0, ids[live, np.maximum(left, 0)], -1)
        _update(tree, live, p, ranks.pair(ids[live, p], right_id) << shift | p, leaves)
        _update(tree, live, q, np.full(len(live), _NONE << shift, np.int64), leaves)
        some = left >= 0
        _update(tree, live[some], left[some], ranks.pair(left_id[some], ids[live[some], p[some]]) << shift | left[some], leaves)
    kept = ids >= 0
    raw, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(4 * kept.sum(axis=1)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _update(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray, leaves: int) -> None:
    node = leaf + leaves
    tree[row, node] = value
    while node.size and node[0] > 1:  # all rows' leaves are on one level
        node = node >> 1
        tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])


class Codec:
    """Encodes and decodes whole texts; one for each worker."""

    def __init__(self, path: str = RANKS):
        self.ranks = Ranks(path)
        self.find = regex.compile(bytesplit.PATTERN).findall
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, new: set[str], known: dict[str, bytes], lead: str) -> None:
        new = [u for u in new if u not in known]
        if not new:
            return
        if len(self.pieces) > _PIECES:
            self.pieces.clear()
        parts = [self.find(lead + u) for u in new]
        fresh = [p for p in dict.fromkeys(p for x in parts for p in x) if p not in self.pieces]
        self.pieces.update(zip(fresh, merge_all([p.encode() for p in fresh], self.ranks), strict=True))
        get = self.pieces.__getitem__
        known.update((u, b"".join(map(get, x))) for u, x in zip(new, parts, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for group in scratch.bounded(texts, len):
            split = [bytesplit.units(t) for t in group]
            heads: dict[str, bytes] = {}
            self._learn({x[0] for x in split}, heads, "")
            rest = set().union(*(x[1:] for x in split))
            if len(self.units) + len(rest) > _UNITS:
                self.units.clear()
            self._learn(rest, self.units, " ")
            get = self.units.__getitem__
            out += [np.frombuffer(heads[x[0]] + b"".join(map(get, x[1:])), "<u4") for x in split]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids.tolist()))


_WORKER: dict[str, Codec] = {}


def codec(path: str = RANKS) -> Codec:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Codec(path)
    return _WORKER[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(``id_col``, ids): the token ids of each whole text; null text gives none. Other columns aren't read."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        for b in batches:
            ids = codec(path).encode(b.column(1).to_pylist())
            ends = np.cumsum([0] + [len(x) for x in ids])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["_id", "ids"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """(``id_col``, bytes): the bytes of each list of ids; null gives none."""
    slim = tokens.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def run(batches):
        for b in batches:
            raw = [codec(path).decode(np.array(x.values if x.is_valid else [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["_id", "bytes"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, bytes binary").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """Encode and decode without moving the ids between: ``id_col``, n_tokens, ids_sha256, decoded_sha256."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        own = codec(path)
        decimal = [str(k) for k in range(len(own.ranks.token))]
        for b in batches:
            n, a, d = [], [], []
            for ids in own.encode(b.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                d.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
