"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The last token of a prefix's encoding, and how many tokens it has, follow from those of shorter
prefixes: it is the one token t that ends there and may stand after the last token of what precedes
it, and "may stand after" is a property of two tokens. After some bytes only the starts from which
the bytes so far are the beginning of a vocabulary entry matter to what follows. So a *state* is the
text since the earliest such start with, for each start, its last token and its count relative to the
earliest; a transition on a byte emits the tokens that no later byte can change any more, and the end
of a piece emits the rest. States and transitions are compiled when first met, into a table, and
shared by all later texts of the worker (up to a bound, then begun again).

A text is read in chunks. A unit (see ``bytesplit``) starts and ends in the start state, whatever
stands around it, so its map is one count, and these compose by adding; a very long piece is cut into chunks whose
maps take each of several entry states to an exit state and a count, and compose through a prefix scan.

Defined results: special strings inside texts count as one token, as is the library's default; null counts as
empty, with no token; texts may be of any length, a run of letters without end included; repeated rows and
equal ids each get a row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import bytesplit, scratch
from shoal.llm.inttable import IntTable

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT, _CHUNK, _WARM = 512, 1024, (128, 64, 17)
_STATES, _UNITS = 500_000, 400_000


class Transducer:
    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in bytesplit.LETTER.items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings aren't supported")
        of = {bytes(letters[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in self.special}
        self.token = {k: t for t, k in of.items()}
        self.of = of
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge.setdefault((of[a], of[b]), (rank, of[a + b]))
        self.begins = {t[:k] for t in of for k in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.moves = IntTable()  # state << 8 | byte -> target << 8 | tokens emitted (may be negative) + 128
        self.last = np.zeros(1024, np.int64)  # tokens that the end emits

    def _encode(self, raw: bytes) -> list[int]:
        """Plain BPE of a short string, to decide whether two tokens may be neighbours."""
        ids = [self.of[raw[k : k + 1]] for k in range(len(raw))]
        while True:
            best = min(((*self.merge[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge), default=None)
            if best is None:
                return ids
            ids[best[2] : best[2] + 2] = [best[1]]

    def _may_follow(self, left: int, t: int) -> bool:
        if (left, t) not in self.fits:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            both = [t] if left < 0 else [left, t]
            self.fits[left, t] = self._encode(b"".join(self.token[k] for k in both)) == both
        return self.fits[left, t]

    def _compile(self, state: int, byte: int) -> int:
        """One transition's value; makes its target state if that is new."""
        text, starts = self.states[state]
        text += bytes([byte])
        n, live, end = len(text), [], None
        for back, left, seen in starts:
            suffix = text[n - 1 - back :]
            if suffix in self.begins:
                live.append((back + 1, left, seen))
                t = self.of.get(suffix)
                if end is None and t is not None and self._may_follow(left, t):
                    end = (0, t, seen + 1)
        live.append(end)
        base = live[0][2]
        key = (text[n - live[0][0] :], tuple((back, left, seen - base) for back, left, seen in live))
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
            if target >= len(self.last):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[target] = key[1][-1][2]
        if not -128 <= base < 128:
            raise ValueError("a token of the vocabulary is too long")
        return target << 8 | base + 128

    def run(self, lanes: list[bytes], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read all lanes in step, from their entry states -> exit states, tokens emitted."""
        sizes = np.array([len(x) for x in lanes], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(lanes), np.uint8)
        begin = (np.cumsum([0] + [len(x) for x in lanes])[:-1])[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(lanes), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -k, side="left"))  # lanes longer than k
            key = state[:m] << 8 | flat[begin[:m] + k]
            to = self.moves.get(key)
            if (to < 0).any():
                new = np.unique(key[to < 0])
                self.moves.insert(new, np.array([self._compile(x >> 8, x & 255) for x in new.tolist()], np.int64))
                to = self.moves.get(key)
            count[:m] += (to & 255) - 128
            state[:m] = to >> 8
        back_state, back_count = np.empty_like(state), np.empty_like(count)
        back_state[order], back_count[order] = state, count
        return back_state, back_count

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece (one match of the pattern)."""
        if len(self.states) > _STATES:
            self._clear()
        out = np.zeros(len(pieces), np.int64)
        short = [k for k, p in enumerate(pieces) if len(p) <= _CHUNK]
        for k in range(0, len(short), 200_000):
            at = short[k : k + 200_000]
            state, count = self.run([pieces[i] for i in at], np.zeros(len(at), np.int64))
            out[at] = count + self.last[state]
        for k, p in enumerate(pieces):
            if len(p) > _CHUNK:
                out[k] = self._long(p)
        return out

    def _long(self, piece: bytes, size: int = _CHUNK) -> int:
        """Chunk state maps of one piece, composed by a prefix scan.

        A chunk's map is taken at the entry states that the bytes before it may lead to: those that readings from
        several places before the chunk end in. Where the scan comes to a state that a map lacks, the map is
        taken there too, and the scan is done again; all before that place is right, so this ends.
        """
        chunks = [piece[k : k + size] for k in range(0, len(piece), size)]
        entry = np.full((len(chunks), len(_WARM)), -1, np.int64)
        entry[0, 0] = 0
        for c, w in enumerate(_WARM):
            lanes = [piece[max(0, k * size - w) : k * size] for k in range(1, len(chunks))]
            entry[1:, c] = self.run(lanes, np.zeros(len(lanes), np.int64))[0]
        entry[:, 1:][entry[:, 1:] == entry[:, :1]] = -1  # each state once
        leave, count = np.full_like(entry, -1), np.zeros_like(entry)

        def fill(rows: np.ndarray, column: int) -> None:
            rows = rows[entry[rows, column] >= 0]
            leave[rows, column], count[rows, column] = self.run([chunks[i] for i in rows.tolist()], entry[rows, column])

        for c in range(entry.shape[1]):
            fill(np.arange(len(chunks)), c)
        while True:
            to, total = scan(entry, leave, count)
            lacking = np.flatnonzero(to[:, 0] < 0)
            if not len(lacking):
                return int(total[-1, 0] + self.last[to[-1, 0]])
            i = int(lacking[0])
            if (entry[i] >= 0).all():
                entry, leave, count = (np.hstack([x, np.full((len(chunks), 1), v)]) for x, v in ((entry, -1), (leave, -1), (count, 0)))
            c = int(np.flatnonzero(entry[i] < 0)[0])
            entry[i, c] = to[i - 1, 0]
            fill(np.array([i]), c)


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of maps (entry, leave, count), each [map, state]: ``first`` and ``then`` in turn. A map is undefined, -1, where it has no
    entry, and so is the composition where it comes to such a state. This is associative."""
    entry, leave, count = first
    at = (leave[:, :, None] == then[0][:, None, :]) & (leave[:, :, None] >= 0)
    ok, to = at.any(axis=2), at.argmax(axis=2)
    rows = np.arange(len(leave))[:, None]
    return entry, np.where(ok, then[1][rows, to], -1), np.where(ok, count + then[2][rows, to], 0)


def scan(entry: np.ndarray, leave: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of maps by ``compose``, in log2(n) doubling steps -> for each, where all up to it leave the entry
    states of the first, and with how many tokens."""
    maps, step = (entry, leave, count), 1
    while step < len(entry):
        later = compose(tuple(x[:-step] for x in maps), tuple(x[step:] for x in maps))
        maps = tuple(np.concatenate([x[:step], y]) for x, y in zip(maps, later, strict=True))
        step *= 2
    return maps[1], maps[2]


class Counter:
    """Counts whole texts in a worker."""

    def __init__(self, path: str = VOCABULARY):
        self.machine = Transducer(path)
        self.find = regex.compile(bytesplit.PATTERN).findall
        self.units: dict[str, int] = {}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.machine.special, key=len, reverse=True)) or r"(?!)")
        self.mark = os.path.commonprefix(self.machine.special)  # no special string is in a text without it

    def _learn(self, new: set[str], known: dict[str, int], lead: str) -> None:
        new = [u for u in new if u not in known]
        if not new:
            return
        parts = [self.find(lead + u) for u in new]
        fresh = list(dict.fromkeys(p for x in parts for p in x))
        of = dict(zip(fresh, self.machine.counts([p.encode() for p in fresh]).tolist(), strict=True))
        get = of.__getitem__
        known.update((u, sum(map(get, x))) for u, x in zip(new, parts, strict=True))

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for group in scratch.bounded(texts, len):
            parts, owner, extra = [], [], np.zeros(len(group), np.int64)
            for k, t in enumerate(group):
                pieces = self.special.split(t) if self.machine.special and self.mark in t else [t]
                extra[k] = len(pieces) - 1
                for p in pieces:
                    parts.append(bytesplit.units(p))
                    owner.append(k)
            heads: dict[str, int] = {}
            self._learn({x[0] for x in parts}, heads, "")
            rest = set().union(*(x[1:] for x in parts))
            if len(self.units) + len(rest) > _UNITS:
                self.units.clear()
            self._learn(rest, self.units, " ")
            get = self.units.__getitem__
            one = np.fromiter((n for x in parts for n in (heads[x[0]], *map(get, x[1:]))), np.int64)
            upto = np.concatenate([[0], np.cumsum(one)])  # the scan of the units' maps
            ends = np.cumsum([len(x) for x in parts])
            per = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
            out.append(extra + np.bincount(owner, weights=per, minlength=len(group)).astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_WORKER: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        if path not in _WORKER:
            _WORKER.clear()
            _WORKER[path] = Counter(path)
        for b in batches:
            texts = b.column(1)
            n = _WORKER[path].count(texts.to_pylist())
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return slim.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
