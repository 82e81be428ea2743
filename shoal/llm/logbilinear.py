"""Scores of whole texts by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are the white-space-separated words of the text with A-Z lower-cased, then one end. The corpus is
counted in full: a shuffle of (word, count) a block of texts gives every token's count in the training
documents; they are what the base score is made of, and how many tokens of a text are known.

The model (see ``lbltree``) predicts the next of the ``LISTED`` most frequent tokens, or one of ``RESTS``
classes for all others, by their last byte; a token of such a class has its count's share of the class, an
unknown one half a count, so that the probabilities of all tokens add up to 1. The number of listed tokens
bounds the model's size, which every worker holds; all counts grow with the input. So does the training:
in ``ROUNDS`` rounds, workers go through *all* tokens of the training documents, each of about ``PER_WORKER`` tokens
beginning with the same parameters and drawing its own noise; then the parameters' changes are averaged, row
by row, by the examples that made them. A worker with few tokens goes through them again until it has made
``STEPS`` steps. Then batched matrix products give the normalised log-probabilities of all tokens.

Texts are tokenised once, in blocks of about ``BLOCK`` bytes: a block's distinct words get slots, and
counts come back to a block by slot, only where they aren't those of the block itself, so no table of all words is
ever broadcast or collected.

Defined results: null and empty texts have the end as their one token; a null or false ``held_out``
trains; without training documents every token is unknown, its base score is 0 and the model is uniform over the classes;
repeated rows each count and get a row; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shoal.llm import lbltree, scratch

RESTS, BLOCK, BATCH, ROUNDS, PER_WORKER, STEPS, SEED = 32, 8_000_000, 32_768, 2, 6_000_000, 24, 7
LISTED = lbltree.MOST_LEAVES - RESTS
_END = b"\n"  # can't be a word
_BEFORE, _CHUNK, _SALTS, _PAIRS = 64, 1024, 8, 1 << 20


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D


def _classes() -> np.ndarray:
    """The class of a token that isn't listed, by its last byte: a letter, a kind of sign, or beyond ASCII."""
    out = np.full(256, 31, np.uint8)
    out[97:123], out[48:58], out[128:] = np.arange(1, 27), 27, 30
    out[ord(".")], out[ord(",")], out[ord("\n")] = 28, 29, 0
    return out


_CLASS = _classes()


def _rest(word: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(c)) for c in _CLASS]), F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int") + 1)


def _pack(ids: np.ndarray) -> bytes:
    """Compressed by planes of bytes: the upper ones are nearly all zero."""
    return zlib.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ints(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _blocks(slim: DataFrame) -> DataFrame:
    """Rows of three kinds: a document's slots; a block's own training counts and classes by slot (n_tokens is null), and a block's words
    with their training counts (word isn't null)."""
    kind = slim.schema["_id"].dataType.simpleString()
    names = ["block", "_id", "held", "n_tokens", "ids", "slot", "word", "n"]
    types = [pa.int64(), to_arrow_type(slim.schema["_id"].dataType), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]

    def rows(many, **columns):
        found = {k: v if isinstance(v, pa.Array) else pa.array(v, dict(zip(names, types, strict=True))[k]) for k, v in columns.items()}
        return pa.RecordBatch.from_arrays([found[k] if k in found else pa.nulls(many, t) for k, t in zip(names, types, strict=True)], names)

    def close(block, docs, slot):
        seen = np.zeros(len(slot), np.int64)
        for _, held, ids in docs:
            if not held:
                seen += np.bincount(ids, minlength=len(slot))
        yield rows(len(docs), block=[block] * len(docs), _id=[d[0] for d in docs], held=[d[1] for d in docs], n_tokens=[len(d[2]) for d in docs], ids=[_pack(d[2]) for d in docs])
        words = pa.array(list(slot), pa.large_binary())
        last = _CLASS[np.frombuffer(words.buffers()[2], np.uint8)[np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)[1:] - 1]]
        yield rows(1, block=[block], ids=[zlib.compress(seen.astype("<i8").tobytes() + last.tobytes(), 1)])
        for k in range(0, len(words), 50_000):
            w = words[k : k + 50_000].cast(pa.binary())
            yield rows(len(w), block=np.full(len(w), block), slot=np.arange(k, k + len(w), dtype=np.int32), word=w, n=seen[k : k + len(w)])

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        docs, size, slot = [], 0, None
        for b in batches:
            for i, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if slot is None or size + len(raw) > BLOCK and docs:
                    if slot is not None:
                        yield from close(next(number), docs, slot)
                    docs, size, slot = [], 0, defaultdict(count().__next__)
                toks = tokens(raw)
                toks.append(_END)
                docs.append((i, held, np.fromiter(map(slot.__getitem__, toks), np.uint32, len(toks))))
                size += len(raw) + 16
        if docs:
            yield from close(next(number), docs, slot)

    return slim.mapInArrow(run, f"block long, _id {kind}, held boolean, n_tokens long, ids binary, slot int, word binary, n long")


def _coded(docs: DataFrame, words: DataFrame, total: int, distinct: int, mass: np.ndarray, listed: int) -> DataFrame:
    """Each document's classes (a listed token's rank, or ``listed`` and the rest's class) and its sums over known and unlisted tokens."""
    id_type = to_arrow_type(docs.schema["_id"].dataType)
    whole = total + 0.5 * (distinct + 1)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        is_doc = left.column("n_tokens").is_valid()
        raw = zlib.decompress(left.filter(pa.compute.invert(is_doc)).column("ids")[0].as_py())
        size = len(raw) // 9
        seen, of = np.frombuffer(raw, "<i8", size).copy(), np.frombuffer(raw, np.uint8, size, 8 * size).astype(np.int32) + listed
        slots, cls = right.column("slot").to_numpy(), right.column("cls")
        seen[slots] = right.column("c").to_numpy()
        ranked = cls.is_valid().to_numpy()
        of[slots[ranked]] = cls.drop_null().to_numpy()
        base = np.log10((seen + 0.5) / whole)
        rest = np.where(of >= listed, np.log10((seen + 0.5) / mass[np.maximum(of - listed, 0)]), 0.0)
        left = left.filter(is_doc)
        out = [[], [], [], []]
        for packed in left.column("ids"):
            ids = _unpack(packed.as_py())
            for k, v in enumerate((int((seen[ids] > 0).sum()), float(base[ids].sum()), float(rest[ids].sum()), _ints(of[ids].astype("<u2")))):
                out[k].append(v)
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([left.column("_id").cast(id_type), left.column("held"), left.column("n_tokens"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["_id", "held", "n_tokens", "n_known", "base_score", "rest_score", "classes"])

    import pyarrow.compute  # noqa: F401

    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, held boolean, n_tokens long, n_known long, base_score double, rest_score double, classes binary"
    return docs.groupBy("own_block").cogroup(words.groupBy("block")).applyInArrow(task, schema)


def _batches(docs, end: int, size: int = BATCH):
    """(two before, one before, this, document) in runs of ``size`` tokens; before a text stand ends, and a long text goes on in the next run."""
    parts, n = [], 0
    for k, w in enumerate(docs):
        padded = np.concatenate([[end, end], w])
        at = 0
        while at < len(w):
            z = min(len(w), at + size - n)
            parts.append((padded[at:z], padded[at + 1 : z + 1], padded[at + 2 : z + 2], np.full(z - at, k)))
            n, at = n + z - at, z
            if n == size:
                yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                parts, n = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _leaves(classes: pa.Array, leaf: np.ndarray):
    for x in classes:
        yield leaf[np.frombuffer(zlib.decompress(x.as_py()), "<u2")]


def _folded(rows: DataFrame, fold) -> dict[int, bytes]:
    """rows(chunk, salt, data) -> chunk: all data folded. In two steps, so that a task holds two at a time, from a share of the workers."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        key, have = None, None
        for b in batches:
            for chunk, salt, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (chunk, salt) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([have], pa.binary())], ["chunk", "salt", "data"])
                    key, have = (chunk, salt), data
                else:
                    have = fold(have, data)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([have], pa.binary())], ["chunk", "salt", "data"])

    for _ in range(2):
        rows = rows.repartition(tasks, "chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(run, "chunk int, salt int, data binary")
    return {r["chunk"]: bytes(r["data"]) for r in rows.collect()}  # of the model's size, whatever the input's


def _sum_ints(a: bytes, b: bytes) -> bytes:
    x, y = (np.frombuffer(zlib.decompress(v), "<i8") for v in (a, b))
    return _ints(x + y)


def _follows(coded: DataFrame, leaves: int, workers: int, end: int) -> np.ndarray:
    """[class, class before]: how often in all training documents; those before are the most frequent, and one for the others."""

    def run(batches):
        total, pairs, size = np.zeros(leaves * _BEFORE, np.int64), [], 0
        for b in batches:
            for x in b.column(0):
                w = np.frombuffer(zlib.decompress(x.as_py()), "<u2").astype(np.int32)
                pair = w * _BEFORE
                pair[0] += min(end, _BEFORE - 1)  # a text has its end at least
                pair[1:] += np.minimum(w[:-1], _BEFORE - 1)
                pairs.append(pair)
                size += len(pair)
                if size >= _PAIRS:
                    total += np.bincount(np.concatenate(pairs), minlength=len(total))
                    pairs, size = [], 0
        if pairs:
            total += np.bincount(np.concatenate(pairs), minlength=len(total))
        for k in range(0, leaves, _CHUNK):
            yield _row(k // _CHUNK, _ints(total[k * _BEFORE : (k + _CHUNK) * _BEFORE]))

    rows = coded.where("not held").select("classes").coalesce(workers).mapInArrow(run, "chunk int, salt int, data binary")
    got = _folded(rows, _sum_ints)
    if not got:
        return np.zeros((leaves, _BEFORE))
    return np.concatenate([np.frombuffer(zlib.decompress(got[k]), "<i8") for k in sorted(got)]).reshape(leaves, _BEFORE).astype(float)


def _row(chunk: int, data: bytes) -> pa.RecordBatch:
    salt = TaskContext.get().partitionId() % _SALTS
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], ["chunk", "salt", "data"])


def _changes(x: np.ndarray, b: np.ndarray, s: np.ndarray, n: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(v).astype(t).tobytes() for v, t in ((x, "<f2"), (b, "<f4"), (s, "<f4"), (n, "<f4"))), 1)


def _read_changes(data: bytes) -> tuple[np.ndarray, ...]:
    """Rows' vectors, biases, summed squares and examples."""
    raw, dim = zlib.decompress(data), lbltree.DIM
    n = len(raw) // (2 * dim + 16)
    x = np.frombuffer(raw, "<f2", n * dim).reshape(n, dim).astype(np.float32)
    rest = np.frombuffer(raw, "<f4", 4 * n, 2 * dim * n).reshape(4, n)
    return x, rest[0], rest[1:3], rest[3]


def _average(a: bytes, b: bytes) -> bytes:
    """Of two workers' changes, each row weighted by its examples."""
    (x, p, s, n), (y, q, t, m) = _read_changes(a), _read_changes(b)
    share = n / np.maximum(n + m, 1)
    return _changes(share[:, None] * x + (1 - share)[:, None] * y, share * p + (1 - share) * q, share * s + (1 - share) * t, n + m)


def train(coded: DataFrame, leaf: np.ndarray, counts: np.ndarray, end: int, workers: int, seed: int = SEED) -> lbltree.Model:
    """A model of all training documents' ``classes``; ``leaf`` maps a class to its leaf, ``counts`` are those of the leaves."""
    spark, model = coded.sparkSession, lbltree.Model(counts, seed)
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, leaf))  # at most MOST_LEAVES leaves

        def run(batches, r=r, shared=shared):
            own, at = shared.value
            begin = own.x.copy(), own.b.copy(), own.s.copy()
            trainer = lbltree.Trainer(own, np.random.default_rng([seed, r, TaskContext.get().partitionId()]))
            kept, steps = [], 0
            for two, one, to, _ in _batches((w for b in batches for w in _leaves(b.column(0), at)), at[end]):
                trainer.step(two, one, to)
                steps += 1
                if steps < STEPS:
                    kept.append((two.astype(np.uint16), one.astype(np.uint16), to.astype(np.uint16)))
            again = list(kept) if 0 < steps < STEPS else []
            while again and steps < STEPS:
                for x in again:
                    trainer.step(*(v.astype(np.int64) for v in x))
                steps += len(again)
            x, b, s = own.x - begin[0], own.b - begin[1], own.s - begin[2]
            own.x[:], own.b[:], own.s[:] = begin  # the broadcast value stays as it was for other tasks of this worker
            for k in range(0, len(x) if steps else 0, _CHUNK):
                own_rows = slice(k, k + _CHUNK)
                yield _row(k // _CHUNK, _changes(x[own_rows], b[own_rows], s[:, own_rows], trainer.touched[own_rows]))

        part = coded.where("not held").where(F.pmod(F.xxhash64("classes"), F.lit(ROUNDS)) == r)
        for k, data in _folded(part.select("classes").coalesce(workers).mapInArrow(run, "chunk int, salt int, data binary"), _average).items():
            x, b, s, _ = _read_changes(data)
            rows = slice(k * _CHUNK, k * _CHUNK + len(x))
            model.x[rows] += x
            model.b[rows] += b
            model.s[:, rows] += s
        shared.unpersist()
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text_col).cast("binary").alias("_text"))
    blocks = scratch.stage(_blocks(slim), "blocks")
    # a word occurs once in a block, so no word has more rows than there are blocks
    own = Window.partitionBy("word")
    words = blocks.where("word is not null").select("block", "slot", "word", "n", F.sum("n").over(own).alias("c"), (F.col("block") == F.min("block").over(own)).alias("first"))
    words = scratch.stage(words.withColumn("elsewhere", F.col("c") != F.col("n")).drop("n"), "words")
    counts = words.where("first and c > 0").select("word", "c")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "word").limit(listed).toArrow()
    n = top.num_rows
    rank = pa.table({"word": top.column("word").cast(pa.binary()), "cls": pa.array(range(n), pa.int32())})
    rank = F.broadcast(spark.createDataFrame(rank, "word binary, cls int"))  # at most ``listed`` rows
    others = counts.join(rank, "word", "left_anti").groupBy(_rest(F.col("word")).alias("cls")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    seen, mass = np.concatenate([top.column("c").to_numpy().astype(float), np.zeros(RESTS)]), np.full(RESTS, 0.5)  # an unknown token in each class
    for r in others.collect():
        seen[n + r["cls"]] += r["c"]
        mass[r["cls"]] += r["c"] + 0.5 * r["v"]
    found = words.join(rank, "word", "left").where("elsewhere or cls is not null").select("block", "slot", "c", "cls")
    texts = blocks.where("word is null").select(F.col("block").alias("own_block"), "_id", "held", "n_tokens", "ids")
    coded = scratch.stage(_coded(texts, found, total, distinct, mass, n), "coded")
    scratch.drop(blocks)
    scratch.drop(words)
    ends = np.flatnonzero([w == _END for w in top.column("word").to_pylist()])
    end = int(ends[0]) if len(ends) else n + int(_CLASS[_END[0]])
    workers = max(1, -(-total // PER_WORKER))
    order = lbltree.order_leaves(_follows(coded, n + RESTS, workers, end))
    leaf = np.empty(n + RESTS, np.int64)
    leaf[order] = np.arange(n + RESTS)
    model = train(coded, leaf, seen[order], end, workers)
    shared = spark.sparkContext.broadcast((model, leaf))  # at most MOST_LEAVES leaves

    def run(batches):
        m, at = shared.value
        for b in batches:
            sums = np.zeros(b.num_rows)
            for two, one, to, doc in _batches(_leaves(b.column(6), at), at[end], 4 * BATCH):
                sums += np.bincount(doc, weights=m.log_probs(two, one, to), minlength=b.num_rows)
            values = sums / np.log(10) + b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([total] * b.num_rows, pa.int64()), b.column(4), pa.array(values, pa.float64())], ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
