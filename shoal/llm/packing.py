"""Best-fit packing with certified bin counts.

Documents become sequences of token ids (a separator after each); only longer ones are cut, into
pieces of the sequence length. Pieces are dealt to partitions of bounded size, each packed by
best-fit decreasing. Dual-feasible functions give a lower bound on the bins of each partition: where
it is met the packing is certified, and all but its least filled bin is final. Partitions with a gap give the
pieces of their least filled bins, as many bins as could hold the waste, to an exchange: they meet the pieces of
other partitions and are packed again. Rounds go on until all that is open fits into one partition, or until a
round made fewer neither the bins nor the open pieces. Every piece says whether the partition it was last packed in met
its bound; ``certificate`` compares the whole with the bound over all lengths.

Only lengths are packed; ids stay in the pieces' table. Defined results: a null text is empty and
packs as its separator alone; repeated rows and null ids are packed like any other rows; an empty
table gives an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import scratch, wordbpe

CAPACITY, SEPARATOR, PER_TASK = 2048, 0, 100_000


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that the dual-feasible functions u(k) and f(e) say; any packing needs as many bins."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(have: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same of the number of pieces of each length."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((size * have).sum()) // capacity)
    for k in range(1, 21):  # u(k): x where (k + 1) x is a whole number of bins, else floor((k + 1) x) / k
        whole = (k + 1) * size % capacity == 0
        weight = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((weight * have).sum()) // (k * capacity)))
    for e in range(capacity // 2, 0, -max(1, capacity // 256)):  # f(e): large items count whole, small ones not at all
        weight = np.where(size > capacity - e, capacity, np.where(size >= e, size, 0))
        best = max(best, -(-int((weight * have).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. Ties go to the item that comes first."""
    order = np.argsort(-lengths, kind="stable")
    at, start = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0  # bit r: some bin has room r
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        at[i], start[i] = b, capacity - room
        if room > x:
            rooms[room - x].append(b)
            mask |= 1 << (room - x)
    return at, start, bins


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = wordbpe.VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        enc = wordbpe.encoder(vocabulary)
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(enc.encode(b.column(1).to_pylist())):
                raw += end
                for p, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _round(items: DataFrame, tasks: int, number: int, capacity: int) -> DataFrame:
    """Pack (uid, length) in ``tasks`` partitions -> uid, length, sequence_id, offset, certified, open: is its bin to be given up."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]  # of about PER_TASK pieces
        if not got:
            return
        uid, length = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        first = np.argsort(uid, kind="stable")
        uid, length = uid[first], length[first]
        at, start, bins = best_fit_decreasing(length, capacity)
        gap = bins - lower_bound(length, capacity)
        fill = np.bincount(at, weights=length, minlength=bins)
        give = np.zeros(bins, bool)
        if tasks > 1:  # the least filled bins, until their waste could hold the gap twice over; one at least
            least = np.argsort(fill, kind="stable")
            waste = np.cumsum(capacity - fill[least])
            give[least[: 1 + int(np.searchsorted(waste, 2 * gap * capacity)) * (gap > 0)]] = True
        lead = np.zeros(bins, np.int64)  # a sequence is named by the piece at its start
        lead[at[start == 0]] = uid[start == 0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, length, lead[at], start, np.full(len(uid), gap == 0), give[at])], ["uid", "length", "sequence_id", "offset", "certified", "open"])

    dealt = items.select("uid", "length").repartition(tasks, F.xxhash64("uid", F.lit(number)))
    return dealt.mapInArrow(run, "uid long, length long, sequence_id long, offset long, certified boolean, open boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """(uid, length from 1 to capacity) -> uid, sequence_id (the uid at its start), offset, certified. ``uid`` must be unique, a long."""
    columns = ["uid", "sequence_id", "offset", "certified"]
    full = items.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    out, left, closed, before = full, items.where(F.col("length") < capacity), 0, None
    for r in count():
        n = left.count()
        if not n:
            break
        tasks = -(-n // per_task)
        packed = scratch.stage(_round(left, tasks, r, capacity), "packed")
        bins, opened = packed.agg(F.count_if(F.col("offset") == 0), F.count_if("open")).first()
        now = (closed + bins, opened)
        if tasks == 1 or before is not None and now[0] >= before[0] and now[1] >= before[1]:
            return out.unionByName(packed.select(columns))
        out = out.unionByName(packed.where("not open").select(columns))
        closed += packed.where("not open").agg(F.count_if(F.col("offset") == 0)).first()[0]
        left, before = packed.where("open"), now
    return out


def certificate(items: DataFrame, placed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and how many any packing of ``items`` (length) needs at least."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        have[length] += n
    return placed.where(F.col("offset") == 0).count(), bound_of(have, capacity)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = wordbpe.VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    made = pieces(docs, id_col, text_col, vocabulary, capacity).withColumn("_uid", F.monotonically_increasing_id())
    made = scratch.stage(made, "pieces")
    placed = pack(made.select(F.col("_uid").alias("uid"), "length"), capacity)
    return made.join(placed, made["_uid"] == placed["uid"]).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
