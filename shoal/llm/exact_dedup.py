"""Exact duplicates by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries style frequent-items sketch (Spark's ``approx_top_k``, built on the DataSketches
frequent-items sketch) names the digests that may be frequent. Their exact winners are verified by
an aggregate with map-side combining; that table has at most ``counters // 4`` rows, so it is
broadcast and removes the hot rows before the shuffle. All other digests go through an ordinary shuffle of
their partial winners and counts, combined map-side, so no task gets all rows of a digest; the groups of copies
are joined back to (id, digest), which adaptive execution can split. Texts are never shuffled.

Defined results: null text counts as empty; null ids are smaller than any id; of rows equal in id
and text one (any, they are the same) stays; an empty table gives an empty result; extra columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm import scratch

COUNTERS = 1024


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    slim = scratch.stage(
        docs.select(F.col(id_col).alias("_id"), F.unhex(sha256_hex(F.col(text_col))).alias("_digest"), F.monotonically_increasing_id().alias("_rid")), "digests"
    )
    sketch = slim.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(hex(_digest), {counters // 4}, {counters})").alias("top"))
    named = sketch.select("n", F.explode("top").alias("t")).where(F.col("t.count") * counters > F.col("n")).where("t.count > 1")
    named = named.select(F.unhex("t.item").alias("_digest"))  # at most counters // 4 rows
    best = F.max(F.struct("_id", "_rid")).alias("_best")
    winners = scratch.stage(slim.join(F.broadcast(named), "_digest").groupBy("_digest").agg(best, F.count(F.lit(1)).alias("_size")), "winners")
    hot = slim.join(F.broadcast(winners), "_digest")
    cold = slim.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    groups = cold.groupBy("_digest").agg(best, F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = scratch.stage(groups, "copies")
    alone = F.struct("_id", "_rid")
    rest = cold.join(groups, "_digest", "left").select("_digest", "_id", "_rid", F.when(F.col("_size").isNull(), alone).otherwise(F.col("_best")).alias("_best"), F.coalesce("_size", F.lit(1)).alias("_size"))
    return hot.select(rest.columns).unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_best._rid") == F.col("_rid")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest id; all columns kept.

    The rows to drop are joined back by id and digest. Rows equal in id and text are all winners by
    that key; such ties, if any, are cut to one by an aggregate with map-side combining.
    """
    tail = F.conv(F.substring("text_sha256", 49, 15), 16, 10).cast("long")
    found = scratch.stage(classes(docs, id_col, text_col, counters).where("group_size > 1").withColumn("_tail", tail), "dups")
    copies = found.where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    ties = copies.groupBy(F.col(id_col).alias("_k"), "_tail").count().where("count > 1").select("_k", "_tail", F.lit(True).alias("_tie"))
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("_k"), "_tail", F.lit(False).alias("_tie")).distinct()
    marks = scratch.stage(gone.unionByName(ties), "marks", codec="snappy")
    has_ties = not marks.where("_tie").isEmpty()
    own = F.conv(F.substring(sha256_hex(F.col(f"d.{text_col}")), 49, 15), 16, 10).cast("long")
    on = F.col(f"d.{id_col}").eqNullSafe(F.col("m._k")) & (own == F.col("m._tail"))
    d = docs.alias("d")
    if not has_ties:
        return d.join(marks.alias("m"), on, "left_anti")
    marked = d.join(marks.alias("m"), on, "left").where(F.col("m._tie").isNull() | F.col("m._tie"))
    single = marked.where(F.col("m._tie").isNull()).select("d.*")
    tied = marked.where(F.col("m._tie")).select(F.struct("d.*").alias("row"), F.col("m._k"), F.col("m._tail"))
    tied = tied.groupBy("_k", "_tail").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(tied)
