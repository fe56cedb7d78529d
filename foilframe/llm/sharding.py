"""Sharding by vector bin packing (operator 3).

Every row has a vector of bytes, tokens and rows; rows of equal text, null being
empty, form a group that shares a shard. Each unit is placed in the shard where
the dot product of its vector with the shard's residual capacity is highest, the
largest units first.

Units are of bounded number whatever the size of the data: groups over 1/SLICES
of a shard in any dimension stand alone (at most 3 * shards * SLICES of them
exist), all lighter groups are hashed into BUCKETS buckets that are packed whole,
so a bucket is at most a 64th of a shard (a 500th with eight of them) and the
balance as fine as that. Only a group with more bytes than a whole shard is split
by the places of its rows, into pieces of about 1/SLICES of one, since no shard
could hold it and stay as large as the others.

Slots number the rows of a shard from 0: rows are sorted by shard within the files
of a written table, so a slot is the count before that file plus the place within
it. The counts are one row for each file and shard, summed in Spark; no shard is
ever gathered.

Null texts have no bytes and no tokens and still weigh a byte and a row. Repeated
rows are rows like any other. An empty table gives an empty result; with fewer
units than shards some stay empty. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foilframe.llm.staging import PLACE, ROW_BITS, documents, local_table, numbered, small, stage, text_or_empty

SLICES = 64
#: Buckets of light groups, at least; with many shards there are BUCKETS_EACH for each.
BUCKETS, BUCKETS_EACH = 4096, 64
#: How much bytes, tokens and rows count: bytes most, as the law is that they are near equal.
LAW = (8.0, 1.0, 1.0)


def pack(units: np.ndarray, shards: int, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """The shard of each unit; units: one row of non-negative amounts each; weights: how much each dimension counts.

    A unit that alone exceeds a shard's even part of a dimension lowers the
    capacity of the other shards to the even part of what is left; capacity that
    is used up counts as none.
    """
    total = units.sum(axis=0)
    share = units / np.where(total > 0, total / shards, 1)
    left = np.array([_level(share[:, k], shards) for k in range(share.shape[1])])[None, :].repeat(shards, axis=0)
    by = np.ones(share.shape[1]) if weights is None else np.array(weights)
    out = np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((np.arange(len(units)), -share.max(axis=1, initial=0))):
        out[i] = k = int(np.argmax(np.maximum(left, 0) @ (by * share[i])))
        left[k] -= share[i]
    return out


def _level(share: np.ndarray, shards: int) -> float:
    """A shard's capacity in one dimension once the units above it have a shard of their own."""
    rest, open_ = float(share.sum()), shards
    for x in np.sort(share)[::-1]:
        if open_ < 2 or x * open_ <= rest:
            break
        rest, open_ = rest - x, open_ - 1
    return rest / open_


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and the group (a 64-bit hash of the text; a collision merely keeps two groups together)."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )


def assign(docs: DataFrame, shards: int = 8, slices: int = SLICES, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot."""
    spark = docs.sparkSession
    buckets = buckets or max(BUCKETS, BUCKETS_EACH * shards)
    rows = stage(measured(docs), "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups, "shard-groups")
    total = groups.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    weight = {k: F.col(k) / float(total[k] or 1) * shards for k in ("size", "tokens", "n")}
    # at most 3 * shards * slices rows, as their weights add up to the shards in each dimension
    heavy = groups.filter(F.greatest(*weight.values()) * slices > 1).select("grp", F.when(weight["size"] > 1, F.ceil(weight["size"] * slices)).otherwise(1).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64(PLACE), F.col("pieces")).cast("int")  # rows that are equal in every column have places of their own
    units = numbered(rows).join(small(heavy), "grp", "left").withColumns({
        "a": F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("grp"), F.lit(buckets))).otherwise(F.col("grp")),
        "b": F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(piece),
    })
    # as many rows as units: buckets, 3 * shards * slices groups and shards * slices pieces
    sums = units.groupBy("a", "b").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("a", "b").collect()
    placed = pack(np.array([[r["size"], r["tokens"], r["n"]] for r in sums], dtype=np.float64), shards, LAW)
    plan = local_table(spark, [(r["a"], r["b"], int(k)) for r, k in zip(sums, placed)], "a long, b int, shard int")
    sharded = units.join(F.broadcast(plan), ["a", "b"])  # a row for each unit
    return number(sharded.select("doc_id", "size", "text_crc32", "tokens", "shard"))


def number(sharded: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, without gathering a shard."""
    sorted_ = sharded.sortWithinPartitions("shard", "doc_id", "text_crc32")
    kept = numbered(stage(sorted_, "shard-sorted")).withColumn("part", F.shiftright(PLACE, ROW_BITS))
    runs = stage(kept.groupBy("part", "shard").agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("n")), "shard-runs")  # files x shards
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("part", "shard", (before - F.col("first")).alias("shift"))
    return kept.join(small(shift), ["part", "shard"]).withColumn("slot", F.col(PLACE) + F.col("shift")).drop(PLACE, "part", "shift")


def op3_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
