"""Mixing sources to target weights by hash-threshold histograms (operator 5).

Words are summed by source and hash bucket. Running sums over the buckets give
the bucket in which a source's budget runs out; only the rows of that bucket are
summed again by the next bits of their hash, until it holds a single hash or the
bits are used up. What comes out is one threshold for each source, and a row is
taken by comparing its hash with it; nothing is sorted. Budgets are nested: a
larger one takes all that a smaller one takes. Targets above a source's size take
every document whole times and the threshold decides about one time more.

Sources weigh 1, 2, 3, repeating, by code point, null last, and share all words;
a target stops at CAP times the size of its source and the excess is shared again
by weight until none is above. A text of null has no words. The hash covers id
and text, so reruns agree, and only rows that repeat both share their fate. An
empty table gives an empty result; without any words nothing is taken. Columns
other than id, text and source are not read.

Sources, thresholds and targets are tables with a row for each source, however
many there are; the driver sees sums over all of them only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foilframe.llm.staging import PLACE, ROW_BITS, documents, free, numbered, small, stage

CAP = 3
WEIGHTS = (1, 2, 3)
BITS, LEVELS = 10, 6  # a hash of 60 bits, in steps of 10


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, size: one row each) with k, their place by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    sorted_ = numbered(stage(sources.repartitionByRange(*order).sortWithinPartitions(*order), "mix-sources")).withColumn("part", F.shiftright(PLACE, ROW_BITS))
    parts = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each file, which hold ranges of the order
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return sorted_.join(small(before), "part").select((F.col("before") + F.col(PLACE) - F.shiftleft(F.col("part"), ROW_BITS)).alias("k"), "source", "size")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (k, source, size) with target.

    A source's target is its weight times a level, or its cap if that is less;
    the level that shares out all words rises as capped sources drop out, until
    none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = stage(sources.withColumn("weight", weight), "mix-weights")
    level = 0.0
    while True:
        over = level * F.col("weight") > cap * F.col("size")
        r = rows.agg(F.sum("size").alias("all"), F.sum(F.when(over, cap * F.col("size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        now = (float(r["all"]) - float(r["capped"] or 0)) / float(r["open"])
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least(level * F.col("weight"), cap * F.col("size").cast("double"))).drop("weight")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, a hash of 60 bits, and place, which numbers the rows of docs."""
    return numbered(docs).select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS * LEVELS).alias("h"),
        F.col(PLACE).alias("place"),
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """k, cut for each source k of goals (k, budget): rows with h < cut hold about budget words. rows: k, h, size."""
    everything = F.lit(1 << (BITS * LEVELS))
    cuts = goals.filter("budget <= 0").select("k", F.lit(0).cast("long").alias("cut"))
    open_ = goals.filter("budget > 0").select("k", F.lit(0).cast("long").alias("at"), "budget")  # first hash of the bucket being split, words left to take
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(small(open_), "k")
        if level:
            inside = inside.filter(F.shiftright("h", shift + BITS) == F.shiftright("at", shift + BITS))
        sums = inside.groupBy("k", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        order = Window.partitionBy("k").orderBy("bucket")  # at most 1,024 buckets for each source
        crossed = sums.withColumn("through", F.sum("size").over(order)).filter("through > budget").groupBy("k").agg(F.min(F.struct("bucket", "through", "size", "low", "high")).alias("x"))
        wanted = F.col("budget") - (F.col("x.through") - F.col("x.size"))  # words still wanted from this bucket
        cut = (
            F.when(F.col("x").isNull(), everything)  # the budget isn't used up: all rows are taken
            .when(F.col("x.low") == F.col("x.high"), F.when(2 * wanted > F.col("x.size"), F.col("x.high") + 1).otherwise(F.col("x.low")))  # a single hash: in or out, whichever is nearer
            .when(F.lit(level == LEVELS - 1), F.col("x.low"))
        )
        step = stage(open_.join(crossed, "k", "left").select("k", cut.alias("cut"), F.shiftleft("x.bucket", shift).alias("at"), wanted.alias("budget")), "mix-cuts")
        cuts = cuts.unionByName(step.filter("cut IS NOT NULL").select("k", "cut"))
        open_ = step.filter("cut IS NULL").select("k", "at", "budget")
        if open_.isEmpty():
            break
    return cuts


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times, place. place numbers the rows of docs."""
    rows = stage(measured(docs), "mix-rows")
    sources = targets(ranked(rows.groupBy("source").agg(F.sum("size").alias("size"))), weights, cap)
    whole = F.when(F.col("size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("int")
    plan = stage(sources.withColumn("whole", whole).withColumn("budget", F.when(F.col("whole") < cap, F.col("target") - F.col("whole") * F.col("size")).otherwise(0.0)), "mix-plan")
    names = plan.select("k", "source", F.col("size").alias("source_size"), "target", "whole")
    keyed = rows.withColumnRenamed("source", "from").join(small(names), F.col("from").eqNullSafe(F.col("source"))).drop("from")
    cuts = thresholds(keyed.select("k", "h", "size"), plan.select("k", "budget"))
    times = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.col("whole") + (F.col("h") < F.col("cut")).cast("int"))
    return keyed.join(small(cuts), "k").withColumn("times", times).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "place")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns."""
    columns, docs = docs.columns, numbered(docs)
    n = free("times", columns)
    times = mix(docs, weights, cap).filter("times > 0").select(F.col("place").alias(PLACE), F.col("times").alias(n))
    return docs.join(times, PLACE).select(*columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(free("copy", columns))).select(*columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
