"""Selection, lookup and report operators: DataFrame in, DataFrame out.

Every choice has a total order: where the rule says that the first of equals
wins, an ordinal column decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foilframe.functions import texts as T
from foilframe.functions.scores import vintage_confidence, vintage_score
from foilframe.operators.tables import written

#: Rows up to which a lookup table is sent to every task; beyond it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, which is counted first; as it is otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df in parts of about so many rows by a key without frequent values; rows are counted first.

    For steps whose work or memory the bytes of a file don't show: a file's row
    groups are read by one task each, however much is done for a row.
    """
    return df.repartition(max(1, -(-df.count() // rows)), key)


def first_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order given, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def tiered_lookup(left: DataFrame, key: str, dim: DataFrame, tiers: list[str]) -> DataFrame:
    """left joined to dim on the first tier, and what finds nothing there on the next."""
    rest, out = left, None
    for t, column in enumerate(tiers, 1):
        hit = rest.join(dim, rest[key] == dim[column]).withColumn("tier", F.lit(t))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(dim.select(F.col(column).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")
    return out


CROPS, ANGLES, MODES = ("sub_0.2_0.15", "sub_0.3_0.25", "sub_0.35_0.3"), (-12, -9, -6, -3, 0, 3, 6, 9, 12), (7, 8, 13)


def every_probe() -> Column:
    """The 81 probes of a card's corner in their order, from 0: probe, crop, angle, mode."""
    every = [(x, a, m) for x in CROPS for a in ANGLES for m in MODES]
    return F.array(*[F.struct(F.lit(k).alias("probe"), F.lit(x).alias("crop"), F.lit(a).alias("angle"), F.lit(m).alias("mode")) for k, (x, a, m) in enumerate(every)])


def probes(df: DataFrame) -> DataFrame:
    """df with each of the 81 probes of a card's corner: probe (their order, from 0), crop, angle, mode."""
    return df.withColumn("__probe", F.explode(every_probe())).select(*df.columns, "__probe.*")


def best_probe(read: Column) -> Column:
    """number, crop, angle, mode, raw and confidence of the best probe; of equal scores the first, null where none reads a number.

    read: an array of probes with text, what was read. A card's probes are compared
    within its row: as rows they would all be sorted, since a maximum of texts can't be hashed.
    """
    pattern = "([0-9]{1,3})\\s*/\\s*([0-9]{1,3})"

    def scored(p: Column) -> Column:
        number = F.struct(*[F.regexp_extract(p["text"], pattern, k).cast("int").alias(x) for k, x in ((1, "num"), (2, "total"))])
        return T.bound(number, lambda n: F.struct(vintage_score(n["num"], n["total"], p["angle"]).alias("score"), (-p["probe"]).alias("place"), n.alias("n"), p.alias("p")))

    def told(b: Column) -> Column:
        n, p = b["n"], b["p"]
        number = F.concat(n["num"].cast("string"), F.lit("/"), n["total"].cast("string"))
        confidence = F.round(vintage_confidence(n["num"], n["total"], p["angle"]), 6)
        return F.when(b.isNotNull(), F.struct(number.alias("number"), p["crop"].alias("crop"), p["angle"].alias("angle"), p["mode"].alias("mode"), F.trim(p["text"]).alias("raw"), confidence.alias("confidence")))

    return T.bound(F.array_max(F.transform(F.filter(read, lambda p: p["text"].rlike(pattern)), scored)), told)


def highest_passing(values: list[Column], table: list[tuple], rest: float) -> Column:
    """The highest grade of a fixed list (grade, a limit for each value) whose limits hold for all values; rest if none."""
    grades = []
    for grade, *limits in table:
        holds = F.lit(True)
        for v, limit in zip(values, limits):
            holds = holds & (v <= limit)
        grades.append(F.when(holds, F.lit(grade)))
    return F.coalesce(F.greatest(*grades), F.lit(rest))


def first_of_list(left: DataFrame, candidates: DataFrame, on: list[str], order: str, ok, cap: int) -> DataFrame:
    """left outer with the first of the first cap candidates, by order, that passes ok, a function of the candidate.

    The first candidates of each key become one sorted array, so each row of left
    is met once and no product of both is made.
    """
    extra = [order, *[x for x in candidates.columns if x not in on and x != order]]
    ranked = top_each(candidates, on, [F.col(order)], cap)
    listed = ranked.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*extra))).alias("__list"))  # cap candidates for each key
    met = left.join(small(listed), on, "left").withColumn("__first", F.get(F.filter("__list", ok), F.lit(0)))
    return met.select(*left.columns, *[F.col(f"__first.{x}").alias(x) for x in extra])


def first_match(left: DataFrame, keys: list[str], candidates: DataFrame, on: list[str], ok: Column, order: list[Column], cap: int | None = None) -> DataFrame:
    """left outer with the first candidate, in order, that passes ok; with a cap only the first cap candidates are tried."""
    met = left.join(candidates, on)
    if cap:
        met = met.withColumn("__try", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__try") <= cap).drop("__try")
    best = first_best(met.filter(ok), keys, order)
    extra = [c for c in candidates.columns if c not in on]
    return left.join(best.select(*keys, *extra), keys, "left")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def united(sets: list[DataFrame], keys: list[str], kind: Column) -> DataFrame:
    """kind and keys of each row once, with how many sets hold it and the first of them by name. sets: source and keys, each of one source."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy(kind, *keys).agg(F.count_distinct("source").alias("sources"), F.min("source").alias("first_source"))


def with_files(rows: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """The rows whose file is there, and an observation of blank, missing and placed rows, which is delivered with the first result that is made of them."""
    there = files.select(F.col(key).alias("__file"), F.lit(True).alias("__there")).distinct()
    met = rows.join(small(there), F.col(key) == F.col("__file"), "left")
    blank, found = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", F.coalesce("__there", F.lit(False))
    seen = Observation()
    counted = met.observe(seen, F.count_if(blank).alias("blank"), F.count_if(~blank & ~found).alias("missing"), F.count_if(~blank & found).alias("placed"))
    return counted.filter(~blank & found).select(*rows.columns), seen


def resume(todo: DataFrame, done: DataFrame, key: str, order: list[Column], batch: int = 0) -> DataFrame:
    """What isn't done yet, in order, at most batch rows (0: all)."""
    rest = remaining(todo, done, key).orderBy(*order)
    return rest.limit(batch) if batch else rest


def with_fallback(left: DataFrame, truth: DataFrame, key: str, column: str, fallback: Column) -> DataFrame:
    """left outer with truth; where truth has no value, the fallback."""
    return left.join(truth.select(key, F.col(column).alias("__truth")), key, "left").withColumn(column, F.coalesce("__truth", fallback)).drop("__truth")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The current state of each key: the last row in order."""
    return first_best(df, [key], [c.desc() for c in order])


def rate_limited(df: DataFrame, key: str, bucket: Column, order: list[Column], limit: int) -> DataFrame:
    """Adds bucket, position in it and whether the request passes: the first limit of a key in a bucket do."""
    place = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order))
    return df.withColumn("bucket", bucket).withColumn("place", place).withColumn("allowed", F.col("place") <= limit).withColumn("remaining", F.greatest(F.lit(0), limit - F.least(F.col("place") - 1, F.lit(limit))))


def tag_counts(df: DataFrame, tags: Column) -> DataFrame:
    """How often each tag occurs over all rows' arrays of tags."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, bucket: Column, buckets: list[str]) -> DataFrame:
    """Count of each bucket of a fixed list, 0 where there are none."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(b,) for b in buckets], "bucket string")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


#: Ranges into which what may hold a rank is cut in each pass, by rank and not by value, and the accuracy of their ends.
RANGES, ACCURACY = 256, 10_000
#: Different values, of those that may be at a rank, which one task puts in order.
FEW_VALUES = 1_000_000


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], few: int = FEW_VALUES) -> DataFrame:
    """keys, n, and for each name the value at a rank of its key, from 0; ranks: functions of the column n.

    What may hold a rank is an open interval of values; a pass over the rows counts
    what lies before and inside it and cuts the inside into RANGES of about equal
    counts, of which those beside the rank become the next interval. Cuts follow
    the ranks, so skewed values shrink as fast as even ones, and values that
    repeat at an end are counted there. When at most few rows are inside, their
    values are added up and put in order. Up to that many rows of a key there is
    no such pass; with a hundred times as many there are two.
    """
    named = [f for f in df.schema.fields if f.name in keys]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slot = [*keys, "n", "name", "rank"]
    cuts = lambda v: F.percentile_approx(v, [k / RANGES for k in range(RANGES + 1)], ACCURACY)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("w")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    state = ends.select(*keys, "n", wanted).filter("n > 0").select(*keys, "n", "w.name", "w.rank", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("answer"), F.lit(None).cast("array<double>").alias("cuts"))
    state = written(state, "ranks")

    def met(state: DataFrame) -> DataFrame:
        """The rows of each open state; a row for each key and name, which were counted."""
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"__r.{k}").eqNullSafe(F.col(f"__s.{k}"))
        open_ = state.filter("answer IS NULL")
        return rows.alias("__r").join((F.broadcast(open_) if states <= BROADCAST_ROWS else open_).alias("__s"), on).select(*[F.col(f"__s.{k}").alias(k) for k in keys], "__v", *[c for c in state.columns if c not in keys])

    above, under = F.col("lo").isNull() | (F.col("__v") > F.col("lo")), F.col("hi").isNull() | (F.col("__v") < F.col("hi"))
    while True:
        most, states = state.agg(F.max(F.when(F.col("answer").isNull(), F.col("inside"))), F.count(F.lit(1))).first()
        if (most or 0) <= few:
            break
        at = F.floor((F.col("rank") - F.col("below")) * RANGES / F.col("inside")).cast("int")  # the range that holds the rank, give or take one
        narrow = F.col("inside") > few
        closer = state.withColumns({"lo": F.when(narrow & (at >= 2), F.get("cuts", at - 1)).otherwise(F.col("lo")), "hi": F.when(narrow & (at <= RANGES - 3), F.get("cuts", at + 2)).otherwise(F.col("hi"))}).drop("below", "inside", "cuts")
        counted = met(closer).groupBy(*slot, "lo", "hi").agg(
            F.count_if(F.coalesce(F.col("__v") <= F.col("lo"), F.lit(False))).alias("below"), F.count_if(above & under).alias("inside"), cuts(F.when(above & under, F.col("__v"))).alias("cuts")
        )
        answer = F.when(F.col("rank") < F.col("below"), F.col("lo")).when(F.col("rank") >= F.col("below") + F.col("inside"), F.col("hi"))
        state = written(counted.withColumn("answer", answer).select(*state.columns).unionByName(state.filter("answer IS NOT NULL")), "ranks")
    values = met(state).filter(above & under).groupBy(*slot, "below", "__v").agg(F.count(F.lit(1)).alias("c"))
    through = F.col("below") + F.sum("c").over(Window.partitionBy(*slot).orderBy("__v"))  # at most few rows
    found = values.withColumn("through", through).filter((F.col("through") > F.col("rank")) & (F.col("through") - F.col("c") <= F.col("rank"))).select(*slot, F.col("__v").alias("answer"))
    every = found.unionByName(state.filter("answer IS NOT NULL").select(*slot, "answer"))
    out = every.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("answer"))).alias(k) for k in ranks])
    return out.select(*[F.col(f.name).cast(f.dataType) for f in named], "n", *ranks)


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values at rank round((n-1) * share), half to even, of each key."""
    return at_ranks(df, keys, value, {k: F.bround((F.col("n") - 1) * share) for k, share in shares.items()})


def linear_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles of each key, interpolated between the two values beside the place (n-1) * share."""
    place = {k: (F.col("n") - 1) * share for k, share in shares.items()}
    found = at_ranks(df, keys, value, {f"{k}_{s}": f(p) for k, p in place.items() for s, f in (("lo", F.floor), ("hi", F.ceil))})
    return found.select(*keys, "n", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (p - F.floor(p))).alias(k) for k, p in place.items()])


def alike(texts: DataFrame, names: DataFrame, share: float = 0.7, apart: int = 2, least: int = 4) -> DataFrame:
    """x, name, same: words and names of about the same length that agree in a share of the name's places.

    Of a name's places few may differ, so one of a few pieces of it is whole; words
    are met by those pieces and compared after that.
    """
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("x"), F.length("name"))), lambda i: F.col("x").substr(i, F.lit(1)) == F.col("name").substr(i, F.lit(1))))

    def pieces(n: Column) -> Column:
        k = n - F.ceil(n * share).cast("int") + 1
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(n.alias("n"), F.floor(i * n / k).cast("int").alias("at"), (F.floor((i + 1) * n / k) - F.floor(i * n / k)).cast("int").alias("size")))

    cut = lambda x: lambda p: F.struct(p["n"].alias("n"), p["at"].alias("at"), x.substr(p["at"] + 1, p["size"]).alias("part"))
    b = names.filter(F.length("name") >= least).select("name", F.explode(F.transform(pieces(F.length("name")), cut(F.col("name")))).alias("p"))
    lengths = F.filter(F.sequence(F.length("x") - apart, F.length("x") + apart), lambda n: n >= least)
    a = texts.filter(F.length("x") >= least).select("x", F.explode(F.transform(F.flatten(F.transform(lengths, pieces)), cut(F.col("x")))).alias("p"))
    met = a.join(b, "p").select("x", "name").distinct()
    return met.withColumn("same", same.cast("long")).filter(F.col("same") >= share * F.length("name"))


def similar_names(df: DataFrame, name: str, share: float = 0.7, apart: int = 2, least: int = 4) -> DataFrame:
    """a, b, same: distinct names a < b of about the same length that agree in a share of b's places."""
    rows = df.select(F.col(name).alias("x")).distinct()
    met = alike(rows, rows.withColumnRenamed("x", "name"), share, apart, least)
    return met.filter("x < name").select(F.col("x").alias("a"), F.col("name").alias("b"), "same")


def presence(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows, those with a, with b and with both, and each in percent."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has(a)).alias("n_a"), F.count_if(has(b)).alias("n_b"), F.count_if(has(a) & has(b)).alias("n_both"))
    return counts.select("*", *[F.round(100 * F.col(f"n_{k}") / F.greatest(F.col("total"), F.lit(1)), 1).alias(f"pct_{k}") for k in ("a", "b", "both")])


def top_patterns(df: DataFrame, pattern: Column, ordinal: str, n: int) -> DataFrame:
    """The n commonest patterns; of equally common ones the first seen."""
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n)


def running_totals(df: DataFrame, order: str, values: list[str], block: int = 1000, levels: int = 2) -> DataFrame:
    """Adds run_<value>, the sum up to and including each value of the whole-number column order (unique).

    Rows are summed within blocks of block order values, in parallel, and so are
    the blocks' totals; after levels of blocks a row for each block ** levels
    values is left, and those are summed once over all.
    """
    name, before = f"__block{levels}", lambda v: f"__before{levels}_{v}"
    blocked = df.withColumn(name, F.floor(F.col(order) / block))
    inside = Window.partitionBy(name).orderBy(order)
    totals = blocked.groupBy(name).agg(*[F.sum(v).alias(v) for v in values])
    if levels > 1:
        ahead = running_totals(totals, name, values, block, levels - 1).select(name, *[(F.col(f"run_{v}") - F.col(v)).alias(before(v)) for v in values])
    else:
        over = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        ahead = totals.select(name, *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(before(v)) for v in values])
    met = blocked.join(ahead, name)
    return met.select(*df.columns, *[(F.sum(v).over(inside) + F.col(before(v))).alias(f"run_{v}") for v in values])
