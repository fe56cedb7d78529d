"""Images as tables: rows of cells, runs, prefix sums and profiles, which Spark groups and joins by image.

An image is any number of rows (image, y, cells), cells being an array; nothing
here gathers an image in one task but where a line of it is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foilframe.operators.relational import small
from foilframe.operators.tables import written


def lines(df: DataFrame, image: str, cells: Column, width: int) -> DataFrame:
    """image, y, cells: the lines of square or oblong patches that are stored as one array."""
    rows = df.select(F.col(image).alias("image"), cells.alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("all") / width).cast("int") - 1), lambda y: F.slice("all", y * width + 1, F.lit(width)))
    return rows.filter(F.size("all") >= width).select("image", F.posexplode(cut).alias("y", "cells"))


def runs(rows: DataFrame) -> DataFrame:
    """image, y, x0, x1: the runs of set cells in each line, ends included. rows: image, y, cells (boolean)."""
    at = lambda x: F.coalesce(F.get("cells", x), F.lit(False))
    every = F.when(F.size("cells") > 0, F.sequence(F.lit(0), F.size("cells") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(every, lambda x: at(x) & ((x == 0) | ~at(x - 1)))
    last = F.filter(every, lambda x: at(x) & ~at(x + 1))
    return rows.select("image", "y", F.explode(F.arrays_zip(first.alias("x0"), last.alias("x1"))).alias("r")).select("image", "y", "r.x0", "r.x1")


def parts(found: DataFrame) -> DataFrame:
    """runs with part, the number of their connected part: runs that overlap in neighbouring lines belong together.

    Runs are numbered along their image. In each round a run takes the least number
    of itself and its neighbours, and then the number that this one has, so rounds
    grow with the logarithm of a part's extent; each is one job that writes a table and counts what moved.
    """
    line = Window.partitionBy("image").orderBy("y", "x0")
    numbered = written(found.withColumn("run", F.row_number().over(line)), "runs")
    a, b = numbered.alias("a"), numbered.alias("b").hint("merge")
    touch = (F.col("a.image") == F.col("b.image")) & (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1"))
    down = a.join(b, touch).select("a.image", F.col("a.run").alias("run"), F.col("b.run").alias("other"))
    edges = written(down.unionByName(down.select("image", F.col("other").alias("run"), F.col("run").alias("other"))), "run-edges")
    now = numbered.select("image", "run", F.col("run").alias("part"))
    # tables of runs look small to the planner, which would send them all through the driver in each round
    while True:
        near = edges.join(now.select("image", F.col("run").alias("other"), "part").hint("merge"), ["image", "other"]).groupBy("image", "run").agg(F.min("part").alias("near"))
        least = now.join(near.hint("merge"), ["image", "run"], "left").select("image", "run", "part", F.least("part", "near").alias("low"))
        jumped = least.join(least.select("image", F.col("run").alias("low"), F.col("low").alias("further")).hint("merge"), ["image", "low"]).select("image", "run", F.col("part").alias("before"), F.least("low", "further").alias("part"))
        seen = Observation()
        now = written(jumped.observe(seen, F.count_if(F.col("part") < F.col("before")).alias("moved")), "run-parts").select("image", "run", "part")
        if not seen.get["moved"]:
            return numbered.join(now.hint("merge"), ["image", "run"])


def part_sizes(df: DataFrame) -> DataFrame:
    """image, parts, largest: how many connected parts an image has, and the cells of the largest. df: what parts() gives."""
    sizes = df.groupBy("image", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"))
    return sizes.groupBy("image").agg(F.count(F.lit(1)).cast("int").alias("parts"), F.max("cells").alias("largest"))


def profiles(rows: DataFrame) -> DataFrame:
    """image, axis, at, mean: the mean of each column (axis x) and each line (axis y). rows: image, y, cells (numbers)."""
    cells = rows.select("image", "y", F.posexplode("cells").alias("x", "v"))
    both = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("at")))).alias("p")
    return cells.select("image", both, "v").groupBy("image", "p.axis", "p.at").agg(F.avg("v").alias("mean"))


def roughness(profile: DataFrame) -> DataFrame:
    """image, axis, rough: the deviation of a profile's distance from itself smoothed by 1 4 6 4 1.

    Beyond an end the profile is mirrored at its last place, which isn't repeated. A
    profile of five places or fewer isn't smoothed.
    """
    line = Window.partitionBy("image", "axis").orderBy("at")
    at, n = F.row_number().over(line), F.count(F.lit(1)).over(Window.partitionBy("image", "axis"))
    back, ahead = lambda k: F.lag("mean", k).over(line), lambda k: F.lead("mean", k).over(line)
    taps = profile.select("image", "axis", "mean", at.alias("at"), n.alias("n"), *[back(k).alias(f"b{k}") for k in (1, 2)], *[ahead(k).alias(f"a{k}") for k in (1, 2)])
    c = F.col
    b2 = F.when(c("at") == 1, c("a2")).when(c("at") == 2, c("mean")).otherwise(c("b2"))
    a2 = F.when(c("at") == c("n"), c("b2")).when(c("at") == c("n") - 1, c("mean")).otherwise(c("a2"))
    smooth = (b2 + 4 * F.coalesce("b1", "a1") + 6 * c("mean") + 4 * F.coalesce("a1", "b1") + a2) / 16
    return taps.groupBy("image", "axis").agg(F.stddev_pop(F.when(c("n") > 5, F.abs(c("mean") - smooth)).otherwise(c("mean"))).alias("rough"))


def summed_area(rows: DataFrame) -> DataFrame:
    """image, y, x, s, q: the sums of cells and of their squares above and left of a corner; corners lie between cells, from 0 to the size. rows: image, y, cells (numbers), lines from 0."""
    sums = F.aggregate("cells", F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))), lambda out, v: F.concat(out, F.array(F.struct((F.element_at(out, -1)["s"] + v).alias("s"), (F.element_at(out, -1)["q"] + v * v).alias("q")))))
    along = rows.select("image", (F.col("y") + 1).alias("y"), F.posexplode(sums).alias("x", "r")).select("image", "y", "x", "r.s", "r.q")
    down = Window.partitionBy("image", "x").orderBy("y")
    table = along.select("image", "y", "x", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"))
    top = along.filter("y = 1").select("image", F.lit(0).alias("y"), "x", F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return table.unionByName(top)


def rectangle_stats(area: DataFrame, rectangles: DataFrame) -> DataFrame:
    """image, name, n, mean, variance of each rectangle by four look-ups. area: summed_area(); rectangles: name, y0, x0, y1, x1, the far ends excluded; those that leave an image give no row."""
    c = F.col
    corners = F.explode(F.array(*[F.struct(c(y).alias("y"), c(x).alias("x"), F.lit(sign).alias("sign")) for y, x, sign in (("y0", "x0", 1), ("y0", "x1", -1), ("y1", "x0", -1), ("y1", "x1", 1))])).alias("k")
    wanted = rectangles.filter("y1 > y0 AND x1 > x0").select("name", ((c("y1") - c("y0")) * (c("x1") - c("x0"))).alias("n"), corners).select("name", "n", "k.*")
    met = area.join(small(wanted), ["y", "x"])
    sums = met.groupBy("image", "name", "n").agg(F.sum(c("sign") * c("s")).alias("s"), F.sum(c("sign") * c("q")).alias("q"), F.count(F.lit(1)).alias("corners")).filter("corners = 4")
    mean = c("s") / c("n")
    return sums.select("image", "name", "n", mean.alias("mean"), F.greatest(c("q") / c("n") - mean * mean, F.lit(0.0)).alias("variance"))
