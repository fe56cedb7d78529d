"""Connected components of an edge table by alternating large and small stars, and joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foilframe.llm.staging import stage

#: Keys that are joined by a broadcast, at most; one is if it holds more than one GIANTSth of all rows, and more than LEAST.
GIANTS, LEAST = 4096, 1024
#: Edges above which a node may have more neighbours than one task should meet.
MANY = 1 << 20


def longest(rows: int) -> int:
    """The rows of a key up to which it is left to one task."""
    return max(LEAST, rows // GIANTS)


def met_by(rows: DataFrame, lists: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows joined to lists (keys, count, ...) by keys, where count is how many of the n rows have the key at most.

    Long lists, of which there are GIANTS at most as their counts add up to n,
    meet their rows where those are, by a broadcast.
    """
    if n <= LEAST:
        return rows.join(lists, keys)
    long = F.broadcast(lists.filter(F.col("count") > longest(n)))  # at most GIANTS rows
    return rows.join(long, keys).unionByName(rows.join(long, keys, "left_anti").join(lists, keys))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One half of a round: every node points its larger (or all other smaller) neighbours and itself at its smallest neighbour. n: edges at most."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if n > MANY:
        low = stage(low, "components-low")  # so that nothing but the join is done in the tasks of a hub, which Spark then splits
    met = both.join(low, "u")
    if large:
        out = met.filter("v > u").select(F.col("m").alias("u"), "v")
    else:
        out = met.filter("v != m").select(F.col("m").alias("u"), "v").union(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.filter("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long); root is the component's smallest node.

    Each round is written before the next, so lineage stays short; rounds grow
    with the logarithm of the components' size. Self loops and repeated edges do
    no harm; an empty table has no nodes.
    """
    now = stage(edges.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "components")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stage(_star(_star(now, True, seen[0]), False, seen[0]), "components")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
