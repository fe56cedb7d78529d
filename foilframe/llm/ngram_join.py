"""N-gram Jaccard join by filtering under several global token orders (operator 6).

Documents are sets of word shingles. Two of them can reach the threshold only if
their prefixes share a token, whatever total order the tokens are put in. Under
the first order, rare tokens first, prefixes are posted and met; a pair found so
must also share prefix tokens under the other orders, and its parities (of the
tokens by hash, a few bits for each) must allow it, before whole sets are fetched
and compared. All orders put tokens that a sketch finds frequent last, so that
passages which many documents share stay out of most prefixes.

Sets are told apart by a 64-bit hash and equal sets are one node. The groups that
one key may form are kept small on the way:

* stars: nodes with the same least token under a hash are paired with one of their
  own only, the one with the fewest rare tokens, which in a group of near copies
  is the text they were made from; so a large group is linked by about as many
  pairs as it has members;
* lists of tokens that the sketch finds rare are met in tasks sorted by token; one
  that holds more than LIST nodes all the same is counted as frequent;
* lists of frequent tokens get stars of their own first and are then joined only
  across what is not linked yet, so a group that is linked yields no pair. Lists
  above a share of all rows meet their star by a broadcast and each other block
  by block, so none lies in one task.

No link is lost: every pair that meets a filter is compared in full or lies in
one component already. Links are joined to components by alternating stars.

Null texts count as empty. A text without words has an empty set, links with
nothing and is its own component; with fewer words than the width the whole
sequence is one shingle. Texts are read whole. Repeated rows are copies of each
other. An empty table gives an empty result. Null ids never name a component
unless it has no other. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.llm.components import components, longest, met_by
from foilframe.llm.staging import PLACE, documents, numbered, small, stage, text_batches
from foilframe.llm.textblocks import _BASE, hash_words, lean, mix, shingle_sets, slices

WIDTH, PERCENT = 5, 75
ORDERS = 3
#: Counters of the sketch; a table of as many bytes is what is broadcast, whatever the size of the data.
SLOTS = 1 << 22
_CHUNK = 1 << 16
#: Sums of each part of the sketch that are made before the last one.
FAN = 8
#: Nodes up to which the list of a rare token is met in one task.
LIST = 2000
_SALT = [np.uint64(0), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


def frequency_classes(docs: DataFrame, width: int = WIDTH, slots: int = SLOTS) -> np.ndarray:
    """For each slot of the sketch 0 or, if its tokens are frequent, the logarithm of how often they occur.

    Each task counts all its shingles; the tables are added up slot by slot.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, dtype=np.uint32)
        for batch in (part for b in batches for part in slices(b, 0)):
            words, counts = hash_words(batch.column(0))
            n = len(words) - width + 1
            if n <= 0:
                continue
            joined = words[:n].copy()
            for k in range(1, width):
                joined = mix(joined) * np.uint64(_BASE) + words[k : n + k]
            joined = mix(joined + np.uint64(width))
            ends = np.cumsum(counts)
            whole = np.ones(n, dtype=bool)  # shingles within one text
            for k in range(1, width):
                at = ends - k
                whole[at[(at >= 0) & (at < n)]] = False
            at, n = np.unique((joined[whole] & np.uint64(slots - 1)).astype(np.uint32), return_counts=True)
            table[at] += n.astype(np.uint32)
        if table.any():
            counts = np.minimum(table, 255).astype(np.uint8).reshape(-1, _CHUNK)
            used = np.flatnonzero(counts.any(axis=1))
            yield from packed(used.tolist(), [counts[k] for k in used])

    def packed(chunk: list[int], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(chunk), pa.int32()), pa.array(chunk, pa.int32()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["part", "chunk", "counts"])

    def add(kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column(1).to_pylist(), batch.column(2)):
                    total[k] = total.get(k, np.zeros(_CHUNK, dtype=np.uint32)) + np.frombuffer(x.as_buffer(), dtype=kind)
            yield from packed(list(total), list(total.values()))

        return lean(run)

    chunks, columns = slots // _CHUNK, "part int, chunk int, counts binary"
    first = docs.select("text").mapInArrow(lean(count), columns).withColumn("group", F.col("part") % FAN)
    parts = first.repartition(min(chunks * FAN, 64), "chunk", "group").drop("group").mapInArrow(add(np.uint8), columns)  # FAN sums of each chunk
    with text_batches(docs.sparkSession):
        parts = stage(parts.repartition(min(chunks, 16), "chunk").mapInArrow(add(np.uint32), columns), "ngram-sketch")
    total = np.zeros((chunks, _CHUNK), dtype=np.uint32)
    for r in parts.toLocalIterator():  # the sketch: slots counters
        total[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    mean = float(total.mean())
    least = 2 * np.sqrt(mean) + 4
    out = np.zeros((chunks, _CHUNK), dtype=np.uint8)
    for k in range(chunks):  # part by part, to keep the driver's arrays small
        over = total[k] - mean
        out[k] = np.where(over > least, np.minimum(np.log2(np.maximum(over, 1)).astype(np.int64), 31), 0)
    return out.ravel()


def _ranks(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Each token's place in a global order: its class, then a hash."""
    kind = classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    return (kind << np.uint64(59)) | (mix(tokens ^ _SALT[order]) >> np.uint64(5)) if order else (kind << np.uint64(59)) | (tokens >> np.uint64(5))


def _prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1  # n - ceil(t n) + 1


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of tokens hash to i, in 64-bit words. Two to four bits for each token."""
    bits = 1 << max(8, int(2 * len(tokens) - 1).bit_length())
    at = (mix(tokens ^ _SALT[3]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").view("<i8")


def _may_reach(n_a: Column, n_b: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether the parities a and b allow sets of these sizes to reach the threshold: the bits in which they differ are tokens that only one of them has."""
    halved = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    x, y = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    least = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)
    both = (n_a + n_b).cast("long")
    most = both - 2 * F.ceil(percent * both / F.lit(100 + percent))  # 64-bit counts, so the quotient is exact enough
    near = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)  # then the sizes of the parities are one step apart at most
    return near & (least <= most)


def described(docs: DataFrame, classes, width: int, percent: int, orders: int) -> DataFrame:
    """place, doc_id, n, node, prefix (tokens by rank under the first order), cold (how many of them aren't frequent), firsts (least token by three hashes), parity, others (prefix tokens under each other order, cut to 32 bits)."""
    names = ["place", "doc_id", "n", "node", "prefix", "cold", "firsts", "parity", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in (part for b in batches for part in slices(b, 2)):
            tokens, sizes = shingle_sets(batch.column(2), width)
            nodes, prefix, cold, firsts, parity, others = [], [], [], [], [], []
            e = 0
            for n in sizes.tolist():
                s, e = e, e + n
                if not n:
                    for column, empty in ((nodes, 0), (prefix, None), (cold, 0), (firsts, None), (parity, None), (others, None)):
                        column.append(empty)
                    continue
                own, p = tokens[s:e], _prefix_length(n, percent)
                ranks = [_ranks(own, table, k) for k in range(orders)]
                first = [r <= np.partition(r, p - 1)[p - 1] for r in ranks]
                inside = np.flatnonzero(first[0])
                inside = inside[np.argsort(ranks[0][inside])]
                nodes.append(_node(own))
                prefix.append(own[inside].view(np.int64))
                cold.append(int((ranks[0][inside] >> np.uint64(59) == 0).sum()))  # frequent ones come last
                parity.append(_parity(own))
                firsts.append([int(own[np.argmin(mix(own ^ salt))].view(np.int64)) for salt in _SALT[:3]])
                others.append([own[x].astype(np.uint32).view(np.int32) for x in first[1:]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(nodes, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(cold, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int32())))],
                names=names,
            )

    source = docs.select(F.col(PLACE).alias("place"), "doc_id", "text")
    return source.mapInArrow(lean(run), f"place long, doc_id {source.schema['doc_id'].dataType.simpleString()}, n int, node long, prefix array<long>, cold int, firsts array<long>, parity array<long>, others array<array<int>>")


def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """a, b: each node with one of those that share its key, the one with the fewest rare tokens. rows: node, cold, keys and root; written.

    Keys whose nodes all have one root are linked already. Long lists meet their
    lead where they are, by a broadcast of those few leads.
    """
    lists = rows.groupBy(*keys).agg(F.min(F.struct("cold", "node", "root")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("count"))
    leads = stage(lists.filter("lo < hi").select(*keys, F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root"), "count"), "ngram-leads")
    met = met_by(rows, leads, keys, rows.count())
    return met.filter("node != lead AND root != lead_root").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()


def star_pairs(rows: DataFrame) -> DataFrame:
    """a, b: nodes with the same least token under a hash, as stars."""
    keys = rows.filter("n > 0").select("node", "cold", F.col("node").alias("root"), F.posexplode("firsts").alias("which", "token")).distinct()
    return _stars(stage(keys, "ngram-firsts"), ["which", "token"])


def _postings(rows: DataFrame) -> DataFrame:
    """token, node, n, pos, cold of each prefix token."""
    return rows.filter("n > 0").select("node", "n", "cold", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "n", "pos", "cold")


def _reach(n, pos, percent: int):
    """The largest set that one of n tokens can reach the threshold with if they first meet at its place pos.

    The overlap is n - pos at most and t/(1+t) of both sizes at least.
    """
    return (n - pos) * (100 + percent) // percent - n


def cold_pairs(rows: DataFrame, percent: int, most: int = LIST) -> DataFrame:
    """a, b: nodes that share a token which isn't frequent, within each other's reach; and, with b null, the tokens that more than most nodes share after all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
            if rest:
                now = [np.concatenate([r, x]) for r, x in zip(rest, now)]
            new = np.ones(len(now[0]), dtype=bool)  # copies have the same node
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
            now = [x[new] for x in now]
            token = now[0]
            tail = int(np.searchsorted(token, token[-1], side="left")) if len(token) else 0  # the last list may go on
            yield from met([x[:tail] for x in now])
            rest = [x[tail:] for x in now]
            if len(rest[0]) > most + 1:  # too long already: what is kept of it says so
                rest = [x[: most + 1] for x in rest]
        if rest:
            yield from met(rest)

    def met(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, size = np.unique(part[0], return_counts=True)
        if len(over := found[size > most]):
            yield pa.RecordBatch.from_arrays([pa.array(over), pa.nulls(len(over), pa.int64())], names=["a", "b"])
            part = [x[~np.isin(part[0], over)] for x in part]
        token, node, n, pos = part
        reach = _reach(n, pos, percent)
        left, right = [], []
        step = 1
        i = np.flatnonzero(token[1:] == token[:-1])  # rows that have a next one in their list
        while len(i):
            j = i + step
            good = (n[j] <= reach[i]) & (n[i] <= reach[j])
            left.append(i[good]), right.append(j[good])
            step += 1
            i = i[i + step < len(token)]
            i = i[token[i] == token[i + step]]
            if sum(map(len, left)) > 1 << 18:
                yield pairs(node, left, right)
                left, right = [], []
        if left:
            yield pairs(node, left, right)

    def pairs(node: np.ndarray, left: list, right: list) -> pa.RecordBatch:
        a, b = node[np.concatenate(left)], node[np.concatenate(right)]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = _postings(rows).filter("pos < cold").drop("cold").repartition(n, "token").sortWithinPartitions("token", "node")
    return lists.mapInArrow(lean(run), "a long, b long").distinct()


def hot_postings(rows: DataFrame, long: DataFrame) -> DataFrame:
    """The postings of frequent tokens and of those in long (token), each node once."""
    posted = _postings(rows)
    return posted.filter("pos >= cold").unionByName(posted.filter("pos < cold").join(small(long), "token", "left_semi")).distinct()


def rooted(postings: DataFrame, roots: DataFrame) -> DataFrame:
    return postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def hot_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes in different components that share a frequent prefix token, within each other's reach. posted: postings with root; written.

    A long list is dealt to blocks by node; each block meets itself and each other one under a key of both.
    """
    lists = posted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("count"))
    cross = stage(lists.filter("lo < hi").select("token", "count"), "ngram-cross")
    rows = posted.count()
    split = met_by(posted, cross, ["token"], rows)
    parts = F.ceil(F.col("count") / longest(rows)).cast("int")
    keyed = (
        split.withColumn("reach", F.floor((F.col("n") - F.col("pos")) * (100 + percent) / F.lit(percent)) - F.col("n"))
        .withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("key", F.struct("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    )
    x, y = keyed.alias("x"), keyed.alias("y")
    once = (F.col("x.key.lo") == F.col("x.key.hi")) | (F.col("x.block") != F.col("y.block"))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & once & (F.col("x.root") != F.col("y.root")) & (F.col("y.n") <= F.col("x.reach")) & (F.col("x.n") <= F.col("y.reach"))
    return x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def plausible(pairs: DataFrame, rows: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (written) that share prefix tokens under every other order too and whose parities allow them to reach the threshold."""
    about = ["n", "parity", "others"]
    # written, so that nothing but the join is done in the tasks that meet a star's many pairs, which Spark then splits
    known = stage(rows.filter("n > 0").join(small(_ends(pairs)), "node", "left_semi").select("node", *about).dropDuplicates(["node"]), "ngram-known")
    a, b = (known.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in about]) for k in "ab")
    meet = F.lit(True)
    for k in range(orders - 1):
        meet = meet & F.arrays_overlap(F.col("others_a")[k], F.col("others_b")[k])
    return pairs.join(a, "a").join(b, "b").filter(_may_reach(F.col("n_a"), F.col("n_b"), F.col("parity_a"), F.col("parity_b"), percent) & meet).select("a", "b")


def sets_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, n, tokens: the whole sets of the given nodes, each made from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1)):
            tokens, sizes = shingle_sets(batch.column(1), width)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int64)))], names=["node", "n", "tokens"])

    wanted = stage(rows.filter("n > 0").join(small(nodes), "node", "left_semi").groupBy("node").agg(F.min("place").alias("place")), "ngram-wanted")
    texts = docs.select(F.col(PLACE).alias("place"), "text").join(small(wanted), "place").select("node", "text")
    with text_batches(docs.sparkSession):
        return stage(texts.mapInArrow(lean(run), "node long, n int, tokens array<long>"), "ngram-sets")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold."""
    a, b = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"tokens_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(a, "a").join(b, "b").withColumn("shared", shared).filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def similarity_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS, slots: int = SLOTS, most: int = LIST) -> DataFrame:
    """place, doc_id, n_shingles, component_id: the smallest doc_id that links reach. place numbers the rows of docs."""
    docs = numbered(docs)
    table = frequency_classes(docs, width, slots)
    classes = docs.sparkSession.sparkContext.broadcast(table)  # slots bytes
    with text_batches(docs.sparkSession):
        rows = stage(described(docs, classes, width, percent, orders), "ngram-rows")

    def linked(pairs: DataFrame) -> DataFrame | None:
        """Links among the pairs (written), or None."""
        good = stage(plausible(pairs, rows, percent, orders), "ngram-pairs")
        return None if good.isEmpty() else stage(links(good, sets_of(docs, rows, _ends(good), width), percent), "ngram-links")

    met = stage(star_pairs(rows).union(cold_pairs(rows, percent, most)).distinct(), "ngram-met")
    edges, roots = linked(met.filter("b IS NOT NULL")), None

    def grown(more: DataFrame | None) -> None:
        """Takes in more links."""
        nonlocal edges, roots
        if more is not None:
            edges = more if edges is None else edges.union(more)
        if more is not None or roots is None:
            roots = components(edges) if edges is not None else rows.select("node", F.col("node").alias("root")).limit(0)

    grown(None)
    hot = stage(hot_postings(rows, met.filter("b IS NULL").select(F.col("a").alias("token"))), "ngram-hot")
    if not hot.isEmpty():
        grown(linked(stage(_stars(stage(rooted(hot, roots), "ngram-rooted"), ["token"]), "ngram-met")))
        grown(linked(stage(hot_pairs(stage(rooted(hot, roots), "ngram-rooted"), percent), "ngram-met")))

    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = stage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "ngram-named")
    groups = stage(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("count")), "ngram-groups")
    label = stage(met_by(named.select("node", "root", "copies"), groups, ["root"], named.count()).select("node", "component_id", F.col("copies").alias("count")), "ngram-labels")
    about = ["place", "doc_id", F.col("n").cast("long").alias("n_shingles")]
    some = met_by(rows.filter("n > 0").select("place", "doc_id", "n", "node"), label, ["node"], rows.count()).select(*about, "component_id")
    return some.unionByName(rows.filter("n = 0").select(*about, F.col("doc_id").alias("component_id")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, of rows that share it the first."""
    docs = numbered(docs)
    groups = similarity_components(docs, **how)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("place"))
    # without words or ids a row stands for itself
    key = F.when((F.col("n_shingles") > 0) & F.col("component_id").isNotNull(), F.struct(F.col("component_id").alias("c"), F.lit(None).cast("long").alias("p"))).otherwise(F.struct(F.lit(None).cast("long").alias("c"), F.col("place").alias("p")))
    stay = groups.groupBy(key.alias("k")).agg(F.min_by("place", order).alias(PLACE)).select(PLACE)
    return docs.join(stay, PLACE, "left_semi").drop(PLACE)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
