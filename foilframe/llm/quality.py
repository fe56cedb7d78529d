"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 9).

A document is described by statistics of its bytes and words, taken for whole
blocks of texts at once in numpy. Trees are grown level by level on binned
features from histograms of gradients, and kept as flat arrays: every tree is a
complete binary tree of the same depth, so scoring a block is a few vectorised
look-ups for each tree and level.

The classifier is fitted on at most MAX_TRAIN labelled rows, taken by smallest
hash of doc_id, that are not held out: crc32(doc_id as text) mod 5 is not 0.
Labels, language, source and doc_id are never features. Null labels are left
out; without any label of either class the score is the smoothed share of label
1 (one half without labels). Empty and null texts have zero statistics and are
scored like others; repeated rows get equal scores; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.llm.staging import PLACE, documents, numbered
from foilframe.llm.textblocks import LOWER, hash_words, lean, slices, text_bytes, word_spans

MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 48, 4, 32, 0.15, 1.0
THRESHOLD = 0.3
BLOCK = 1 << 20

FEATURES = ("log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "stops", "symbols", "bangs", "bars", "foreign", "lines", "distinct_words", "distinct_pairs", "short_words", "caps", "marked_words", "top_repeat")


def _class(*groups: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for g in groups:
        out[list(g)] = True
    return out


_BYTES = {
    "upper": _class(bytes(range(65, 91))),
    "digits": _class(b"0123456789"),
    "stops": _class(b".,;:?"),
    "symbols": _class(b"#$%&*@^~=<>{}[]\\/_+`"),
    "bangs": _class(b"!"),
    "bars": _class(b"|"),
    "foreign": _class(bytes(range(128, 256))),
    "lines": _class(b"\n"),
}


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over [at[i], at[i+1])."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes of each owner, and the count of its commonest."""
    most = np.zeros(n, dtype=np.int64)
    if not len(hashes):
        return most.copy(), most
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(o))))
    return np.bincount(o[first], minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = [_statistics(part.column(0)) for part in slices(batch, 0, BLOCK)]  # in parts, to bound the temporary arrays
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _statistics(column: pa.Array) -> np.ndarray:
    raw, at = text_bytes(column)
    n = len(at) - 1
    size = np.diff(at)
    some = np.maximum(size, 1)
    out = np.zeros((n, len(FEATURES)))
    col = {name: k for k, name in enumerate(FEATURES)}
    for name, inside in _BYTES.items():
        out[:, col[name]] = _sums(inside[raw], at) / some
    hashes, words = hash_words(column)
    start, end = word_spans(raw, at)
    length = end - start
    bound = np.concatenate(([0], np.cumsum(words)))
    many = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, owner, length)
    out[:, col["log_bytes"]] = np.log1p(size)
    out[:, col["log_words"]] = np.log1p(words)
    out[:, col["word_bytes"]] = _sums(length, bound) / many
    out[:, col["longest_word"]] = np.log1p(longest)
    out[:, col["short_words"]] = _sums(length <= 3, bound) / many
    if len(start):
        out[:, col["caps"]] = _sums(LOWER[raw[start]] != raw[start], bound) / many
        last = raw[end - 1]
        out[:, col["marked_words"]] = _sums((_BYTES["symbols"] | _BYTES["bangs"] | _BYTES["bars"])[last], bound) / many
    distinct, most = _distinct(owner, hashes, n)
    out[:, col["distinct_words"]] = distinct / many
    out[:, col["top_repeat"]] = most / many
    if len(hashes) > 1:
        same = owner[1:] == owner[:-1]
        pairs = (hashes[:-1] * np.uint64(31) + hashes[1:])[same]
        out[:, col["distinct_pairs"]] = _distinct(owner[1:][same], pairs, n)[0] / np.maximum(words - 1, 1)
    return out


class Forest:
    """Flat arrays: for each tree and inner node the feature and the bin that goes left at most; for each leaf a value."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, bin_: np.ndarray, value: np.ndarray, base: float):
        self.edges, self.feature, self.bin, self.value, self.base = edges, feature, bin_, value, base

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int64) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        bins, rows = self.binned(x), np.arange(len(x))
        margin = np.full(len(x), self.base)
        for feature, bin_, value in zip(self.feature, self.bin, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < len(feature):  # all rows are on one level
                node = 2 * node + 1 + (bins[rows, feature[node]] > bin_[node])
            margin += value[node - len(feature)] if len(node) else 0
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosts trees on log loss; x: rows of statistics, y: 0 or 1."""
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    forest = Forest(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), base)
    if len(np.unique(y)) < 2:
        return forest
    binned = forest.binned(x)
    n_features = x.shape[1]
    margin = np.full(len(y), base)
    all_f, all_b, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = node - first
            slot = (here[:, None] * n_features + np.arange(n_features)) * bins + binned  # one histogram for each node and feature
            g = np.bincount(slot.ravel(), np.repeat(grad, n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(axis=2)
            h = np.bincount(slot.ravel(), np.repeat(hess, n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SMOOTH) + (gt - g) ** 2 / (ht - h + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(h < 1) | (ht - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1).max(axis=1) > 1e-9
            feature[first : first + width] = best // bins
            cut[first : first + width] = np.where(good, best % bins, bins)  # no split: all go left
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + SMOOTH)
        margin += value[leaf]
        all_f.append(feature), all_b.append(cut), all_v.append(value)
    return Forest(edges, np.array(all_f), np.array(all_b), np.array(all_v), base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def describe(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns keep, and x: the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    source = docs.select(text_col, *keep)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(lean(run), f"{ddl}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Fits on at most max_train labelled rows outside the held-out fold, chosen by hash of their id."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    # sample has at most max_train rows; an id that repeats in docs may give more, of which max_train are taken
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = describe(met, "text", ["doc_id", "label"]).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(max_train).collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found], dtype=np.float64))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, place, score; place is that of numbered() or else numbers the rows of this scan alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(forest.score(statistics(batch.column(0))), pa.float64())], names=["doc_id", "place", "score"])

    place = F.col(PLACE) if PLACE in docs.columns else F.monotonically_increasing_id()
    source = docs.select("text", "doc_id", place.alias("place"))
    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, place long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    docs = numbered(docs)
    good = score(docs, train(docs, labels)).filter(F.col("score") >= threshold).select(F.col("place").alias(PLACE))
    return docs.join(good, PLACE, "left_semi").drop(PLACE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
