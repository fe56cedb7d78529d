"""LM scoring by a hidden Markov model over words (operator 7).

A latent state emits a word class and the class emits the word. A class is made of
a word's first byte, last two bytes and length, hashed into CLASSES; the end of
a text is a token with a class of its own. Baum-Welch counts (start, transition,
state by class) are summed over the partitions of all training texts in each
round; a word's share of its class comes from the counts of all training words,
plus one, with one further share for words unseen in training. Scaled forward
recursion over a whole text then gives its exact log likelihood under the model.

Counts of words are never gathered on one machine. Texts are read in blocks; each
block has a dictionary of its own distinct words, so a word is counted once for
each block. Words that a few blocks show to be widespread, COMMON at most, are
summed in each task first and their counts are broadcast; all others meet their
counts by a shuffle on the word's hash. Blocks meet their dictionaries again by a
shuffle on the block.

Neither training nor scoring cuts a text. Expected counts are taken segment by
segment to bound memory, with the forward message that enters a segment and the
backward message that enters from behind: products of the steps of each segment
carry both over a text, so the counts are those of the whole text. The memory of
a task is bounded by a block of about BLOCK bytes or one single text.

Words are told apart by 64-bit hashes. Null texts count as empty and have the end
token only. A null doc_id is not held out. Without training texts every count is
0. Repeated rows are rows like any other; an empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foilframe.llm.staging import documents, stage, text_batches
from foilframe.llm.textblocks import LOWER, hash_words, lean, slices, text_bytes, word_spans

STATES, CLASSES, ROUNDS, SEGMENT, SEED = 6, 2048, 4, 512, 5
END = CLASSES - 1
BLOCK = 16 << 20
EM_TOKENS = 1 << 18
#: Widespread words whose counts are broadcast, at most, and blocks that are looked at to find them.
COMMON, LOOKED_AT = 100_000, 8
MOST_PARTITIONS = 50_000


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_classes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of each word, from its first byte, last two and length."""
    low = LOWER[raw].astype(np.int64)
    first, last, before = low[start], low[end - 1], np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0)
    return ((first * 769 + last * 131 + before * 31 + np.minimum(end - start, 6) * 5003) * 2654435761 >> 7) % END


def _classes_of(column: pa.Array) -> np.ndarray:
    raw, at = text_bytes(column)
    return (word_classes(raw, *word_spans(raw, at)) if len(raw) else np.zeros(0)).astype(np.int16)


def to_planes(x: np.ndarray) -> bytes:
    """32-bit integers, all low bytes first: the high ones are mostly zero and compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def coded(docs: DataFrame) -> DataFrame:
    """For each block of texts: a row for each distinct token (word, class, pos, n) and one for each text (doc_id, held, tokens, classes).

    tokens has the positions, in the block's dictionary, of the words and the end.
    """
    names = ["block", "word", "class", "pos", "n", "doc_id", "held", "tokens", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BLOCK):
                yield from one(part)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, n_docs = uuid.uuid4().int & ((1 << 62) - 1), len(batch)
        found = [(*hash_words(part.column(2)), _classes_of(part.column(2))) for part in slices(batch, 2, 2 << 20)]
        hashes, counts, classes = (np.concatenate(x) for x in zip(*found))
        del found
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        words, first, index, seen = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        by_count = np.argsort(-seen, kind="stable")  # common words get small positions
        rank = np.empty(len(words), dtype=np.int64)
        rank[by_count] = np.arange(len(words))
        token = rank[index]
        trained = np.repeat(~held, counts)
        n = np.bincount(token[trained], minlength=len(words))
        # the end: word 0 of class END, at the last position
        word = np.append(words[by_count].view(np.int64), 0)
        kind = np.append(classes[first[by_count]].astype(np.int64) if len(words) else np.zeros(0, np.int64), END)
        n = np.append(n, int((~held).sum()))
        k = len(word)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, block)), pa.array(word), pa.array(kind.astype(np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.nulls(k, batch.column(0).type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())],
            names=names,
        )
        bound = np.concatenate(([0], np.cumsum(counts)))
        tokens = [to_planes(np.append(token[s:e], k - 1)) for s, e in zip(bound[:-1], bound[1:])]
        kinds = [np.append(classes[s:e], END).astype("<u2").tobytes() for s, e in zip(bound[:-1], bound[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n_docs, block)), pa.nulls(n_docs, pa.int64()), pa.nulls(n_docs, pa.int32()), pa.nulls(n_docs, pa.int32()), pa.nulls(n_docs, pa.int64()), batch.column(0), pa.array(held), pa.array(tokens, pa.binary()), pa.array(kinds, pa.binary())],
            names=names,
        )

    source = docs.select("doc_id", held_out().alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"block long, word long, class int, pos int, n long, doc_id {kind}, held boolean, tokens binary, classes binary")


class Model:
    """start: K, move: K x K, emit: K x CLASSES, as probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, class_share: np.ndarray, states: int, seed: int) -> "Model":
        """States that stay, each with the overall class shares shaken at random."""
        rng = np.random.default_rng(seed)
        emit = class_share * np.exp(rng.normal(0, 0.7, (states, len(class_share))))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def counts(self, kinds: np.ndarray, length: np.ndarray, opens: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves, emissions and the log likelihood of segments.

        kinds: segments x positions, filled up at the end; length: tokens of each;
        opens: whether a segment begins a text. before: the forward message of the
        token ahead of each other segment, summing to 1; after: the backward message
        at a segment's last token, of any scale, all ones where a text ends.
        """
        n, steps = kinds.shape
        k = len(self.start)
        order = np.argsort(-length, kind="stable")
        kinds, length, opens = kinds[order], length[order], opens[order]
        before = np.zeros((n, k)) if before is None else before[order]
        after = np.ones((n, k)) if after is None else after[order]
        alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # rows with more than t tokens
        b = np.ascontiguousarray(self.emit.T)[kinds.T]
        a = np.zeros((steps, n, k))
        scale = np.ones((steps, n))
        cur = np.where(opens[:, None], self.start, before @ self.move) * b[0]
        for t in range(steps):
            m = alive[t]
            if not m:
                break
            if t:
                cur = (a[t - 1, :m] @ self.move) * b[t, :m]
            s = cur.sum(axis=1)
            a[t, :m], scale[t, :m] = cur[:m] / s[:m, None], s[:m]
        beta = after / (a[length - 1, np.arange(n)] * after).sum(axis=1, keepdims=True)  # so that forward times backward sums to 1
        moves = np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            m, later = alive[t], alive[t + 1] if t + 1 < steps else 0
            if later:
                back = beta[:later] * b[t + 1, :later] / scale[t + 1, :later, None]
                moves += a[t, :later].T @ back
                beta[:later] = back @ self.move.T
            a[t, :m] *= beta[:m]  # from here on the share of each state
        moves += before[~opens].T @ (beta * b[0] / scale[0, :, None])[~opens]
        flat = kinds.T.ravel()
        emits = np.stack([np.bincount(flat, a[:, :, s].ravel(), self.emit.shape[1]) for s in range(k)])
        return a[0][opens].sum(axis=0), moves * self.move, emits, float(np.log(scale).sum())

    def through(self, kinds: np.ndarray, length: np.ndarray, opens: bool) -> np.ndarray:
        """Segments as products of their steps: segments x states x states, or x 1 x states from the start if they open a text; scaled to sum to 1."""
        n, steps = kinds.shape
        k = len(self.start)
        order = np.argsort(-length, kind="stable")
        b, length = np.ascontiguousarray(self.emit.T)[kinds[order].T], length[order]
        cur = np.broadcast_to(self.start if opens else np.eye(k), (n, 1 if opens else k, k)).copy()
        for t in range(steps):
            m = int(np.searchsorted(-length, -t, side="left"))
            if not m:
                break
            new = (cur[:m] @ self.move if t or not opens else cur[:m]) * b[t, :m, None, :]
            cur[:m] = new / new.sum(axis=(1, 2), keepdims=True)
        out = np.empty_like(cur)
        out[order] = cur
        return out

    def expected(self, texts: list[np.ndarray], width: int | None = None) -> np.ndarray:
        """The counts of whole texts, one after another in one array: starts, moves, emissions, log likelihood."""
        width = width or SEGMENT
        k, c = self.emit.shape
        parts = [(i, s) for i, x in enumerate(texts) for s in range(0, len(x), width)]
        rows = [texts[i][s : s + width] for i, s in parts]
        before, after = np.zeros((len(rows), k)), np.ones((len(rows), k))
        opens = np.array([s == 0 for _, s in parts], dtype=bool)
        cut = [r for r, (i, _) in enumerate(parts) if len(texts[i]) > width]  # segments of texts that have several, in order
        carry: dict[int, np.ndarray] = {}
        for first in (True, False):
            own = [r for r in cut if opens[r] == first]
            for at in _groups([len(rows[r]) for r in own], EM_TOKENS if first else EM_TOKENS // k):
                chosen = [own[j] for j in at]
                product = self.through(*_filled([rows[r] for r in chosen]), first)
                carry.update(zip(chosen, product))
        for r in cut:
            if not opens[r]:
                before[r] = ahead
            ahead = carry[r][0] if opens[r] else ahead @ carry[r]
            ahead = ahead / ahead.sum()
        for r in reversed(cut):
            if len(texts[parts[r][0]]) > parts[r][1] + width:  # not the last of its text
                after[r] = carry[r + 1] @ after[r + 1]
                after[r] /= after[r].sum()
        total = np.zeros(k + k * k + k * c + 1)
        for at in _groups([len(x) for x in rows], EM_TOKENS):
            start, move, emit, log = self.counts(*_filled([rows[r] for r in at]), opens[at], before[at], after[at])
            total += np.concatenate([start, move.ravel(), emit.ravel(), [log]])
        return total

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_share: np.ndarray) -> "Model":
        """Probabilities from expected counts, smoothed so that nothing is impossible."""
        start, move, emit = start + 0.1, move + 0.1, emit + 10 * class_share
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def log10_classes(self, kinds: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion: log10 probability of each sequence of classes, over its whole length."""
        length = np.array([len(x) for x in kinds])
        order = np.argsort(-length, kind="stable")
        out = np.zeros(len(kinds))
        if not len(kinds):
            return out
        emit = np.ascontiguousarray(self.emit.T)
        bound = np.concatenate(([0], np.cumsum(length[order])))[:-1]
        flat = np.concatenate([kinds[i] for i in order])
        alive = np.searchsorted(-length[order], -np.arange(length.max()), side="left")
        cur = np.broadcast_to(self.start, (len(kinds), len(self.start))).copy()
        total = np.zeros(len(kinds))
        for t, m in enumerate(alive.tolist()):
            cur = (cur[:m] @ self.move if t else cur) * emit[flat[bound[:m] + t]]
            s = cur.sum(axis=1)
            cur /= s[:, None]
            total[:m] += np.log10(s)
        out[order] = total
        return out


def _groups(sizes: list[int], limit: int) -> Iterator[np.ndarray]:
    """Places of sizes by falling size, in groups that take about limit numbers at most when filled up, or one alone."""
    order = np.argsort(-np.array(sizes, dtype=np.int64), kind="stable")
    at = 0
    while at < len(order):
        n = max(1, limit // max(1, sizes[order[at]]))
        yield order[at : at + n]
        at += n


def _filled(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows as one array, filled up at the end, and their lengths."""
    length = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), int(length.max(initial=0))), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, length


def _expected(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts over all rows of texts (classes): one row of counts for each task, added up by position."""
    k, c = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + k * c + 1)
        for batch in batches:
            total += model.expected([np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    sums = texts.mapInArrow(lean(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as the model has numbers
    flat = np.zeros(k + k * k + k * c + 1)
    for r in sums:
        flat[r["i"]] = r["v"]
    return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, c), float(flat[-1])


def train(texts: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """texts: a row of classes for each training text."""
    share = (class_counts + 1) / (class_counts + 1).sum()
    model = Model.first(share, states, seed)
    for _ in range(rounds if class_counts.sum() else 0):
        start, move, emit, _ = _expected(texts, model)
        model = Model.of(start, move, emit, share)
    return model


def with_counts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row of entries (block, word, class, pos, n) with count, its word's n in all blocks; and the words (class, count).

    A word has a row for each block that holds it. Of the words that LOOKED_AT
    blocks or so show to be widespread, the counts are added up in the tasks and
    broadcast; so what is left to meet by word has few rows for each.
    """
    ends = entries.filter(F.col("class") == END)  # one for each block
    every = max(1, ends.count() // LOOKED_AT)
    seen = entries.filter(F.pmod("block", F.lit(every)) == 0).groupBy("word", "class").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")
    common = stage(seen.orderBy(F.desc("blocks"), "word", "class").limit(COMMON).select("word", "class"), "lm-common")
    key = ["word", "class"]
    summed = stage(entries.join(F.broadcast(common), key).groupBy(*key).agg(F.sum("n").alias("count")), "lm-common-counts")  # at most COMMON rows
    of_word = Window.partitionBy(*key)
    rare = entries.join(F.broadcast(common), key, "left_anti").select("block", "class", "pos", F.sum("n").over(of_word).alias("count"), (F.row_number().over(of_word.orderBy("block")) == 1).alias("once"))
    often = entries.join(F.broadcast(summed), key).select("block", "class", "pos", "count", F.lit(False).alias("once"))
    known = stage(rare.unionByName(often), "lm-counts")
    return known.drop("once"), known.filter("once").select("class", "count").unionByName(summed.select("class", "count"))


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = stage(coded(docs), "lm-coded")
    texts = rows.filter("tokens is not null")
    known, words = with_counts(rows.filter("word is not null").select("block", "word", "class", "pos", "n"))
    total, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("class").agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).collect():  # at most CLASSES rows
        total[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    n_all, v_all = int(total.sum()), int(distinct.sum())
    with text_batches(docs.sparkSession):
        model = train(texts.filter("not held").select("classes"), total, states, rounds)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pos, count = left.column("pos").to_numpy(), left.column("count").to_numpy()
        kind = left.column("class").to_numpy()
        c, cls = np.zeros(len(pos)), np.zeros(len(pos), dtype=np.int64)
        c[pos], cls[pos] = count, kind
        base = np.log10((c + 1) / (n_all + v_all + 1))
        own = np.log10((c + 1) / (total + distinct + 1)[cls])
        tokens = [from_planes(x.as_buffer()) for x in right.column("tokens")]
        scores = model.log10_classes([cls[t] for t in tokens])
        return pa.table({
            "doc_id": right.column("doc_id"), "held_out": right.column("held"), "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
            "n_known": pa.array([int((c[t] > 0).sum()) for t in tokens], pa.int64()), "train_tokens": pa.array(np.full(len(tokens), n_all, dtype=np.int64)),
            "base_score": pa.array([float(base[t].sum()) for t in tokens], pa.float64()), "score": pa.array([float(s + own[t].sum()) for s, t in zip(scores, tokens)], pa.float64()),
        })

    # three partitions for each block, so that a task gets one or a few, up to what one shuffle can have; a task holds one block at a time anyway
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(3 * known.filter(F.col("class") == END).count(), MOST_PARTITIONS))
    left, right = known.repartition(parts, "block"), texts.select("block", "doc_id", "held", "tokens").repartition(parts, "block")
    blocks = left.groupBy("block").cogroup(right.groupBy("block"))
    return blocks.applyInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
