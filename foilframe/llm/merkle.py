"""Document fingerprints: a Merkle tree over sections, paragraphs and passages (operator 4).

A paragraph is a line with its end. Its leaves are passages of a few words whose
ends depend on the bytes before them only, so an edit moves no end but its own;
a section is a run of paragraphs that ends at a blank line or, as many texts have
none, at a paragraph whose hash says so. A node's hash covers its children's
hashes, the root is the fingerprint: equal texts, and only they, have equal
roots, and where two trees differ only the differing branches are entered to
find the edited spans. The likeness of two trees is the share of their bytes
that lies in equal leaves, repeats counted.

Null texts count as empty; empty texts have a tree without leaves, likeness 1 to
each other and 0 to any other. Whole texts are read. An empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foilframe.llm.staging import documents, stage, text_batches
from foilframe.llm.textblocks import WHITE, lean

_MARK = np.random.default_rng(71).integers(0, 1 << 32, 256, dtype=np.uint64)
WORDS_A_LEAF, BYTES_A_CUT, PARAGRAPHS_A_SECTION = 8, 512, 6
#: How often what lies between matched nodes is aligned again.
ROUNDS = 12


def _hash(kind: bytes, *parts: bytes) -> bytes:
    return hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()


class Tree:
    """leaves: (hash, start byte, end byte); paragraphs and sections: (hash, first child, end child)."""

    __slots__ = ("leaves", "paragraphs", "sections", "root", "size", "_weights")

    def __init__(self, text: str):
        data = text.encode("utf-8", "surrogatepass")
        self.size, self._weights = len(data), None
        self.leaves, self.paragraphs, self.sections = [], [], []
        ends = passage_ends(np.frombuffer(data, dtype=np.uint8)).tolist()
        blake, start, first = hashlib.blake2b, 0, 0
        own: list[bytes] = []
        section: list[bytes] = []
        section_first = 0
        for k, end in enumerate(ends):
            leaf = blake(data[start:end], digest_size=8).digest()
            self.leaves.append((leaf, start, end))
            own.append(leaf)
            if data[end - 1] == 10 or end == len(data):
                h = _hash(b"p", *own)
                self.paragraphs.append((h, first, k + 1))
                blank = not data[self.leaves[first][1] : end].strip()
                section.append(h)
                if blank or h[0] % PARAGRAPHS_A_SECTION == 0 or end == len(data):
                    self.sections.append((_hash(b"s", *section), section_first, len(self.paragraphs)))
                    section_first, section = len(self.paragraphs), []
                first, own = k + 1, []
            start = end
        self.root = _hash(b"r", *(h for h, _, _ in self.sections))

    @property
    def fingerprint(self) -> str:
        return self.root.hex()

    @property
    def weights(self) -> dict[bytes, int]:
        if self._weights is None:
            self._weights = Counter()
            for h, s, e in self.leaves:
                self._weights[h] += e - s
        return self._weights

    def likeness(self, other: "Tree") -> float:
        """Share of both texts' bytes that lies in equal leaves."""
        if self.root == other.root:
            return 1.0
        a, b = self.weights, other.weights
        if len(a) > len(b):
            a, b = b, a
        shared = sum(min(w, b[h]) for h, w in a.items() if h in b)
        return 2 * shared / (self.size + other.size)

    def edits(self, old: "Tree") -> list[tuple[int, int, int, int]]:
        """Byte spans (start, end, old start, old end) in which this text and the old one differ; outside of them both are the same.

        The children of the roots are aligned, then those of the branches that
        differ, down to the leaves; branches with equal hashes aren't entered. A
        span that is empty in one text is what was put in or taken out.
        """
        if self.root == old.root:
            return []
        out: list[tuple[int, int, int, int]] = []
        for s0, s1, t0, t1 in differences([h for h, _, _ in self.sections], [h for h, _, _ in old.sections]):
            p0, p1, q0, q1 = *_children(self.sections, s0, s1, len(self.paragraphs)), *_children(old.sections, t0, t1, len(old.paragraphs))
            for a0, a1, b0, b1 in differences([h for h, _, _ in self.paragraphs[p0:p1]], [h for h, _, _ in old.paragraphs[q0:q1]]):
                l0, l1 = _children(self.paragraphs, p0 + a0, p0 + a1, len(self.leaves))
                m0, m1 = _children(old.paragraphs, q0 + b0, q0 + b1, len(old.leaves))
                for c0, c1, d0, d1 in differences([h for h, _, _ in self.leaves[l0:l1]], [h for h, _, _ in old.leaves[m0:m1]]):
                    out.append((*_children(self.leaves, l0 + c0, l0 + c1, self.size), *_children(old.leaves, m0 + d0, m0 + d1, old.size)))
        return out


def _children(nodes: list[tuple[bytes, int, int]], first: int, end: int, last: int) -> tuple[int, int]:
    """Where the children of nodes[first:end] begin and end; last: where those of all nodes end."""
    start = nodes[first][1] if first < len(nodes) else last
    return start, nodes[end - 1][2] if end > first else start


def differences(a: list[bytes], b: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Ranges (a0, a1, b0, b1), in order, outside of which a and b are the same.

    Equal ends are matched first, then the elements that both have once and in
    the same order; what lies between them is aligned in the same way, ROUNDS
    deep at most, which bounds the work by ROUNDS passes.
    """
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        a0, a1, b0, b1, depth = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 and b0 == b1:
            continue
        anchors = _anchors(a, a0, a1, b, b0, b1) if depth < ROUNDS and a0 < a1 and b0 < b1 else []
        if not anchors:
            out.append((a0, a1, b0, b1))
            continue
        i, j = a0, b0
        for x, y in [*anchors, (a1, b1)]:
            todo.append((i, x, j, y, depth + 1))
            i, j = x + 1, y + 1
    return sorted(out)


def _anchors(a: list[bytes], a0: int, a1: int, b: list[bytes], b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest list of places, rising in both, of elements that occur once in each range."""
    once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {h: j for j, h in enumerate(b[b0:b1], b0) if once_b[h] == 1}
    pairs = [(i, at[h]) for i, h in enumerate(a[a0:a1], a0) if once_a[h] == 1 and h in at]
    ends: list[int] = []  # the least last place of a rising list of each length
    last: list[int] = []  # the pair that ends it
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before[k] = last[n - 1] if n else -1
        if n == len(ends):
            ends.append(j), last.append(k)
        else:
            ends[n], last[n] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def passage_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the passages: at each line feed, at some white space, and rarely elsewhere, as the last four bytes say."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    mark = _MARK[raw]
    key = mark.copy()
    for k in (1, 2, 3):
        key[k:] += mark[:-k] * np.uint64(2 * k + 1)
    key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    cut = (raw == 10) | (WHITE[raw] & (key % np.uint64(WORDS_A_LEAF) == 0)) | (key % np.uint64(BYTES_A_CUT) == 1)
    if n > 3:  # a run of one byte is not cut at each place
        cut[3:] &= (raw[3:] == 10) | (raw[3:] != raw[2:-1]) | (raw[3:] != raw[1:-2]) | (raw[3:] != raw[:-3])
    ends = np.flatnonzero(cut) + 1
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def edited(text: str, after: str) -> str:
    """The last third of the text's characters replaced by the first as many of another."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, sections, paragraphs, leaves (counts) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [Tree(x.as_py() or "") for x in batch.column(1)]
            counts = [pa.array([len(getattr(t, k)) for t in trees], pa.int32()) for k in ("sections", "paragraphs", "leaves")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.fingerprint for t in trees], pa.string()), *counts], names=["doc_id", "fingerprint", "sections", "paragraphs", "leaves"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string, sections int, paragraphs int, leaves int")


def locate_edits(pairs: DataFrame, old_col: str = "old_text", new_col: str = "new_text") -> DataFrame:
    """pairs with a column edits: byte spans of the new text, with those of the old one that they stand for; outside of them the texts agree."""
    names = ("start", "end", "old_start", "old_end")

    @F.pandas_udf("array<struct<start:long,end:long,old_start:long,old_end:long>>")
    def spans(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, x)) for x in Tree(b or "").edits(Tree(a or ""))] for a, b in zip(old, new)])

    return pairs.withColumn("edits", spans(old_col, new_col))


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_start"]
_EDGE = ["part", "head", "tail", "tail_id"]


def _compared(i, text: str, tree: Tree, after: str, next_tree: Tree) -> tuple:
    new = edited(text, after)
    new_tree = Tree(new)
    spans = new_tree.edits(tree)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return i, len(text), digest, tree.fingerprint, new_tree.fingerprint, tree.likeness(new_tree), tree.likeness(next_tree), spans[0][0] if spans else None


def _result(rows: list[tuple], id_type: pa.DataType) -> list[pa.Array]:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return [pa.array(x, t) for x, t in zip(list(zip(*rows)) if rows else [[]] * len(types), types)]


def _ddl(kind: str) -> str:
    return f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_start.

    The next document is the one that follows by descending doc_id, null ids after
    all others and equal ids by a hash of their text, and after the last the
    first; edit_start is the first byte at which the trees place the edit.

    Spark deals the texts to ranges of that order, each text once. A task compares
    the rows of its range and hands its first and its last text on; the last is
    then met with the first of the next range, so a range costs two texts more
    and nothing is gathered. Ranges are split by the hash too, so that many equal
    or null ids don't meet in one task.
    """
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # id, text and tree of the row that waits for its next one
        head, part, id_type = None, 0, None
        for batch in batches:
            out, id_type = [], batch.column(1).type
            for i, t in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = t.as_py() or ""
                tree = Tree(text)
                if before is None:
                    head, part = text, batch.column(0)[0].as_py()
                else:
                    out.append(_compared(*before, text, tree))
                before = i, text, tree
            if out:
                yield pa.RecordBatch.from_arrays([*_result(out, id_type), *[pa.nulls(len(out), t) for t in (pa.int32(), pa.string(), pa.string(), id_type)]], names=_OUT + _EDGE)
        if before is not None:
            edge = [pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array([before[1]], pa.string()), pa.array([before[0]], id_type)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, x.type) for x in _result([], id_type)], *edge], names=_OUT + _EDGE)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, a.as_py(), Tree(a.as_py()), b.as_py(), Tree(b.as_py())) for i, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(_result([_compared(*x) for x in found], batch.column(0).type), names=_OUT)

    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    with text_batches(docs.sparkSession):
        done = stage(ranged.mapInArrow(lean(run), f"{_ddl(kind)}, part int, head string, tail string, tail_id {kind}"), "merkle-ranges")
    edges = done.filter("part IS NOT NULL")
    # the range that follows, from the numbers of ranges alone: one small row each
    following = edges.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = edges.select(F.col("part").alias("next"), F.col("head").alias("after"))
    ends = edges.select("part", "tail", "tail_id").join(following, "part").join(heads, "next").select("tail_id", "tail", "after").mapInArrow(meet, _ddl(kind))
    return done.filter("part IS NULL").select(*_OUT).unionByName(ends)


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
