"""Aligning the tokens of two vocabularies over whole texts (operator 11).

A text with a space before it is encoded by A, a byte-level vocabulary, and by B,
a vocabulary of pieces. Byte offsets where tokens of both end cut the tokens into
groups; every A token of a group is linked with every B token of it.

A stretch of bytes yields a fragment: an open head up to the first common end, the
closed groups after it, and an open tail after the last one. Fragments of
adjacent stretches compose: where tail and head meet, common ends are looked for
again, so composing is associative and the stretches may be cut for A and for B
at different places, each where no token of that vocabulary can cross. A text of
at most PART characters is one stretch. A longer one is dealt out in parts over
Spark tasks, and its fragments are composed FAN at a time in a tree.

How many documents hold a pair of ids linked is counted task by task before
anything is shuffled. The FREQUENT most frequent pairs (a bound, whatever the
data) are sent back to the documents; the others are joined, and as each of them
is in few documents, no key of that join is large.

Null and empty texts have no tokens, nor have those that a vocabulary doesn't give
back byte for byte, such as texts with U+2581. Repeated rows count as documents
of their own. An empty table gives an empty result. Columns other than id and
text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.llm.staging import documents, small, stage, text_batches
from foilframe.llm.textblocks import give_back, slices

#: Characters above which a text is dealt out in parts, and about how many a part has.
PART = 1 << 15
#: Fragments that one task composes at a time.
FAN = 8
#: Pairs of ids whose counts are broadcast: at most 13 MB.
FREQUENT = 1 << 20
#: Linked ids of which the different ones are kept at a time while documents are counted.
COUNTED = 1 << 21
#: Files of the tables of pairs, whose rows are bounded by the sizes of the vocabularies.
FILES = 48

#: Places where no token of A crosses, and the pattern that splits text before its merges.
_A_SEAM = r"(?<=\p{L})(?=[^\p{L}\p{M}])|(?<=\p{N})(?=[^\p{N}\p{M}])|(?<=[^\s\x1c-\x1f])(?=[ \n])"
_A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.zeros(0, dtype=np.int64)


@dataclass(eq=False)
class Stretch:
    """Tokens of A and of B by id, and the byte of the text at which each ends."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Stretch) -> Stretch:
        return Stretch(*(np.concatenate(x) for x in zip(self.arrays(), other.arrays())))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A, and of B, there are up to and with each common end."""
        at = np.searchsorted(self.a_ends, self.b_ends)
        met = np.flatnonzero(self.a_ends[np.minimum(at, len(self.a_ends) - 1)] == self.b_ends) if len(self.a_ends) and len(self.b_ends) else _NONE
        return at[met] + 1, met + 1

    def part(self, a: int, a_to: int, b: int, b_to: int) -> Stretch:
        return Stretch(self.a[a:a_to], self.a_ends[a:a_to], self.b[b:b_to], self.b_ends[b:b_to])


EMPTY = Stretch(_NONE, _NONE, _NONE, _NONE)


@dataclass(eq=False)
class Closed:
    """Groups in order: their text, the code of each link, and how many tokens of A they have."""

    text: bytes = b""
    codes: bytes = b""
    n_a: int = 0

    def __add__(self, other: Closed) -> Closed:
        return Closed(self.text + b";" + other.text if self.text and other.text else self.text or other.text, self.codes + other.codes, self.n_a + other.n_a)


@dataclass(eq=False)
class Fragment:
    """What a stretch of bytes yields. closed is None where it has no common end; then all its tokens are in head."""

    head: Stretch
    closed: Closed | None
    tail: Stretch


def _names(most: int, sign: str) -> np.ndarray:
    """Every id as decimal text followed by a sign, padded with zero bytes."""
    return np.array([f"{i}{sign}" for i in range(most)], dtype="S")


class Pair:
    """Two vocabularies. The libraries are loaded where texts are first encoded; composing needs none of them."""

    def __init__(self, a_definition: str, b_model: bytes):
        import regex
        from sentencepiece import sentencepiece_model_pb2

        self.a_definition, self.parts_of_a = a_definition, json.loads(a_definition)
        vocabulary = self.parts_of_a["model"]["vocab"]
        most = max(vocabulary.values()) + 1
        self.a_length = np.zeros(most, dtype=np.int64)
        for t, i in vocabulary.items():
            self.a_length[i] = len(t)
        self.model = sentencepiece_model_pb2.ModelProto()
        self.model.ParseFromString(b_model)
        self.model.normalizer_spec.add_dummy_prefix = False  # texts come with their space
        pieces = self.model.pieces
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in pieces]
        self.b_length = np.array(list(map(len, self.b_bytes)))
        #: Adjacent characters within a piece: B may be cut between any others.
        self.joined = {p.piece[k : k + 2] for p in pieces if p.type != p.BYTE for k in range(len(p.piece) - 1)}
        self.width = len(pieces)
        #: Codes are an A id times B's size plus a B id.
        self.kind = "<u4" if most * self.width < 1 << 32 else "<u8"
        self.a_seam = regex.compile(_A_SEAM)
        self.a_names, self.b_names = [_names(most, c) for c in ",|"], [_names(self.width, c) for c in ",;"]
        self.name_type = max((x.dtype for x in (*self.a_names, *self.b_names)), key=lambda t: t.itemsize)

    @cached_property
    def fast(self):
        """tiktoken over A where its ids are ranks, which gives the same merges sooner; else None."""
        import tiktoken

        parts = self.parts_of_a
        vocabulary = parts["model"]["vocab"]
        merged = (m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"])
        if parts["pre_tokenizer"]["type"] != "ByteLevel" or parts["normalizer"] or not all(vocabulary["".join(m)] == 256 + k for k, m in enumerate(merged)):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte-level alphabet
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if set(t) <= byte_of.keys()}
        self.parts_of_a = None
        return tiktoken.Encoding("own", pat_str=_A_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.a_definition)
        found.encode_special_tokens = True
        return found

    @cached_property
    def b_ids(self):
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_proto=self.model.SerializeToString())
        self.model = None
        return found.encode

    def a_ids(self, text: str) -> np.ndarray:
        if len(text) <= 8 * PART and self.fast:  # its pattern overflows on endless runs
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def tokens(self, a_text: str, a_at: int, b_text: str, b_at: int, b_ids: list[int] | None = None) -> Stretch | None:
        """The tokens of a stretch that A has from byte a_at on, B from b_at on; None if a vocabulary doesn't give the text back."""
        a, b = self.a_ids(a_text) if a_text else _NONE, b_ids if b_ids is not None else self.b_ids(b_text)
        raw = b_text.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        b = np.array(b, dtype=np.int64)
        a_ends, b_ends = a_at + np.cumsum(self.a_length[a]), b_at + np.cumsum(self.b_length[b])
        if (a_ends[-1] if len(a) else a_at) != a_at + (len(raw) if a_text == b_text else len(a_text.encode())):
            return None
        return Stretch(a, a_ends, b, b_ends)

    def closed(self, s: Stretch, a_to: np.ndarray, b_to: np.ndarray) -> Closed:
        """The groups of a stretch whose tokens all are in one; a_to, b_to: how many tokens there are up to the end of each."""
        if not len(a_to):
            return Closed()
        n_a, n_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        of_a, of_b = np.repeat(np.arange(len(a_to)), n_a), np.repeat(np.arange(len(b_to)), n_b)
        fan = n_b[of_a]  # an A token has a link with each B token of its group
        first = np.cumsum(fan) - fan
        b_at = np.arange(int(fan.sum())) - np.repeat(first - (b_to - n_b)[of_a], fan)
        codes = (np.repeat(s.a * self.width, fan) + s.b[b_at]).astype(self.kind)
        a_last, b_last = np.zeros(len(s.a), np.int8), np.zeros(len(s.b), np.int8)
        a_last[a_to - 1], b_last[b_to - 1] = 1, 1
        text = np.empty(len(s.a) + len(s.b), dtype=self.name_type)
        text[np.arange(len(s.a)) + (b_to - n_b)[of_a]] = np.where(a_last, self.a_names[1][s.a], self.a_names[0][s.a])
        text[np.arange(len(s.b)) + a_to[of_b]] = np.where(b_last, self.b_names[1][s.b], self.b_names[0][s.b])
        return Closed(text.tobytes().translate(None, b"\0")[:-1], codes.tobytes(), len(s.a))

    def fragment(self, s: Stretch) -> Fragment:
        a_to, b_to = s.common()
        if not len(a_to):
            return Fragment(s, None, EMPTY)
        i, j, k, m = int(a_to[0]), int(b_to[0]), int(a_to[-1]), int(b_to[-1])
        return Fragment(s.part(0, i, 0, j), self.closed(s.part(i, k, j, m), a_to[1:] - i, b_to[1:] - j), s.part(k, len(s.a), m, len(s.b)))

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        """The fragment of two adjacent stretches."""
        seam = self.fragment((left.head if left.closed is None else left.tail) + right.head)
        if left.closed is None:
            if right.closed is None or seam.closed is None:
                return seam if right.closed is None else Fragment(seam.head, right.closed, right.tail)
            return Fragment(seam.head, seam.closed + right.closed, right.tail)
        closed = left.closed if seam.closed is None else left.closed + self.group(seam.head) + seam.closed
        if right.closed is None:
            return Fragment(left.head, closed, seam.head if seam.closed is None else seam.tail)
        return Fragment(left.head, closed + right.closed, right.tail)

    def group(self, s: Stretch) -> Closed:
        """A stretch that is one group."""
        return self.closed(s, np.array([len(s.a)]), np.array([len(s.b)]))

    def ended(self, fragment: Fragment) -> Closed | None:
        """The groups of a whole text; None if the vocabularies don't end together."""
        if fragment.closed is None or len(fragment.tail.a) or len(fragment.tail.b):
            return None
        return self.group(fragment.head) + fragment.closed

    def texts(self, texts: list[str | None]) -> Iterator[Closed | None]:
        """The groups of whole texts, each with a space before it; None for those that have no tokens."""
        spaced = [" " + t if t else "" for t in texts]
        for t, ids in zip(spaced, self.b_ids(spaced, num_threads=1)):
            stretch = self.tokens(t, 0, t, 0, ids) if t else None
            yield stretch and self.ended(self.fragment(stretch))

    def parts(self, text: str, size: int) -> Iterator[tuple[str, int, str, int]]:
        """A text in parts for tokens(), each about size characters on; each vocabulary is cut at the next place where it may be."""
        n, a, b, a_at, b_at = len(text), 0, 0, 0, 0
        while a < n or b < n:
            goal = max(a, b) + size
            seam = self.a_seam.search(text, goal) if goal < n else None
            a_to, b_to = seam.start() if seam else n, min(goal, n)
            while b_to < n and text[b_to - 1 : b_to + 1].replace(" ", "▁") in self.joined:
                b_to += 1
            yield text[a:a_to], a_at, text[b:b_to], b_at
            a_at, b_at, a, b = a_at + len(text[a:a_to].encode()), b_at + len(text[b:b_to].encode()), a_to, b_to


_pairs: dict[bytes, Pair] = {}


def _pair(shared) -> Pair:
    """The worker's vocabularies; they stay with it."""
    a, b = shared.value
    key = hashlib.sha256(a.encode() + b).digest()
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(a, b)
    return _pairs[key]


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _row(closed: Closed | None, kind: str) -> tuple:
    """What is kept of a document: counts, the digest of its groups, its different links and how often each occurs."""
    if closed is None:
        return 0, 0, 0, 0, "", b"", b""
    groups = closed.text.count(b";") + 1
    codes, times = np.unique(np.frombuffer(closed.codes, kind), return_counts=True)
    n = int(times.sum())
    return closed.n_a, closed.text.count(b",") + 2 * groups - closed.n_a, groups, n, hashlib.sha256(closed.text).hexdigest(), codes.tobytes(), times.astype("<u2" if n < 1 << 16 else "<u4").tobytes()


def _times(row: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row, "<u2" if len(row) == 2 * n else "<u4")


def _batch(columns: list[pa.Array], rows: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[id_col, *names])


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> tuple[DataFrame, int, str]:
    """A written table of documents with their counts, digest and links; B's size and the type of codes."""
    spark = docs.sparkSession
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()
    shared = spark.sparkContext.broadcast(files)  # two vocabulary files: about 2 MB, whatever the data
    here = Pair(*files)
    width, code = here.width, here.kind
    source = docs.select(F.col(text_col).alias("__text"), F.col(id_col))
    kind = source.schema[1].dataType.simpleString()
    is_long = F.length("__text") > part

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        try:
            for whole in batches:
                for batch in slices(whole, 0):
                    yield _batch([batch.column(1)], [_row(c, pair.kind) for c in pair.texts(batch.column(0).to_pylist())], id_col)
        finally:
            give_back()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = _pair(shared), 0
        for whole in batches:
            for batch in slices(whole, 0):
                for k in range(len(batch)):
                    for at, (a_text, a_at, b_text, b_at) in enumerate(pair.parts(" " + batch.column(0)[k].as_py(), part)):
                        columns = [pa.array([batch.column(2)[k].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([a_text]), pa.array([a_at], pa.int64()), pa.array([b_text]), pa.array([b_at], pa.int64())]
                        yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), *columns], names=[id_col, "__task", "__row", "__at", "a_text", "a_at", "b_text", "b_at"])
                    n += 1

    with text_batches(spark):
        few = source.filter(~F.coalesce(is_long, F.lit(False))).mapInArrow(short, f"`{id_col}` {kind}, {_COUNTS}")
        pieces = source.filter(is_long).withColumn("__task", F.spark_partition_id()).mapInArrow(dealt, f"`{id_col}` {kind}, __task int, __row long, __at long, a_text string, a_at long, b_text string, b_at long")
        pieces = stage(pieces, "alignment-parts")
        return stage(few.unionByName(_composed(pieces, shared, id_col, kind)), "alignment-documents"), width, code


_PLACE = ["__task", "__row", "__at"]
_ENDS = [f"{side}_{k}" for side in ("head", "tail") for k in ("a", "a_ends", "b", "b_ends")]
_FRAGMENT = "ok boolean, text binary, codes binary, n_a long, " + ", ".join(f"{c} array<long>" for c in _ENDS)
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * len(_ENDS)]


def _packed(f: Fragment | None) -> tuple:
    """A fragment as columns; None is a stretch that B doesn't give back."""
    if f is None:
        return False, None, None, None, *[[]] * len(_ENDS)
    c = f.closed
    return True, *((None, None, None) if c is None else (c.text, c.codes, c.n_a)), *f.head.arrays(), *f.tail.arrays()


def _unpacked(r: dict) -> Fragment | None:
    if not r["ok"]:
        return None
    ends = [np.array(r[c], dtype=np.int64) for c in _ENDS]
    return Fragment(Stretch(*ends[:4]), None if r["text"] is None else Closed(r["text"], r["codes"], r["n_a"]), Stretch(*ends[4:]))


def _composed(pieces: DataFrame, shared, id_col: str, kind: str) -> DataFrame:
    """Fragments of the parts, wherever Spark deals them, composed in a tree; a task holds FAN of them and, in the end, a document's groups."""
    schema = f"`{id_col}` {kind}, __task int, __row long, __at long, {_FRAGMENT}"
    names = [id_col, *_PLACE, *[c.split()[0] for c in _FRAGMENT.split(", ")]]

    def row(key: pa.Array, place: tuple, f: Fragment | None) -> list[pa.Array]:
        return [key, *[pa.array([v], k) for v, k in zip((*place, *_packed(f)), _KINDS)]]

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for batch in batches:
            for k, r in enumerate(batch.select([*_PLACE, "a_text", "a_at", "b_text", "b_at"]).to_pylist()):
                stretch = pair.tokens(r["a_text"], r["a_at"], r["b_text"], r["b_at"])
                yield pa.RecordBatch.from_arrays(row(batch.column(0).slice(k, 1), tuple(r[c] for c in _PLACE), stretch and pair.fragment(stretch)), names=names)
        give_back()

    def joined(rows: pa.Table) -> pa.Table:
        pair, rows = _pair(shared), rows.sort_by("__at").combine_chunks()
        found = rows.select(names[1:]).to_pylist()
        out = _unpacked(found[0])
        for r in found[1:]:
            f = _unpacked(r)
            out = out and f and pair.compose(out, f)
        first = found[0]
        return pa.Table.from_arrays(row(rows.column(0).slice(0, 1).combine_chunks(), (first["__task"], first["__row"], first["__at"] // FAN), out), names=names)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for batch in batches:
            for k, r in enumerate(batch.select(names[4:]).to_pylist()):
                f = _unpacked(r)
                yield _batch([batch.column(0).slice(k, 1)], [_row(f and pair.ended(f), pair.kind)], id_col)
        give_back()

    now = pieces.repartition(*_PLACE).mapInArrow(fragments, schema)
    last = pieces.agg(F.max("__at")).first()[0] or 0
    while last:
        now = now.groupBy("__task", "__row", F.floor(F.col("__at") / FAN)).applyInArrow(joined, schema)
        last //= FAN
    return now.mapInArrow(ended, f"`{id_col}` {kind}, {_COUNTS}")


def pair_counts(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """a, b, code, n (documents that hold the pair linked) and best (no pair of that A id is in more), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(times.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), kind))
                n += len(held[-1])
                if n >= COUNTED:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()
        held.clear()
        give_back()

    summed = rows.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = stage(summed.coalesce(FILES), "alignment-counts")
    a = F.floor(F.col("code") / F.lit(width))
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    met = counts.withColumn("a", a).join(small(best), "a")  # a row for each id of A
    return stage(met.select("a", (F.col("code") - F.col("a") * width).alias("b"), "code", "n", (F.col("n") == F.col("most")).alias("best")).coalesce(FILES), "alignment-pairs")


def _split(pairs: DataFrame, most: int) -> tuple[int, int]:
    """The count from which pairs are among the most frequent, of which there are at most so many, and how many are below it."""
    bucket = F.floor(F.log2("n") * 16).cast("int")  # at most a few hundred rows, whatever the counts
    rows = sorted(((r["k"], r["least"], r["rows"]) for r in pairs.groupBy(bucket.alias("k")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    taken, least = 0, 1 << 62
    for k, (_, low, n) in enumerate(rows):
        if taken + n > most:
            return least, sum(r[2] for r in rows[k:])
        taken, least = taken + n, low
    return least, 0


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", part: int = PART, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (a, b, code, n, best)."""
    spark = docs.sparkSession
    rows, width, kind = aligned(docs, a_path, b_path, id_col, text_col, part)
    pairs = pair_counts(rows, width, kind)
    least, others = _split(pairs, frequent)
    few = pairs.filter(F.col("n") >= least).select("code", "n", "best").orderBy("code").toArrow()  # at most `frequent` rows
    table = spark.sparkContext.broadcast((few["code"].to_numpy().astype(kind), few["n"].to_numpy(), few["best"].to_numpy().astype(bool)))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, is_best = table.value
        k = 0
        for batch in batches:
            part_of = batch.column(1)
            best, total, left_codes, left_times, keys = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                codes = np.frombuffer(x.as_buffer(), kind)
                times = _times(y.as_buffer().to_pybytes(), len(codes)).astype(np.int64)
                at = np.searchsorted(known, codes)
                at[at == len(known)] = 0
                found = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                where, n = at[found], times[found]
                best.append(int(n[is_best[where]].sum()))
                total.append(int((n * count[where]).sum()))
                left_codes.append(codes[~found].astype(np.int64))
                left_times.append(times[~found])
                keys.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), part_of, pa.array(keys, pa.int64()), *batch.columns[4:], pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(left_codes, pa.list_(pa.int64())), pa.array(left_times, pa.list_(pa.int64()))], names=[id_col, "__task", "__row", *names, "n_best", "count_sum", "codes", "times"])
        give_back()

    id_kind = docs.schema[id_col].dataType.simpleString()
    source = rows.select(id_col, F.spark_partition_id().alias("__task"), "codes", "times", *names)
    made = source.mapInArrow(run, f"`{id_col}` {id_kind}, __task int, __row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, codes array<long>, times array<long>")
    columns = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not others:
        return made.select(*columns), pairs
    made = stage(made, "alignment-links")
    left = made.filter(F.size("codes") > 0).select("__task", "__row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("__task", "__row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    met = left.join(pairs.filter(F.col("n") < least).select("code", "n", "best"), "code")  # a code has fewer than `least` rows
    sums = met.groupBy("__task", "__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    whole = made.drop("codes", "times").join(sums, ["__task", "__row"], "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).select(*columns), pairs


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(documents(spark, sf_dir))[0]
