"""Packing token sequences by shortest-pack-first over the length histogram (operator 12).

A document is its ids and an end id, cut every SIZE tokens; what is left over,
its rest, is shorter than SIZE. Only the histogram of rests reaches the driver,
at most SIZE - 1 numbers whatever the data. Lengths are placed longest first,
each time into the emptiest packs; packs with the same content are one pattern
with a count, so a step places as many rests as the pattern has packs.

The outcome is a list of intervals: the rests of one length whose rank lies in an
interval go to consecutive packs. Ranks are counted where a document is
tokenised, partition by partition, and shifted by the counts of the partitions
before, so no length is gathered in a task. The intervals depend on SIZE alone in
number and are broadcast.

Little padding: a sequence of a power of two needs none. A pack that lacks more
than SLACK of SIZE and isn't a power of two is dissolved: its rests are cut at
the powers of two that add up to them. Placed longest first such pieces fill
sequences without a gap, and the last one is dealt into powers of two as well.

Null texts count as empty: one piece with the end id alone. Repeated rows are rows
like any other. Very long texts are cut where no token can cross before they are
encoded. An empty table gives an empty result. Columns other than id and text
are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foilframe.llm.staging import documents, small, stage, text_batches
from foilframe.llm.textblocks import give_back, slices

SIZE = 4096
#: A pack may lack this part of SIZE before it is dissolved.
SLACK = 1 / 128
END = 2

#: The parts of the word_bpe vocabulary's definition that allow its pieces to be found and merged one by one.
WORD_RULE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "word_end": "</w>",
}
#: Texts of these characters are in normal form, have one lower case, and their letters and digits are those of any library.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u024f]*")
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_LONG = 1 << 20


class Encoder:
    """Texts to ids by a vocabulary file of the tokenizers library; strings of special tokens are plain text.

    Texts of common scripts, under WORD_RULE, are merged by tiktoken, several times
    as fast: a piece is followed by a space, which no piece contains, in place of
    its word end, so that a last byte and its word end are merged before anything
    else. The library itself reads all others.
    """

    def __init__(self, definition: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(definition)
        first, model = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0], parts["model"]
        # a space, or a letter before a plain character that is none: neither a piece nor a composed character crosses there
        self.seam = regex.compile(r"(?= )|(?<=\p{L})(?=[\x00-\x40\x5b-\x60\x7b-\x7f])")
        self.fast = None
        if parts.get("normalizer") == WORD_RULE["normalizer"] and first.get("pattern") == {"Regex": WORD_RULE["pattern"]} and first.get("behavior") == "Removed" and model.get("end_of_word_suffix") == WORD_RULE["word_end"]:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte-level alphabet
            byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
            merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            special = {t["content"] for t in parts["added_tokens"]}
            if all(model["vocab"]["".join(m)] == 512 + k for k, m in enumerate(merged)):  # ids are ranks, and both forms of the bytes come first
                ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in model["vocab"].items() if t not in special}
                self.fast = tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def _ids(self, text: str) -> bytes:
        if not self.fast or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        found = _PLAIN_PIECES.findall(text.lower())
        return self.fast(" ".join(found) + " ", disallowed_special=()).astype("<u4").tobytes() if found else b""

    def __call__(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers; a very long one is cut at seams."""
        if len(text) <= _LONG or not self.fast:
            return self._ids(text)
        out, at = [], 0
        while at < len(text):
            cut = self.seam.search(text, at + _LONG)
            to = cut.start() if cut else len(text)
            out.append(self._ids(text[at:to]))
            at = to
        return b"".join(out)


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The worker's encoder of one vocabulary; it stays with the worker."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def tokenised(docs: DataFrame, path: str | None = None, end: int = END, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A written table with one row for each document: where it stands and the digests of all pieces it may be cut into.

    part, the partition that made the row; doc_tokens; rest, the tokens beyond
    whole sequences; rest_rank and full_before, how many rests of that length and
    whole sequences the partition had before; crcs of the whole sequences, of the
    rest and of its powers of two; ids if asked for.
    """
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file: about 2 MB, whatever the data
    last = np.array([end], dtype="<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("doc_tokens", pa.int64()), ("rest", pa.int32()), ("rest_rank", pa.int64()), ("full_before", pa.int64()), ("full_crc", pa.list_(pa.int64())), ("rest_crc", pa.int64()), ("power_crc", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, full = _encoder(shared.value), {}, 0
        try:
            for whole in batches:
                for batch in slices(whole, 0):
                    out = []
                    for text, part in zip(batch.column(0), batch.column(1).to_pylist()):
                        ids = encode(text.as_py() or "") + last
                        n, view = len(ids) // 4, memoryview(ids)
                        fulls, rest = divmod(n, size)
                        at = 4 * size * fulls
                        crcs = [zlib.crc32(view[k : k + 4 * size]) for k in range(0, at, 4 * size)]
                        tail, cuts = zlib.crc32(view[at:]), []
                        for p in _powers(rest):
                            cuts.append(zlib.crc32(view[at : at + 4 * p]))
                            at += 4 * p
                        rank = seen.get(rest, 0)
                        seen[rest] = rank + 1
                        out.append((part, n, rest, rank, full, crcs, tail, cuts, ids if with_ids else None))
                        full += fulls
                    made = [pa.array(c, t) for c, t in zip(zip(*out), schema.types)]
                    yield pa.RecordBatch.from_arrays([batch.column(2), *made], names=[id_col, *schema.names])
        finally:
            give_back()

    source = docs.select(F.col(text_col).alias("__text"), F.spark_partition_id().alias("__part"), F.col(id_col))
    kind = source.schema[2].dataType.simpleString()
    made = source.mapInArrow(run, f"`{id_col}` {kind}, part int, doc_tokens long, rest int, rest_rank long, full_before long, full_crc array<long>, rest_crc long, power_crc array<long>, ids binary")
    with text_batches(spark):
        return stage(made, "packing-documents")


class Plan:
    """Where the rests of each length go, as intervals of their ranks.

    length, first: an interval begins at rank first; it ends where the next begins.
    pack >= 0: rank r stands in pack + (r - first) // copies, at offset + (r - first) % copies * length.
    pack < 0: the rests are cut at their powers of two; cut holds, for each power, how many pieces of it come before the interval's.
    """

    def __init__(self, counts: dict[int, int], size: int = SIZE, slack: float = SLACK):
        self.size = size
        placed, packs, fills = shortest_pack_first(counts, size)
        self._dissolve(placed, packs, fills, slack)

    def _dissolve(self, placed: list[tuple[int, int, int, int, int, int]], packs: int, fills: list[tuple[int, int, int]], slack: float) -> None:
        size, keeps = self.size, []
        for first, n, fill in sorted(fills):
            keep = size - fill <= slack * size or fill & (fill - 1) == 0
            if keeps and keeps[-1][2] == keep:
                keeps[-1] = (keeps[-1][0], keeps[-1][1] + n, keep)
            else:
                keeps.append((first, n, keep))
        starts, gone, lost = [k[0] for k in keeps], [], 0
        for _, n, keep in keeps:
            gone.append(lost)
            lost += 0 if keep else n
        self.packs = packs - lost
        bits = size.bit_length()
        pieces = np.zeros(bits, dtype=np.int64)  # so far, by power
        rows, cuts = [], []
        for length, rank, n, pack, copies, offset in sorted(placed):
            k, end = bisect_right(starts, pack) - 1, pack + -(-n // copies)
            while pack < end:
                stop = min(end, keeps[k][0] + keeps[k][1])
                here = min(n, (stop - pack) * copies)
                kept = keeps[k][2]
                rows.append((length, rank, pack - gone[k] if kept else -1, copies, offset))
                cuts.append(pieces.copy())
                if not kept:
                    for p in _powers(length):
                        pieces[p.bit_length() - 1] += here
                rank, n, pack, k = rank + here, n - here, stop, k + 1
        self.length, self.first, self.pack, self.copies, self.offset = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [()] * 5))
        self.cut = np.array(cuts, dtype=np.int64).reshape(-1, bits)
        self.pieces = pieces
        self.key = (self.length << 44) + self.first
        # where the pieces of each power begin on the line of all of them, largest first
        weights = pieces * (1 << np.arange(bits))
        self.line = np.array([weights[k + 1 :].sum() for k in range(bits)], dtype=np.int64)
        self.total = int(weights.sum())
        rest = self.total % size
        #: The last, unfilled part of the line is dealt into powers of two.
        self.ends = np.cumsum(_powers(rest)) if rest else np.zeros(0, np.int64)

    @property
    def sequences(self) -> int:
        return self.packs + self.total // self.size + len(self.ends)

    def interval(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, side="right") - 1

    def on_line(self, power: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence, counted after the packs, and offset of pieces of 2 ** power tokens."""
        at = self.line[power] + (rank << power)
        sequence, offset = at // self.size, at % self.size
        if len(self.ends):
            last = sequence == self.total // self.size
            k = np.searchsorted(self.ends, offset[last], side="right")
            sequence[last] += k
            offset[last] -= np.concatenate([[0], self.ends])[k]
        return sequence + self.packs, offset


def shortest_pack_first(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, list[tuple[int, int, int]]]:
    """Lengths placed longest first into the emptiest packs.

    Returns placements (length, first rank, how many, first pack, copies in a
    pack, offset of the first copy), the number of packs, and the patterns
    (first pack, packs, tokens).
    """
    placed, packs, heap = [], 0, []  # heap: (tokens, first pack, packs)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left and heap and heap[0][0] + length <= size:
            fill, first, n = heapq.heappop(heap)
            if left < n:
                heapq.heappush(heap, (fill, first + left, n - left))
                n, copies = left, 1
            else:
                level = heap[0][0] if heap else size
                copies = max(1, min((size - fill) // length, -(-(level - fill) // length), left // n))
            placed.append((length, rank, n * copies, first, copies, fill))
            heapq.heappush(heap, (fill + copies * length, first, n))
            rank, left = rank + n * copies, left - n * copies
        if left:  # no pack has room
            copies = size // length
            for n, each in ((left // copies, copies), (1, left % copies)):
                if n and each:
                    placed.append((length, rank, n * each, packs, each, 0))
                    heapq.heappush(heap, (each * length, packs, n))
                    rank, packs = rank + n * each, packs + n
    return placed, packs, [(first, n, fill) for fill, first, n in heap]


def pack(docs: DataFrame, path: str | None = None, end: int = END, size: int = SIZE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    size: tokens of a sequence, a power of two.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    rows = tokenised(docs, path, end, size, id_col, text_col, with_ids)
    # a row for each partition and length; whole sequences are the length size
    counts = rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("doc_tokens") / size)).alias("full"))
    counts = stage(counts, "packing-counts")
    both = counts.select("part", "rest", "n").unionByName(counts.groupBy("part").agg(F.sum("full").alias("n")).withColumn("rest", F.lit(size)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    shift = stage(both.withColumn("before", before), "packing-shift")
    found = {r["rest"]: r["n"] for r in both.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most size + 1 rows
    fulls = found.pop(size, 0)
    found.pop(0, None)
    plan = spark.sparkContext.broadcast(Plan(found, size, slack))  # as many intervals as size allows, whatever the data
    wide = rows.join(small(shift.select("part", "rest", F.col("before").alias("rest_before"))), ["part", "rest"]).join(small(shift.filter(F.col("rest") == size).select("part", F.col("before").alias("fulls_before"))), "part")
    wide = wide.select(id_col, "doc_tokens", "rest", (F.col("rest_rank") + F.col("rest_before")).alias("rank"), (F.col("full_before") + F.col("fulls_before")).alias("full_rank"), "full_crc", "rest_crc", "power_crc", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pieces(batch, plan.value, fulls, id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    made = wide.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
    return made if with_ids else made.drop("ids")


def _values(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _flat(column: pa.Array) -> np.ndarray:
    return _values(column.flatten())


def _pieces(batch: pa.RecordBatch, plan: Plan, fulls: int, id_col: str) -> pa.RecordBatch:
    """The pieces of a batch of documents, whole sequences first; sequences are numbered: whole ones, packs, lines of powers."""
    size = plan.size
    tokens, rest, rank, full_rank = (_values(batch.column(c)) for c in ("doc_tokens", "rest", "rank", "full_rank"))
    rest = rest.astype(np.int64)
    at = np.arange(len(tokens))
    whole = tokens // size
    out = []  # row, start, length, crc, sequence, offset
    row = np.repeat(at, whole)
    k = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    out.append((row, k * size, np.full(len(row), size), _flat(batch.column("full_crc")), full_rank[row] + k, np.zeros(len(row), np.int64)))
    if len(plan.key):
        where = plan.interval(rest, rank)
        kept = (rest > 0) & (plan.pack[where] >= 0)
        row, w = at[kept], where[kept]
        by = rank[row] - plan.first[w]
        out.append((row, whole[row] * size, rest[row], _values(batch.column("rest_crc"))[row], fulls + plan.pack[w] + by // plan.copies[w], plan.offset[w] + by % plan.copies[w] * rest[row]))
        bits = plan.cut.shape[1] - 1
        has = (rest[:, None] >> np.arange(bits)[::-1]) & 1 == 1  # by power, largest first
        row, power = np.nonzero(has)
        power = bits - 1 - power
        gone = ~kept[row]
        crc, row, power = _flat(batch.column("power_crc"))[gone], row[gone], power[gone]
        w = where[row]
        sequence, offset = plan.on_line(power, plan.cut[w, power] + rank[row] - plan.first[w])
        start = whole[row] * size + ((rest[row] >> (power + 1)) << (power + 1))
        out.append((row, start, np.left_shift(1, power), crc, fulls + sequence, offset))
    row, start, length, crc, sequence, offset = (np.concatenate(c).astype(np.int64) for c in zip(*out))
    ids = None
    if batch.column("ids").null_count < len(batch):
        texts = batch.column("ids")
        ids = [np.frombuffer(texts[int(r)].as_py(), "<i4")[s : s + n] for r, s, n in zip(row, start, length)]
    columns = [batch.column(id_col).take(pa.array(row)), *[pa.array(c) for c in (start, length, crc, tokens[row], sequence, offset)], pa.array(ids, pa.list_(pa.int32())) if ids is not None else pa.nulls(len(row), pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids, unpadded, of pieces that were packed with their ids; a group has no more tokens than a sequence."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
