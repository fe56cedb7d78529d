"""Byte-level BPE encoding and decoding (operator 2).

The vocabulary is mapped byte by byte to Latin-1 so that pyahocorasick can hold
it. For a piece of text the automaton yields, at every byte, the longest token
that begins there. The encoder walks from left to right, takes the longest token
that may stand after the one before it, and backs up where none may; a place
that failed once is never entered again, so the walk is linear in the piece.
Two tokens may stand side by side if the merges, replayed in order of rank along
the seam, never join them; the answer is memoised per pair.

Empty and null texts have no tokens. Texts are read whole, in slices of pieces,
so the memory beside the ids themselves is bounded. Repeated rows give repeated
results; an empty table gives an empty one; columns other than the id and the
text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.llm.staging import documents
from foilframe.llm.textblocks import give_back

#: About how many bytes the generations of a worker's memories of texts may take, and its memory of seams. A matter of speed only.
MEMO_BYTES = 32 << 20
_ENTRY, _SEAM = 200, 160  # what the interpreter spends on an entry beside its text and ids
_BITS = 31  # more than an id has
SLICE = 200_000
#: The pattern of the byte_bpe vocabularies.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_GAP = re.compile(r"\s (?:\s|\Z)")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and number in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _common_first(ranks: dict[bytes, int]) -> list[tuple[bytes, int]]:
    """Tokens in an order in which of several next bytes the commoner comes first, as the automaton tries them in turn."""
    held = np.zeros(256, dtype=np.int64)
    for t in ranks:
        held += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    place = np.empty(256, dtype=np.uint8)
    place[np.argsort(-held, kind="stable")] = np.arange(256)
    return sorted(ranks.items(), key=lambda x: x[0].translate(place.tobytes()))


class _Memo(dict):
    """Text -> its ids as little-endian 32-bit integers, made on first sight and kept in two generations.

    When the younger one has MEMO_BYTES it becomes the older, which is dropped; what
    is met again moves to the younger. So common texts stay, and both together
    take twice MEMO_BYTES at most.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.room, self.older = make, MEMO_BYTES, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= 48:
            self.room -= _ENTRY + 4 * len(text) + len(found)
            if self.room < 0:
                older = dict(self)
                self.forget()
                self.older = older
            self[text] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.room, self.older = MEMO_BYTES, {}


class Codec:
    """Exact BPE over one rank file; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self.length, self.shorter = [0] * size, [-1] * size  # of each token: its bytes, the longest token that is a proper prefix
        for t, i in ranks.items():
            self.length[i] = len(t)
            self.shorter[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1)
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, i in _common_first(ranks):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.seams: dict[int, bool] = {}  # by both ids in one number
        self.spines: dict[tuple[int, int], list[int]] = {}
        self.pieces = _Memo(self._ids)
        self.spaced = _Memo(self._after_space)
        #: Only for patterns in which a space begins a piece wherever text stands before or after it.
        self.by_space = pattern == SPACE_LED

    def forget(self) -> None:
        """Empties what grew with the texts; what is kept is bounded by the vocabulary."""
        self.pieces.forget(), self.spaced.forget(), self.seams.clear()

    def split(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None for a single byte."""
        if i not in self.splits:
            t = self.token[i]
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                best = min((self.ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best[0] >= i:
                    break
                k = best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.splits[i] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[i]

    def _spine(self, i: int, side: int) -> list[int]:
        """Token i and the tokens at its left (0) or right (1) edge as the merges built them, outermost first."""
        known = self.spines.get((i, side))
        if known is None:
            known = [i]
            while pair := self.split(known[-1]):
                known.append(pair[side])
            self.spines[i, side] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a: no merge ever crosses their seam."""
        known = self.seams.get(a << _BITS | b)
        if known is None:
            if len(self.seams) * _SEAM >= MEMO_BYTES:
                self.seams.clear()
            known = self.seams[a << _BITS | b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        left, right = self._spine(a, 1), self._spine(b, 0)
        ranks, tokens = self.ranks, self.token
        i, j = len(left) - 1, len(right) - 1
        while True:
            joined = ranks.get(tokens[left[i]] + tokens[right[j]])
            # of equal ranks the leftmost pair is merged first
            if joined is not None and (i == 0 or joined < left[i - 1]) and (j == 0 or joined <= right[j - 1]):
                return False
            if i == 0 and j == 0:
                return True
            if i and (j == 0 or left[i - 1] <= right[j - 1]):
                i -= 1
            else:
                j -= 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, seams, shorter = len(piece), self.length, self.seams, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[i] + 1] = i  # later ends are longer
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = seams.get(last << _BITS | token)
                    if fits or fits is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                at -= length[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def _ids(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode("utf-8"))).tobytes()

    def _after_space(self, rest: str) -> bytes:
        """The ids of a space and what stands up to the next; what is one piece isn't remembered as a piece too."""
        found = self.pattern.findall(" " + rest)
        return self._ids(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _slowly(self, text: str) -> bytes:
        if len(text) < 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(found, SLICE)):
            out.append(b"".join(map(self.pieces.__getitem__, part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers.

        Under SPACE_LED a piece begins at every space that has no white space on
        one side at least, so a text without wider gaps is looked up word by word.
        """
        if not self.by_space or _WIDE_GAP.search(text):
            return self._slowly(text)
        first, *rest = text.split(" ")
        return self._slowly(first) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids, as encode gives them, stand for."""
        row = np.frombuffer(ids, dtype="<u4")
        return b"".join(b"".join(map(self.token.__getitem__, row[k : k + SLICE].tolist())) for k in range(0, len(row), SLICE))


_codecs: dict[tuple[str, str], Codec] = {}


@contextmanager
def _codec(data: bytes, pattern: str) -> Iterator[Codec]:
    """The worker's codec for a vocabulary. It stays with the worker, so what its memories take is bounded."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()  # one vocabulary at a time
        _codecs[key] = Codec(read_ranks(data), pattern)
    try:
        yield _codecs[key]
    finally:
        give_back()


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank file, broadcast: about a megabyte, as large as the vocabulary and not as the data."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern


def _per_text(docs: DataFrame, text_col: str, keep: tuple[str, ...], path: str | None, pattern: str | None, columns: str, make: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns keep, and those that make gives for a column of texts (or ids); columns: their names and types."""
    shared, pattern = _vocabulary(docs.sparkSession, path, pattern)
    names = [*keep, *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(shared.value, pattern) as codec:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *make(codec, batch.column(0))], names=names)

    source = docs.select(F.col(text_col).alias("__text"), *keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(run, kept + columns)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: each whole text as token ids. path: rank file; pattern: what splits a text into pieces."""

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        return [pa.array([np.frombuffer(codec.encode(x.as_py() or ""), dtype="<i4") for x in texts], pa.list_(pa.int32()))]

    return _per_text(docs, text_col, (id_col,), path, pattern, "ids array<int>", make)


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns keep, and n_tokens: how many ids each whole text has."""

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        return [pa.array([len(codec.encode(x.as_py() or "")) // 4 for x in texts], pa.int64())]

    return _per_text(docs, text_col, keep, path, pattern, "n_tokens long", make)


def decode_ids(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the bytes that each row's ids stand for; null ids count as none."""

    def make(codec: Codec, ids: pa.Array) -> list[pa.Array]:
        return [pa.array([codec.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in ids], pa.binary())]

    return _per_text(encoded, ids_col, (id_col,), path, None, "decoded binary", make)


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each text, decodes the ids again and returns the digests of both, so that the decoded bytes don't travel.

    The columns keep, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_sha256 (of the bytes the ids decode to) and, if asked for, ids.
    """

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        n, of_ids, of_text, all_ids = [], [], [], []
        for x in texts:
            ids = codec.encode(x.as_py() or "")
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(np.frombuffer(ids, dtype="<i4"))
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), *[pa.array(all_ids, pa.list_(pa.int32()))] * with_ids]

    return _per_text(docs, text_col, keep, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir))
