"""Tokens, pseudonyms, fingerprints, language model: against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foilframe.llm import bpe, hmm, merkle, pseudonyms, textblocks

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", None, "  \n\t ", "Hello world, it's  me.\n\nSecond    line", "a" * 3000, "日本語 テキスト 😀😀 naïve ½ ²", "x y z \x1c q", "one two three four five six " * 400]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    return bpe.Codec(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def peer(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab  \n\t's1=-é", max_size=200)))
def test_bpe_equals_the_library(codec, peer, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == peer.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_long_and_foreign(codec, peer):
    for text in [t for t in TEXTS if t] + ["ab" * 5000, " " * 700 + "x", "x" + " " * 700]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == peer.encode_ordinary(text)


def test_bpe_frames(spark, peer):
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(0, "", "clash", 0), (None, "x", None, None)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.round_trip_digests(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            ids = np.array(peer.encode_ordinary(TEXTS[r.doc_id] or ""), "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    encoded = bpe.encode_documents(df.limit(8))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(encoded).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS))
    assert bpe.round_trip_digests(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b", max_size=60)), max_size=8), st.integers(4, 64))
def test_word_hashes_in_blocks(texts, size):
    hashes, counts = textblocks.hash_words(pa.array(texts, pa.string()), size)
    whole, _ = textblocks.hash_words(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts] and hashes.tolist() == whole.tolist()
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_shingle_sets():
    texts = TEXTS + ["a b c", "A  b\nc", "c b a", "a b c d e f a b c d e"]
    flat, sizes = textblocks.shingle_sets(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    sets = [set(flat[e - n : e].tolist()) for e, n in zip(ends, sizes)]
    plain = [({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for w in map(words, texts)]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"k")
    for n in (1, 2, 7, 10, 1000):
        image = [f.permute(v, n, b"t") for v in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute(v, n, b"t", invert=True) for v in image] == list(range(n))
    assert [f.permute(v, 1000, b"t") for v in range(9)] != [f.permute(v, 1000, b"u") for v in range(9)]


SAMPLE = 'call +1 (743) 555-3824 or 743-555-3824, card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; ip 70.23.22.57, no 300.1.1.1; ssn 123-45-6789, no 000-12-3456; on 2024-02-29 and 29.02.2024, never 2023-02-29; ñand.34@mail7.example.com; token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"; DE89 3704 0044 0532 0130 00; 5/13/2020, 13/5/2020 and 4.0 in 1999'


def test_pseudonyms_keep_formats_and_invert():
    f = pseudonyms.Feistel(b"key")
    out, found = pseudonyms.pseudonymise(SAMPLE, f)
    kinds = Counter(v["kind"] for v in found)
    assert kinds == {"phone": 2, "card": 2, "ipv4": 1, "ssn": 1, "date": 4, "mail": 1, "secret": 1, "iban": 1}
    assert all(x in out for x in ("4111111111111112", "300.1.1.1", "000-12-3456", "2023-02-29", "4.0 in 1999", "@mail7.example.com"))
    assert "f33e61083db5" not in out and "70.23.22.57" not in out
    cards = [re.sub(r"\D", "", v["value"]) for v in found if v["kind"] == "card"]
    assert cards[0] == cards[1] and pseudonyms.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert pseudonyms.pseudonymise(out, f, invert=True)[0] == SAMPLE
    assert pseudonyms.pseudonymise(SAMPLE, pseudonyms.Feistel(b"other"))[0] != out
    assert pseudonyms.pseudonymise("clean text of 12 words", f) == ("clean text of 12 words", [])


def test_pseudonym_frames(spark):
    df = spark.createDataFrame([(1, SAMPLE, "c"), (2, None, None), (3, "", "c"), (1, SAMPLE, "c")], "doc_id long, text string, found string")
    rows = pseudonyms.pseudonymised(df, b"key").collect()
    assert len({r.text for r in rows if r.doc_id == 1}) == 1 and {r.text for r in rows if r.doc_id != 1} == {""}
    assert pseudonyms.pseudonymised(df.limit(0), b"key").count() == 0


def test_merkle_tree():
    long = "\n".join(f"line {k} has some words of its own here" for k in range(300))
    a, b = merkle.Tree(long), merkle.Tree(long.replace("line 150 has", "line 150 had"))
    assert a.fingerprint == merkle.Tree(long).fingerprint != b.fingerprint
    spans = b.edits(a)
    assert len(spans) == 1 and "line 150 had" in long.replace("line 150 has", "line 150 had")[spans[0][0] - 20 : spans[0][1] + 20]
    assert 0.97 < a.likeness(b) < 1 == a.likeness(a) and merkle.Tree("").likeness(merkle.Tree("")) == 1 and a.likeness(merkle.Tree("")) == 0
    assert b"".join(long.encode()[s:e] for _, s, e in a.leaves) == long.encode()
    assert len(merkle.Tree("a" * 100000).leaves) < 10


def test_next_documents(spark):
    texts = {7: "abcdef", 3: None, 5: "ünïcödé text", 1: "zz", 9: "last one " * 50}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fingerprint string")
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in merkle.compare_with_next(df).collect()}
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_next <= 1 and got[i].edited_fingerprint == merkle.Tree(new).fingerprint
    assert merkle.compare_with_next(df.limit(0)).count() == 0
    pair = spark.createDataFrame([("a b c\nd e f\n", "a b c\nd x f\n"), (None, None)], "old_text string, new_text string")
    assert [len(r.edits) for r in merkle.locate_edits(pair).collect()] == [1, 0]


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(0)
    model = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2))
    seqs = [np.array(s) for s in ([0], [1, 2, 0], [2, 2, 1, 0, 1])]

    def brute(x):
        total = 0.0
        for path in np.ndindex(*([2] * len(x))):
            p = model.start[path[0]] * model.emit[path[0], x[0]]
            for t in range(1, len(x)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], x[t]]
            total += p
        return math.log10(total)

    assert np.allclose(model.log10_classes(seqs), [brute(s) for s in seqs])
    start, move, emit, log = model.counts(*hmm._filled(seqs), np.array([True] * 3))
    assert abs(start.sum() - 3) < 1e-9 and abs(move.sum() - 6) < 1e-9 and abs(emit.sum() - 9) < 1e-9
    assert abs(log / math.log(10) - sum(map(brute, seqs))) < 1e-9


def test_language_model_counts(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The dog sat", None, "", "xyz the", "the the the cat"] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", hmm.F.lit("clash"))
    got = {r.doc_id: r for r in hmm.score(df, states=2, rounds=2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        tokens = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(w in c for w in tokens), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-9 and r.score < 0
    assert hmm.score(df.limit(0)).count() == 0


def test_ranks_file():
    assert bpe.read_ranks(base64.b64encode(b"ab") + b" 3\n") == {b"ab": 3}
