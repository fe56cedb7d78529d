"""Packing against the tokenizers library and the contract's rules, on texts and on the histogram alone."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foilframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encode():
    return packing.Encoder(open(PATH, encoding="utf-8").read())


def checked(rows, expected, size):
    """rows: pieces; expected: Counter of whole id sequences by id. Every rule of the contract."""
    spans, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        fill[r.sequence_id].append((r.offset, r.length))
    for got in fill.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at and length > 0
            at += length
        assert at <= size
    want = defaultdict(Counter)
    for (doc_id, ids), n in expected.items():
        want[doc_id, len(ids)][ids] += n
    assert set(spans) == set(want)
    for key, texts in want.items():
        got, all_ids = Counter(spans[key]), list(texts.elements())
        assert sum(n for _, n, _ in spans[key]) == key[1] * len(all_ids)
        possible = {(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for ids in texts for s, n, _ in got}
        assert set(got) <= possible
    assert sorted(fill) == list(range(len(fill)))
    lengths = [sum(n for _, n in got) for got in fill.values()]
    return sum(size - n for n in lengths if n & (n - 1)), sum(lengths)


WORDS = ["a", "É", "Straße's", "it's", "x" * 70, "１２", "42nd", "--", "<|endoftext|>", "日本語", "é", "́", "ﬁ", "Σ", "ΟΔΟΣ", "İ", "ŉ", "\n", "\t.", " b", "\x1cq", "", "don'T", "'", "ªº²", "“so”…", "ЁЖик", "漢字と", "한글", "½", "ǅ", "a_b"]


def test_encoder_equals_library(plain, encode):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(WORDS) | st.text(max_size=6), max_size=12).map(" ".join))
    def same(text):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text)

    same()


def test_each_token_is_what_its_own_text_gives(plain, encode):
    vocabulary = Tokenizer.from_file(PATH).get_vocab()
    assert encode.fast
    for text, i in list(vocabulary.items())[::7]:
        if text.endswith("</w>") and text[:-4].isascii() and text[:-4].isalnum():
            assert np.frombuffer(encode(text[:-4]), "<u4").tolist() == plain(text[:-4])


def test_long_words_are_cut_at_seams(plain, encode, monkeypatch):
    monkeypatch.setattr(packing, "_LONG", 10)
    for word in ("ab1,c'té" * 40, "x" * 300, "éf" * 50, "a-b_" * 60):
        assert np.frombuffer(encode(word), "<u4").tolist() == plain(word)


@pytest.mark.parametrize("size", [16, 64])
def test_pieces_follow_the_rules(spark, plain, size):
    texts = [None, "", "one", "one", "two words here", "w " * 500, "w " * 37, "w " * 37, "Ünï code, 12 <|endoftext|>"] + ["k " * (k % 61) for k in range(300)] + ["same length of nine tokens as it is"] * 150
    rows = [(k if k % 50 else None, t, "x") for k, t in enumerate(texts)] + [(7, "w " * 37, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    expected = Counter((i, (*plain(t), packing.END)) for i, t, _ in rows)
    pieces = packing.pack(docs, size=size, slack=1 / 16).collect()
    padding, tokens = checked(pieces, expected, size)
    assert padding < 0.04 * tokens
    again = packing.pack(docs, size=size, with_ids=True)
    made = {r.sequence_id: r.ids for r in packing.sequences(again).collect()}
    assert sum(map(len, made.values())) == sum(len(ids) * n for (_, ids), n in expected.items())
    for r in again.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20), st.sampled_from([0, 1 / 16, 1]))
def test_plan_places_each_rest_once(counts, slack):
    size = 64
    plan = packing.Plan(counts, size, slack)
    taken = defaultdict(list)
    for length, n in counts.items():
        rank = np.arange(n)
        w = plan.interval(np.full(n, length), rank)
        for r, k in zip(rank, w):
            assert plan.length[k] == length and plan.first[k] <= r
            by = r - plan.first[k]
            if plan.pack[k] >= 0:
                taken[int(plan.pack[k] + by // plan.copies[k])].append((int(plan.offset[k] + by % plan.copies[k] * length), length))
            else:
                for p in packing._powers(length):
                    q = p.bit_length() - 1
                    s, o = plan.on_line(np.array([q]), np.array([plan.cut[k, q] + by]))
                    taken[int(s[0])].append((int(o[0]), p))
    assert sorted(taken) == list(range(plan.sequences))
    for sequence, pieces in taken.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size and (size - at <= slack * size or at & (at - 1) == 0)


def test_emptiest_pack_first():
    placed, packs, fills = packing.shortest_pack_first({60: 1, 40: 1, 20: 1, 4: 1}, 64)
    assert packs == 2 and placed == [(60, 0, 1, 0, 1, 0), (40, 0, 1, 1, 1, 0), (20, 0, 1, 1, 1, 40), (4, 0, 1, 0, 1, 60)]
    assert sorted(fills) == [(0, 1, 64), (1, 1, 60)]
