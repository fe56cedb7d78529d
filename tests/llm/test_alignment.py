"""Alignment against a plain version over the libraries, and the laws of composing fragments."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foilframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["a", "the", "Straße's", "it's", "x" * 40, "１２", "42nd", "--", "<|endoftext|>", "<s>", "<0x0A>", "日本語", "é", "\n", "\t", "", "don'T", "“so”", "😀", "नमस्ते", " ", "q\x1cq", "\r\n ", "=====", "ciónñueco"]
TEXT = st.lists(st.sampled_from(WORDS) | st.text(st.characters(exclude_categories=["Cs"]), max_size=5), max_size=14).map(" ".join)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable}
    byte_of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        """The groups as pairs of id lists, from the definition."""
        if not text:
            return []
        left, right = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes(i)) for i in b.encode(text)]
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (left, right)):
            return []
        ends = []
        for side in (left, right):
            at, found = 0, set()
            for _, t in side:
                at += len(t)
                found.add(at)
            ends.append(found)
        both, out = ends[0] & ends[1], defaultdict(lambda: ([], []))
        for k, side in enumerate((left, right)):
            at = 0
            for i, t in side:
                at += len(t)
                out[min(e for e in both if e >= at)][k].append(i)
        return [out[e] for e in sorted(out)]

    return groups


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(texts, plain):
    found = [plain(t) for t in texts]
    held = Counter(p for g in found for p in {(i, j) for a, b in g for i in a for j in b})
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    rows = []
    for g in found:
        links = [(i, j) for a, b in g for i in a for j in b]
        digest = hashlib.sha256(shown(g).encode()).hexdigest() if g else ""
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return rows, held


def test_whole_texts_equal_the_definition(pair, plain):
    @settings(max_examples=250, deadline=None)
    @given(TEXT)
    def same(text):
        (got,) = pair.texts([text])
        want = plain(text)
        assert (got.text.decode() if got else "") == shown(want)
        if got:
            codes = np.frombuffer(got.codes, pair.kind).tolist()
            assert codes == [i * pair.width + j for a, b in want for i in a for j in b]
            assert got.n_a == sum(len(a) for a, _ in want)

    same()


def test_parts_compose_to_the_whole_in_any_order(pair):
    @settings(max_examples=150, deadline=None)
    @given(TEXT.filter(bool), st.integers(1, 20), st.randoms(use_true_random=False))
    def same(text, size, random):
        (want,) = pair.texts([text])
        parts = [pair.tokens(*p) for p in pair.parts(" " + text, size)]
        if want is None:
            assert None in parts or pair.ended(pair.fragment(sum(parts, alignment.EMPTY))) is None
            return
        fragments = [pair.fragment(p) for p in parts]
        while len(fragments) > 1:  # neighbours are composed in any order
            k = random.randrange(len(fragments) - 1)
            fragments[k : k + 2] = [pair.compose(*fragments[k : k + 2])]
        got = pair.ended(fragments[0])
        assert (got.text, got.codes, got.n_a) == (want.text, want.codes, want.n_a)

    same()


def test_stretches_cut_anywhere_have_open_ends(pair):
    """Token streams cut at different places: heads and tails are open, and composing is associative."""

    @settings(max_examples=150, deadline=None)
    @given(TEXT.filter(bool), st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=6), st.randoms(use_true_random=False))
    def same(text, cuts, random):
        s = pair.tokens(" " + text, 0, " " + text, 0)
        if s is None:
            return
        want = pair.fragment(s)
        a_cuts, b_cuts = (sorted(int(c[k] * n) for c in cuts) for k, n in ((0, len(s.a)), (1, len(s.b))))
        fragments = [pair.fragment(s.part(i, k, j, m)) for i, k, j, m in zip([0, *a_cuts], [*a_cuts, len(s.a)], [0, *b_cuts], [*b_cuts, len(s.b)])]
        while len(fragments) > 1:
            k = random.randrange(len(fragments) - 1)
            fragments[k : k + 2] = [pair.compose(*fragments[k : k + 2])]
        got, want = pair.ended(fragments[0]), pair.ended(want)
        assert (got and (got.text, got.codes, got.n_a)) == (want and (want.text, want.codes, want.n_a))

    same()


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_corpus_counts_and_long_documents(spark, plain, frequent):
    texts = [None, "", "one", "one", " ", "a ", "▁ no", "the cat's mat " * 60, "日本語の文章です。" * 40, "x" * 500, "\n\n  two  spaces " * 20] + [f"word{k % 7} ciónñueco the {k}" for k in range(60)] + ["the"] * 30 + ["no▁ way " * 80]
    rows = [(k if k % 20 else None, t, "x") for k, t in enumerate(texts)] + [(7, texts[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string").repartition(5)
    want, held = expected([t for _, t, _ in rows], plain)
    found, pairs = alignment.links(docs, part=60, frequent=frequent)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([(r.doc_id, *(r[c] for c in names)) for r in found.collect()], key=lambda r: (r[0] is None, *map(str, r))) == sorted([(i, *w) for (i, _, _), w in zip(rows, want)], key=lambda r: (r[0] is None, *map(str, r)))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == held


def test_empty_table(spark):
    found, pairs = alignment.links(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == [] and pairs.collect() == []


def test_endless_runs(pair, plain):
    for text in ("a" * 30_000, " " * 20_000, "\n" * 5000, "ab1" * 4000):
        (got,) = pair.texts([text])
        assert got.text.decode() == shown(plain(text))
