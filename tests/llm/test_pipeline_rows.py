"""The pipeline over odd rows, empty tables and clashing columns; its last stage against tiktoken; what it leaves behind."""

import hashlib
import os
import re

import numpy as np
import pytest

import corpus_pipeline
from foilframe.llm import bpe
from foilframe.llm.staging import listed, new_path

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def dataset(spark, path, rows, labels=()):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture
def peer():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})


ODD = [(1, "a b c d e f g h", "s"), (2, "a  b c\td e f g h", "s"), (3, None, None), (4, "", "s"), (5, "  \n ", "t"), (None, "a b c d e f g h", "s"), (1, "a b c d e f g h", "s"), (1, "another text of the same id", "t"), (6, "x y", "t"), (7, "X\ny", None), (8, "a b c d e f g h i", "é")]


def test_odd_rows(spark, tmp_path, peer):
    d = dataset(spark, tmp_path / "d", ODD)
    rows = corpus_pipeline.run(spark, d).collect()
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, _ in ODD}
    assert rows
    for r in rows:
        t = texts[r.decoded_sha256]
        ids = np.array(peer.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, list(r.ids)) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), ids.tolist())
    kept = {re.sub(r"[\x20\x09-\x0D]+", " ", texts[r.decoded_sha256]) for r in rows}
    # the copies of the first text and the one near it are one group, texts without words weigh nothing in the mix
    assert sum(x.startswith("a b c d e f g") for x in kept) <= 1 and len({x.lower() for x in kept}) == len(kept)


def test_empty_table(spark, tmp_path):
    d = dataset(spark, tmp_path / "d", [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_each_stage_keeps_columns_that_clash(spark, tmp_path):
    d = dataset(spark, tmp_path / "d", ODD)
    extra = ["place", "times", "copy", "score", "digest", "kept", "node", "n", "k", "x"]
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", *[f"'clash' AS {c}" for c in extra])
    docs.write.parquet(str(tmp_path / "clash"))
    docs = spark.read.parquet(str(tmp_path / "clash"))
    for _, stage_of in corpus_pipeline.STAGES[:-1]:
        out = stage_of(spark, docs, d)
        assert out.columns == docs.columns and {r.place for r in out.select("place").collect()} == {"clash"}


def test_nothing_is_left_but_the_result(spark, tmp_path):
    folder = os.path.dirname(new_path(spark, "x"))
    d = dataset(spark, tmp_path / "d", ODD)
    before = set(listed(spark, folder))
    corpus_pipeline.run(spark, d).count()
    left = set(listed(spark, folder)) - before
    assert [x.rsplit("-", 1)[0] for x in left] == ["pipeline-token_ids"]


def test_bpe_of_a_text_above_a_mebibyte(peer):
    codec = bpe.Codec(bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
    text = "".join(f"word{k * 7919 % 10007} it's naïve,\n  \t12 " for k in range(60000))
    assert len(text) > 1 << 20
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == peer.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_memories_are_bounded(peer, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3000)
    codec = bpe.Codec(bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
    text = " ".join(f"w{k}x{k * k}" for k in range(3000))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == peer.encode_ordinary(text)
    assert len(codec.pieces) < 20 and len(codec.spaced) < 20 and len(codec.seams) < 20
    codec.forget()
    assert not codec.pieces and not codec.spaced and not codec.seams
