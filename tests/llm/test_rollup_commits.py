"""Rollups: replays after folding, publishing, and counts by the rank file."""

import pytest
from pyspark.sql import functions as F

from foilframe.llm import token_rollups
from foilframe.llm.staging import listed

def totals(rollup):
    return sorted(((r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()), key=str)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("s", "en", 5, "clash"), (None, "en", 3, None), ("s", "en", 0, "clash")], "source string, lang string, n long, batch string")


def test_replays_after_folding_change_nothing(spark, rows, tmp_path):
    r = token_rollups.Rollup(spark, str(tmp_path / "r"))
    changes = token_rollups.signed(rows, F.lit("v"), F.col("n"), 1)
    for number in (0, 1, 5):
        r.commit(number, changes)
    want = totals(r)
    assert want == [("s", 6, 15), (None, 3, 9)] or want == sorted([("s", 6, 15), (None, 3, 9)], key=str)
    other = r.folded(str(tmp_path / "o"))
    r.fold()
    for x in (r, other):
        for number in (0, 1, 5, 1):
            x.commit(number, changes)
        assert totals(x) == want and x.base()["folded"] == [[0, 1], [5, 5]]
    r.commit(2, changes)
    r.fold().fold()
    r.commit(2, changes)
    assert totals(r) == sorted([("s", 8, 20), (None, 4, 12)], key=str) and r.base()["folded"] == [[0, 2], [5, 5]]
    r.clean()
    assert len(listed(spark, str(tmp_path / "r" / "data"))) == 1 and totals(r) == sorted([("s", 8, 20), (None, 4, 12)], key=str)


def test_a_batch_is_seen_whole_or_not_at_all(spark, rows, tmp_path, monkeypatch):
    r = token_rollups.Rollup(spark, str(tmp_path / "r"))
    r.commit(0, token_rollups.signed(rows, F.lit("v"), F.col("n"), 1))
    want = totals(r)

    def crash(*_):
        raise OSError

    monkeypatch.setattr(token_rollups, "publish", crash)
    for number in (0, 1):  # written, and lost before it is published
        with pytest.raises(OSError):
            r.commit(number, token_rollups.signed(rows, F.lit("v"), F.col("n") * 9, 1))
        assert totals(r) == want
    monkeypatch.undo()
    r.commit(0, token_rollups.signed(rows, F.lit("v"), F.col("n") * 2, 1))
    assert totals(r) == sorted([("s", 2, 10), (None, 1, 6)], key=str)
    r.commit(3, token_rollups.signed(rows.limit(0), F.lit("v"), F.col("n"), 1))
    assert totals(r) == sorted([("s", 2, 10), (None, 1, 6)], key=str)


def test_counts_by_the_rank_file(spark, tmp_path):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from foilframe.llm import bpe

    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    texts = {1: "Hello world, it's  me.", 2: None, 3: "", 4: "naïve 日本 " * 40}
    docs = spark.createDataFrame([(i, t, "s", "en", "clash") for i, t in texts.items()], "doc_id long, text string, source string, lang string, n_tokens string")
    counted = token_rollups.counted_by_bpe(docs)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {i: len(peer.encode_ordinary(t or "")) for i, t in texts.items()}
    r = token_rollups.Rollup(spark, str(tmp_path / "r"))
    r.commit(0, token_rollups.signed(counted, F.lit(token_rollups.BPE), F.col("n_tokens"), 1))
    row = r.totals().collect()
    assert [(x.source, x.lang, x.tokenizer_version, x.n_docs, x.n_tokens) for x in row] == [("s", "en", "byte_bpe_50k", 4, sum(len(peer.encode_ordinary(t or "")) for t in texts.values()))]
