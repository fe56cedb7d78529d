"""Columns that clash with those of the operators, rows that are equal in all columns, and endless runs of characters."""

import time

import pytest

import corpus_pipeline
from foilframe.llm import bpe, exact_dedup, hmm, merkle, mixing, ngram_join, packing, pseudonyms, quality, sharding, token_rollups, whitening  # noqa: F401
from foilframe.llm import registry

CLASH = ["__row_place", "__file", "__file_number", "label", "quality", "__text", "__part", "place", "grp", "part", "rest", "x"]
ROWS = [(k % 90, f"some words of text {k % 70} and a few more of them", "en", "ab"[k % 2]) for k in range(200)] + [(None, None, None, None)] * 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("clash") / "d")
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *[f"'clash' AS {c}" for c in CLASH]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, [float(k), float(k % 3)], "c") for k in range(20)], "vec_id long, embedding array<float>, x string").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_ignore_columns_that_clash(spark, folder, name):
    n = registry.QUERIES[name](spark, folder).count()
    assert n == (40 if "whitening" in name else len(ROWS)) or ("op8" in name or "op12" in name) and n > 0


def test_stages_keep_columns_that_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        out = stage_of(spark, docs, folder)
        assert out.columns == docs.columns
        kept = out.select(*CLASH).distinct().collect()
        assert all(set(r) == {"clash"} for r in kept)
    assert 0 < exact_dedup.deduplicate(docs).count() <= 71


def test_equal_rows_of_a_large_group_are_dealt_evenly(spark):
    rows = [(None, "x" * 3000)] * 100 + [(7, "y" * 3000)] * 100 + [(k, f"doc {k}") for k in range(50)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 8 and max(sizes) < 1.35 * min(sizes)


def test_training_takes_a_bounded_number_of_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(60)] + [(2, "b")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    quality.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), max_train=25)
    assert seen == [25]


@pytest.mark.parametrize("run", ["a", "A1", "7", "a.", "-", "+1 ", "@", "a@", "1.", "token ", "token=", "a@b", "AB12 ", "(555) "])
def test_endless_runs_take_linear_time(run):
    f, took = pseudonyms.Feistel(b"k"), []
    for size in (100_000, 400_000):
        text = run * (size // len(run))
        began = time.process_time()
        pseudonyms.pseudonymise(text, f)
        took.append(time.process_time() - began)
    assert took[1] < max(1, 8 * took[0])  # four times the text; a quadratic search takes sixteen times as long


@pytest.mark.parametrize("text", ["a@b.co_m@x.yz", "x.y@z.de,p@q.org@r.st", "@@a@b.c", "é+1@b-c.d-e.f!", "a@b a@b.c", "token=abcdefghijklmnop@b.com and me@b.com"])
def test_addresses_are_those_of_the_pattern(text):
    at, found = 0, []
    while m := pseudonyms._PATTERNS["mail"].search(text, at):
        found.append(m.span())
        at = m.end()
    at, got = 0, []
    while m := pseudonyms._mail_from(text, at):
        got.append(m.span())
        at = m.end()
    assert got == found


def test_a_broken_delivery_is_not_counted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    store = exact_dedup.Store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(exact_dedup, "moved", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        exact_dedup.deliver(store, docs)
    monkeypatch.undo()
    assert {r.group_size for r in exact_dedup.deliver(store, docs).collect()} == {2}
