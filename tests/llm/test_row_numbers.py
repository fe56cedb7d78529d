"""Row numbers must agree between scans whose files are split otherwise, as when an executor comes or goes between two jobs."""

import itertools

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foilframe.llm import exact_dedup, mixing, ngram_join, quality

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path):
    """400 rows in two files of small row groups; every text stands twice, 200 rows apart."""
    rows = [(i, " ".join(f"w{(i % 200) * 7 + k}x{i % 200}" for k in range(12)), "ab"[i % 2]) for i in range(400)]
    for k in range(2):
        part = list(zip(*rows[k::2]))
        pq.write_table(pa.table({"doc_id": part[0], "text": part[1], "source": part[2]}), tmp_path / f"{k} é%.parquet", row_group_size=10)
    yield spark.read.parquet(str(tmp_path))
    spark.conf.unset(SPLIT)


@pytest.fixture
def shifting(spark, monkeypatch):
    """Each table written from here on is followed by another size of splits."""
    sizes = itertools.cycle(["1500", "128MB", "700", "4000"])
    for module in (exact_dedup, ngram_join, mixing):
        plain = module.stage

        def stage(df, name, plain=plain):
            out = plain(df, name)
            spark.conf.set(SPLIT, next(sizes))
            return out

        monkeypatch.setattr(module, "stage", stage)


def places(df, place="place"):
    return sorted((r.doc_id, r[place]) for r in df.collect())


def test_places_do_not_depend_on_splits(spark, docs):
    spark.conf.set(SPLIT, "128MB")
    few = docs.rdd.getNumPartitions()
    before = places(exact_dedup.keyed(docs))
    spark.conf.set(SPLIT, "700")
    assert docs.select("*").rdd.getNumPartitions() > few
    assert places(exact_dedup.keyed(docs)) == before
    assert len({p for _, p in before}) == 400


def test_dedup_with_shifting_splits(docs, shifting):
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()) == [(i, i % 200, 2, i < 200) for i in range(400)]
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()) == list(range(200))


def test_ngram_join_with_shifting_splits(docs, shifting):
    assert sorted(r.doc_id for r in ngram_join.representatives(docs, slots=1 << 16).collect()) == list(range(200))


def test_mix_with_shifting_splits(docs, shifting):
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    taken = mixing.mixed(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.doc_id: r.n for r in taken} == {i: n for i, n in times.items() if n}


def test_accepted_with_shifting_splits(spark, docs, monkeypatch):
    spark.conf.set(SPLIT, "128MB")
    monkeypatch.setattr(quality, "train", lambda docs, labels: None)

    class ByLength:
        @staticmethod
        def score(x):
            return x

    monkeypatch.setattr(quality, "statistics", lambda texts: __import__("numpy").array([float(len(t.as_py()) % 2) for t in texts]))
    scored = quality.score

    def score(d, _):
        out = scored(d, ByLength).localCheckpoint()
        spark.conf.set(SPLIT, "700")
        return out

    monkeypatch.setattr(quality, "score", score)
    want = sorted(r.doc_id for r in docs.collect() if len(r.text) % 2)
    assert sorted(r.doc_id for r in quality.accepted(docs, None, 0.5).collect()) == want
