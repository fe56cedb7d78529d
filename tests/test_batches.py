"""Batches that are stopped and taken up again give the rows and totals of one run."""

import pytest
from pyspark.sql import functions as F

from foilframe.sources.batches import Batches
from foilframe.sources.commits import Tables


def test_stopped_anywhere_and_resumed(spark, tmp_path, monkeypatch):
    todo = spark.range(3, 60, 3).select(F.col("id").alias("ord"), (F.col("id") % 2 == 0).alias("hit"))
    work = lambda df: df.withColumn("double", F.col("ord") * 2)
    totals = {"hits": F.col("hit").cast("long"), "sum": F.col("double")}
    whole = Batches(Tables(spark, str(tmp_path / "whole")), "job")
    assert whole.all(todo, "ord", 0, work, totals) == 1

    parts, plain = Batches(Tables(spark, str(tmp_path / "parts")), "job"), Tables.commit
    assert parts.next(todo, "ord", 7, work, totals)
    monkeypatch.setattr(Tables, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        parts.next(todo, "ord", 7, work, totals)
    monkeypatch.undo()
    with pytest.raises(ZeroDivisionError):
        parts.next(todo, "ord", 7, lambda df: 1 / 0, totals)
    again = Batches(Tables(spark, str(tmp_path / "parts")), "job")
    assert Tables.commit is plain and again.all(todo, "ord", 7, work, totals) == 2 and not again.next(todo, "ord", 7, work, totals)
    a, b = whole.last(), again.last()
    assert (b["hits"], b["sum"], b["batch"]) == (a["hits"], a["sum"], 3) == (9, 1140, 3)
    rows = lambda x: sorted(map(tuple, x.tables.table("job_results").collect()))
    assert rows(whole) == rows(again)
    ledger = sorted((r.first, r.last, r.rows) for r in again.tables.table("job_ledger").select("first", "last", "rows").collect())
    assert ledger == [(3, 21, 7), (24, 42, 7), (45, 57, 5)]


def test_nothing_to_do(spark, tmp_path):
    job = Batches(Tables(spark, str(tmp_path / "t")), "job")
    assert not job.next(spark.range(0).withColumnRenamed("id", "ord"), "ord", 5, lambda df: df, {}) and job.last() == {}
