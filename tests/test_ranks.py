"""Ranks, number windows and percentiles under skew, against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from foilframe.functions import scores as S
from foilframe.operators import relational as R


def wanted(rows, share):
    out = {}
    for k in {k for k, v in rows if v is not None}:
        values = sorted(v for j, v in rows if j == k and v is not None)
        out[k] = tuple(values[round((len(values) - 1) * s)] for s in share)
    return out


@pytest.mark.parametrize("few", [5, 200, 1_000_000])
def test_skewed_and_repeated_values(spark, few):
    rng = random.Random(few)
    rows = [("far", rng.random()) for _ in range(900)] + [("far", 1e18), ("far", -1e300)] + [("ties", float(rng.choice([1, 1, 1, 1, 2, 3]))) for _ in range(700)]
    rows += [("edge", 1.0)] * 600 + [("edge", 0.5 + rng.random() / 3) for _ in range(60)] + [(None, float(k)) for k in range(40)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = R.at_ranks(df, ["k"], "v", {f"p{round(100 * s)}": F.bround((F.col("n") - 1) * s) for s in (0.0, 0.1, 0.5, 0.9, 1.0)}, few)
    got = {r.k: (r.p0, r.p10, r.p50, r.p90, r.p100) for r in found.collect()}
    assert got == wanted(rows, (0.0, 0.1, 0.5, 0.9, 1.0))


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(k % 50),) for k in range(1000)] + [(None,)], "v double")
    r = R.nearest_rank(df, [], "v", {"half": 0.5}).first()
    assert (r.n, r.half) == (1000, sorted(float(k % 50) for k in range(1000))[500])
    assert R.nearest_rank(df.filter("v IS NULL"), [], "v", {"half": 0.5}).collect() == []


def test_a_value_far_away_leaves_no_large_task(spark):
    """One value of 1e18 beside many in [0, 1]: what is put in order at the end is bounded."""
    df = spark.range(60_000).select(F.rand(3).alias("v")).unionByName(spark.range(1).select(F.lit(1e18).alias("v")))
    found = R.at_ranks(df, [], "v", {"p50": F.bround((F.col("n") - 1) * 0.5)}, few=1000).first()
    values = sorted(r.v for r in df.collect())
    assert found.p50 == values[30_000]


def test_number_windows_equal_all_windows(spark):
    texts = ["12/345", "1/1", "999/4007", "0/50", "123456/7", "7/123456", "25/102", "/12", "12/", "150/0165"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.b and (r.b.window_text, r.b.score) for r in df.select("t", S.best_number_window(F.col("t")).alias("b")).collect()}
    pairs = [(t, t[s : s + n], s, n) for t in texts for s in range(len(t)) for n in range(3, 8) if s + n <= len(t)]
    ok = spark.createDataFrame([(t, w, s, n) for t, w, s, n in pairs if w.count("/") == 1 and 1 <= len(w.split("/")[0]) <= 3 and 1 <= len(w.split("/")[1]) <= 3], "t string, w string, s int, n int")
    num, total = (F.split("w", "/")[k].cast("int") for k in (0, 1))
    scored = ok.filter(S.number_plausible(num, total)).select("t", "w", F.round(S.number_score(num, total), 6).alias("score"), "s", "n").collect()
    best = {t: max(((r.score, -r.s, -r.n, r.w) for r in scored if r.t == t), default=None) for t in texts}
    assert got == {t: b and (b[3], b[0]) for t, b in best.items()}
