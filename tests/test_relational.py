import random

from pyspark.sql import functions as F

from foilframe.operators import relational as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0.5, 2), (1, 0.5, 1), (1, 0.4, 0), (2, 0.1, 0)], "k int, s double, o int")
    assert rows(R.first_best(df, ["k"], [F.desc("s"), F.col("o")])) == [(1, 0.5, 1), (2, 0.1, 0)]


def test_tiered_lookup(spark):
    left = spark.createDataFrame([(1, 100), (2, 50), (3, 7), (4, None)], "id int, k int")
    dim = spark.createDataFrame([("a", 100, 50), ("b", 30, 50), ("c", 9, 100)], "s string, official int, total int")
    got = rows(R.tiered_lookup(left, "k", dim, ["official", "total"]).select("id", "s", "tier"))
    assert got == [(1, "a", 1), (2, "a", 2), (2, "b", 2)]


def test_highest_passing_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, 55.0, 70.0), (1, 55.0, 70.0), (2, 99.0, 99.0), (3, None, 1.0)], "id int, f double, b double")
    got = rows(left.select("id", R.highest_passing([F.col("f"), F.col("b")], [(10.0, 55.0, 75.0), (9.0, 60.0, 90.0)], 1.0)))
    assert got == [(1, 10.0), (1, 10.0), (2, 1.0), (3, 1.0)]


def test_first_of_list(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (1, "x")], "id int, k string")
    cand = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("x", 3, "ab")], "k string, o int, name string")
    ok = lambda c: c["name"].contains("b")
    assert rows(R.first_of_list(left, cand, ["k"], "o", ok, 40).select("id", "name").filter("name IS NOT NULL")) == [(1, "b"), (1, "b")]
    assert R.first_of_list(left, cand, ["k"], "o", ok, 1).filter("name IS NOT NULL").count() == 0 and R.first_of_list(left, cand, ["k"], "o", ok, 1).count() == 4


def test_ranks_against_sorting(spark):
    rng = random.Random(3)
    values = [("a", rng.gauss(0, 1) ** 5) for _ in range(700)] + [("b", 7.0)] * 50 + [("c", float(rng.randint(0, 3))) for _ in range(90)] + [("d", 1.5)] + [(None, 2.0), (None, 1e300), ("e", None)]
    df = spark.createDataFrame(values, "k string, v double").repartition(3)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    near = {r.k: r for r in R.nearest_rank(df, ["k"], "v", shares).collect()}
    line = {r.k: r for r in R.linear_percentiles(df, ["k"], "v", shares).collect()}
    assert set(near) == set(line) == {"a", "b", "c", "d", None}
    for k in near:
        own = sorted(v for x, v in values if x == k)
        for name, share in shares.items():
            at = (len(own) - 1) * share
            assert near[k][name] == own[round(at)] and near[k].n == len(own)
            lo = own[int(at)]
            assert abs(line[k][name] - (lo + (own[min(int(at) + 1, len(own) - 1)] - lo) * (at - int(at)))) <= 1e-9 * max(1, abs(line[k][name]))


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 14))) for _ in range(30)]
    names = sorted({*base, *("".join(c if rng.random() > 0.2 else rng.choice("abcd") for c in x)[: rng.randint(3, 14)] for x in base * 5)})
    want = []
    for a in names:
        for b in names:
            same = sum(x == y for x, y in zip(a, b))
            if a < b and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2 and same >= 0.7 * len(b):
                want.append((a, b, same))
    got = rows(R.similar_names(spark.createDataFrame([(x,) for x in names + names[:5] + [None]], "x string"), "x"))
    assert got == sorted(want) and len(want) > 20


def test_running_totals_in_levels(spark):
    values = [(k, k % 7) for k in random.Random(5).sample(range(5000), 900)]
    got = {r.k: r.run_v for r in R.running_totals(spark.createDataFrame(values, "k long, v long"), "k", ["v"], block=10).collect()}
    total = 0
    for k, v in sorted(values):
        total += v
        assert got[k] == total


def test_first_match_and_resume(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string")
    cand = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("x", 3, "ab")], "k string, o int, name string")
    got = rows(R.first_match(left, ["id"], cand, ["k"], F.col("name").contains("b"), [F.col("o")]).select("id", "name"))
    assert got == [(1, "b"), (2, None)]
    assert rows(R.first_match(left, ["id"], cand, ["k"], F.col("name").contains("b"), [F.col("o")], cap=1).select("id", "name")) == [(1, None), (2, None)]
    assert rows(R.resume(left, left.filter("id = 1"), "id", [F.col("id")], 5)) == [(2, "y")]


def test_reports(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double").withColumn("k", F.lit("a"))
    assert rows(R.nearest_rank(df, ["k"], "v", {"p10": 0.1, "p50": 0.5})) == [("a", 10, 1.0, 4.0)]
    assert rows(R.histogram(df, F.when(F.col("v") < 3, "low").otherwise("high"), ["low", "mid", "high"])) == [("high", 7), ("low", 3), ("mid", 0)]
    p = R.presence(spark.createDataFrame([("a", None), ("", "1/2"), ("b", "3/4")], "a string, b string"), F.col("a"), F.col("b")).first()
    assert (p.total, p.n_a, p.n_b, p.n_both, p.pct_both) == (3, 2, 2, 1, 33.3)
    t = spark.createDataFrame([(3, "x"), (1, "y"), (2, "y"), (0, "x"), (5, "z")], "o int, p string")
    assert [r.pattern for r in R.top_patterns(t, F.col("p"), "o", 2).collect()] == ["x", "y"]


def test_rate_limited(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 61, 3), (2, 7, 4)], "u int, t int, id int")
    got = R.rate_limited(df, "u", F.floor(F.col("t") / 60), [F.col("t"), F.col("id")], 1)
    assert {r.id: r.allowed for r in got.collect()} == {1: True, 2: False, 3: True, 4: True}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k int, s double, o int")
    assert R.first_best(e, ["k"], [F.desc("s")]).count() == 0
    assert R.nearest_rank(e, ["k"], "s", {"p": 0.5}).count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "k long, v long")
    got = {r.k: r.run_v for r in R.running_totals(df, "k", ["v"], 7).collect()}
    assert got == {k: sum(i % 5 for i in range(k + 1)) for k in range(50)}
