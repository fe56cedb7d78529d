"""The index of a lexicon: containment against all pairs, and rules over what it notes against the same rules over the whole lexicon."""

import random

import pytest
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.operators import lexicon as X
from tests.test_names import WORDS


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, w) for k, ws in WORDS.items() for w in ws] * 2 + [("name", ""), ("name", None)]
    return spark.createDataFrame(rows, "kind string, name string")


TEXTS = [
    "Team Rocket's Mewtwo ex", "team rocket mewtwo", "Dark Charizard", "Pikachu VMAX", "Dark Alolan Ninetales Tag Team GX", "ex", "dark", "", None, "Mr. Mime", "harizar", "xxpikachuxx", "abc def", "q", "har", "Mew", "ar", "olan",
    "Rare Candy", "RARE CANDY!", "boss's orders", "Quick Ball", "Fire Energy", "double colorless energy", "water", "rnewtwo gx", "Basic Pokemon", "  *Pikachu*  ex  retreat", "Pikachu HP 60\nx", "charizord", "pikacho mew", "see PIKACHU! here", "Chaclzard", "A" * 60,
]


def ordered(names):
    return sorted(names, key=lambda w: (-len(w), w))


def test_containment_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    names = sorted({word(rng.randint(1, 9)) for _ in range(120)})
    texts = sorted({word(rng.randint(0, 14)) for _ in range(150)})
    a, b = spark.createDataFrame([(t,) for t in texts], "x string"), spark.createDataFrame([(n,) for n in names], "name string")
    first = lambda ok: {t: ordered(n for n in names if ok(t, n))[0] for t in texts if any(ok(t, n) for n in names)}
    assert {r.x: r.name for r in X.inside(a, b).collect()} == first(lambda t, n: n in t)
    assert {r.x: r.name for r in X.around(a, b).collect()} == first(lambda t, n: t in n)
    same = lambda t, n: sum(p == q for p, q in zip(t, n))
    want = {(t, n, same(t, n)) for t in texts for n in names if min(len(t), len(n)) >= 4 and abs(len(t) - len(n)) <= 2 and same(t, n) >= 0.7 * len(n)}
    assert {(r.x, r.name, r.same) for r in X.alike(a, b).collect()} == want


def test_rules_over_noted_entries_equal_the_whole_lexicon(spark, table):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    whole = N.Lexicon.of(**WORDS)
    noted, lex = X.with_entries(df, "t", table, cards=True)
    t = F.col("t")
    made = lambda frame, lexicon: sorted(map(str, frame.select("i", N.name_parts(t, lexicon).alias("p"), N.likely_name(t, lexicon).alias("l"), N.valid_base(F.lower(t), lexicon).alias("v"), F.round(N.name_score(t, lexicon), 9).alias("s"), N.trainer_score(t, lexicon).alias("a"), N.energy_score(t, lexicon).alias("e")).collect()))
    assert made(noted, lex) == made(df, whole)
    assert noted.select("i", "t").count() == len(TEXTS)
    parts = noted.select("i", "parts").collect()
    assert sorted(map(str, parts)) == sorted(map(str, df.select("i", N.name_parts(t, whole).alias("parts")).collect()))


def test_parsed_and_known_names_equal_the_expressions(spark, table):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    whole, t = N.Lexicon.of(**WORDS), F.col("t")
    for got, want in ((X.parsed_names(df, "i", "t", table), N.parsed_name(t, whole)), (X.known_names(df, "i", "t", table), N.known_name(t, whole))):
        assert dict(got.collect()) == dict(df.select("i", want).collect())


def test_a_lexicon_of_any_size_stays_out_of_the_plan(spark):
    names = spark.range(100_000).select(F.lit("name").alias("kind"), F.concat(F.lit("card"), F.sha2(F.col("id").cast("string"), 256).substr(1, 8)).alias("name"))
    df = spark.createDataFrame([(1, "xx card" + "5feceb66" + " yy"), (2, "card5feceb6"), (3, "nothing")], "i int, t string")
    found = X.contained_names(df, "i", "t", names)
    assert [(r.i, r.exact, r.within, r.name) for r in found.orderBy("i").collect()] == [(1, False, True, "card5feceb66"), (2, False, True, "card5feceb66"), (3, False, False, None)]
    noted, lex = X.with_entries(df, "t", names)
    plan = noted.select("i", N.likely_name(F.col("t"), lex))._jdf.queryExecution().optimizedPlan().toString()
    assert "5feceb66" not in plan.replace("xx card5feceb66 yy", "").replace("card5feceb6,", "")


def test_empty_lexicon_and_texts(spark, table):
    none = spark.createDataFrame([], "kind string, name string")
    df = spark.createDataFrame([(1, "pikachu"), (2, None), (3, "")], "i int, t string")
    assert dict(X.parsed_names(df, "i", "t", none).collect()) == {1: "pikachu", 2: "", 3: ""}
    assert dict(X.known_names(df, "i", "t", none).collect()) == {1: "", 2: "", 3: ""}
    assert X.known_names(df.limit(0), "i", "t", table).collect() == []
