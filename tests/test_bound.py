"""Rules over names mention what they are given once, and their rows are dealt out by count."""

import pytest
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.functions import texts as T
from foilframe.operators import relational as R

WORDS = {"name": ["ring", "widget"], "owner": ["brock's"], "variant": ["hot"], "suffix": ["ex", "tag team"]}
RULES = {"parts": N.name_parts, "valid": N.valid_base, "likely": N.likely_name, "score": N.name_score}


@pytest.mark.parametrize("rule", RULES)
def test_a_rule_finds_its_text_once(spark, rule):
    said = str(RULES[rule](F.concat(F.lit("mark_of_text"), F.col("t")), N.Lexicon.of(**WORDS)))
    assert said.count("mark_of_text") == 1


def test_a_rule_finds_the_parts_it_is_given_once(spark):
    assert str(N.name_score(F.col("t"), N.Lexicon.of(**WORDS), F.col("mark_of_parts"))).count("mark_of_parts") == 1


def test_bound_values(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(T.bound(F.upper("t"), lambda x: F.concat(F.coalesce(x, F.lit("-")), F.coalesce(x, F.lit("+"))))).collect()] == ["AA", "-+"]


def test_spread(spark):
    rows = spark.range(0, 1000, 1, 1)
    dealt = R.spread(rows, "id", 100)
    assert dealt.rdd.getNumPartitions() == 10
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert R.spread(rows.limit(0), "id", 100).count() == 0
