import numpy as np
import pytest
from pyspark.sql import functions as F

from foilframe.functions import scores as S
from foilframe.functions import texts as T


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row if len(cols) > 1 else row[0]


@pytest.mark.parametrize("x,label", [(0.0, "none"), (0.24, "none"), (0.25, "minor"), (0.49, "minor"), (0.5, "moderate"), (0.74, "moderate"), (0.75, "significant"), (1.0, "significant")])
def test_severity_bounds(spark, x, label):
    assert one(spark, v=S.severity_label(F.lit(x))) == label


def test_severity_models(spark):
    r = one(
        spark, corner=S.corner_severity(F.lit(0.3), F.lit(0.01)), edge=S.edge_severity(F.lit(0.1), F.lit(0.5)), scratch=S.scratch_severity(F.lit(3), F.lit(False)),
        textured=S.scratch_severity(F.lit(3), F.lit(True)), scuff=S.scuff_severity(F.lit(1540.0), F.lit(True)), blur=S.blur_score(F.lit(200.0)),
    )
    assert [round(v, 6) for v in r] == [0.8, 0.5, 0.3, 0.225, 0.3, 0.3]


def test_number_goldens(spark):
    good, bad = [(1, 100), (50, 200), (100, 100), (110, 100), (200, 150)], [(500, 100), (1, 5), (1, 999), (0, 100)]
    for num, total in good + bad:
        assert one(spark, v=S.number_plausible(F.lit(num), F.lit(total))) == ((num, total) in good)
    assert one(spark, v=S.number_score(F.lit(50), F.lit(100))) > one(spark, v=S.number_score(F.lit(50), F.lit(400)))
    assert one(spark, v=S.number_plausible(F.lit(None).cast("int"), F.lit(100))) is False


def test_identity_confidence(spark):
    for name, number, want in (("Charizard", "4/102", 1.0), ("", None, 0.0), ("Charizard", None, 0.5), ("", "4/102", 0.5), ("AB", None, 0.2)):
        assert one(spark, v=S.identity_confidence(F.lit(name), F.lit(number))) == want


def test_gates(spark):
    def both(aspect, area=0.3, rect=0.9):
        return tuple(one(spark, v=S.quad_gates(F.lit(aspect), F.lit(area), F.lit(rect), s)) for s in (True, False))

    assert both(0.95) == (False, False) and both(0.716) == (True, True) and both(0.62) == (False, True)
    assert both(0.716, area=0.03) == (False, False) and both(0.716, rect=0.5) == (False, False)


def test_grades_sum_to_one(spark):
    cols = S.grade_columns(F.lit(0.1), F.lit(0.2), F.lit(0.0), F.lit(9.0))
    r = one(spark, **cols)
    assert abs(r["p7"] + r["p8"] + r["p9"] + r["p10"] - 1) < 1e-12
    wear = 0.1
    assert abs(r["p_psa10"] - (0.05 + 0.9 * 0.85 - 0.6 * wear)) < 1e-12


def test_gatekeeper(spark):
    codes = lambda n, c, d, t: one(spark, v=S.gatekeeper_codes(F.lit(n), F.lit(c), F.lit(d), F.lit(t)))
    assert codes("Pikachu", 0.5, "pokemon", "pokemon") == []
    assert codes("", 0.0, "unknown", "trainer") == ["IMAGE_UNREADABLE", "TRAINER_NAME_NOT_FOUND"]
    assert codes("Fire", 0.5, "pokemon", "energy") == ["CARD_TYPE_MISMATCH", "ENERGY_NAME_NOT_FOUND"]


def test_energy_and_side(spark):
    assert one(spark, v=S.energy_type(F.lit(50.0), F.lit(150.0), F.lit(60.0))) == "grass"
    assert one(spark, v=S.energy_type(F.lit(200.0), F.lit(80.0), F.lit(120.0))) == "psychic"
    assert one(spark, v=S.back_side(F.lit(20.0), F.lit(20.0), F.lit(200.0), F.lit(80.0)))["label"] == "back"


def test_texts(spark):
    r = one(
        spark, a=T.squashed(F.lit(" Mr. Mime-EX ")), b=T.spaced(F.lit("  Ho-Oh   (x) ")), c=T.parsed_number(F.lit("no 004 / 102 x")), d=T.parsed_number(F.lit("none")), e=T.strict_number(F.lit("4/102x")),
        f=T.glyph_number(F.lit("12a/3/4")), g=T.file_key(F.lit("base1-004.png")), h=T.garbage(F.lit("bcdfghk")), i=T.garbage(F.lit("Pikachu")), j=T.corrected(F.lit("p1kachu"), lambda x: x == "plkachu"), k=T.trainer_subtype(F.lit("Pokemon Tool"), ["tool", "item"]),
    )
    assert r["a"] == "mrmimeex" and r["b"] == "ho-oh x" and r["c"] == "4/102" and r["d"] is None and r["e"] is None
    assert (r["f"]["num"], r["f"]["total"]) == (12, 34) and r["g"]["number"] == 4 and r["h"] and not r["i"] and r["j"] == "plkachu" and r["k"] == "tool"


def test_garbage_rules(spark):
    """Marks but for apostrophe and hyphen count, commas too; letters of any script are letters; no text is garbage."""
    cases = {"Pikachu": False, "": True, "a": True, None: True, "a,b,c,": True, "ab'c-d": False, "ñandú é": False, "日本語": False, "a b c d e": True, "a i a i": False, "buzz off": True, "bcdfghk": True, "bcd-fgh k": True, "ab, cd": False, "Mr. Mime": False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.garbage(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in rows} == cases


def test_card_type(spark):
    kind = lambda x: one(spark, v=T.card_type(F.lit(x), ["pikachu"], ["supporter", "item"], ["fire"]))
    assert [kind(x) for x in ("TRAINER", "Supporter", "Basic Energy", "fire energy", "HP 120", "a Pikachu", None)] == ["trainer", "trainer", "energy", "energy", "pokemon", "pokemon", "unknown"]
    assert np.isclose(one(spark, v=T.normalised_distance(F.lit("abcd"), F.lit("abxd"))), 0.25)
