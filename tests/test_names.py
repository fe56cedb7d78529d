"""Parsing, cleaning and scores of names against a plain reading of the rules, and known cases."""

import re

import pytest
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.plans import catalog, reports  # noqa: F401
from tests.test_name_score import flat

D = "/root/testdata/sf0.001"
WORDS = {
    "name": ["pikachu", "charizard", "alakazam", "mewtwo", "ninetales", "mrmime", "mew"], "owner": ["team rocket's", "brock's"], "variant": ["dark", "alolan"], "suffix": ["ex", "gx", "vmax", "tag team"],
    "trainer": ["rare candy", "bosss orders", "switch"], "energy": ["double colorless energy"], "energy_type": ["fire", "water"],
}


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", make(F.col("t"))).collect())]


@pytest.fixture(scope="module")
def lex(spark):
    return N.Lexicon.of(**WORDS)


def test_lists_are_in_order(spark, lex):
    r = spark.range(1).select(*[getattr(lex, k).alias(k) for k in WORDS]).first()
    assert all(r[k] == sorted(WORDS[k], key=lambda w: (-len(w), w)) for k in WORDS)


def test_parts_and_rebuilding(spark, lex):
    texts = ["Team Rocket's Mewtwo ex", "team rocket mewtwo", "Dark Charizard", "Pikachu VMAX", "Dark Alolan Ninetales Tag Team GX", "ex", "dark", "", None, "Mr. Mime"]
    got = values(spark, texts, lambda t: F.struct(N.name_parts(t, lex).alias("p"), N.rebuilt(N.name_parts(t, lex)).alias("r")))
    assert [(g.p.prefixes, g.p.base, g.p.suffixes) for g in got] == [
        (["team rocket's"], "mewtwo", ["ex"]), (["team rocket"], "mewtwo", []), (["dark"], "charizard", []), ([], "pikachu", ["vmax"]), (["dark", "alolan"], "ninetales", ["tag team", "gx"]), ([], "", ["ex"]), (["dark"], "", []), ([], "", []), ([], "", []), ([], "mr. mime", []),
    ]
    assert [g.r for g in got] == ["Team Rocket's Mewtwo EX", "Team Rocket Mewtwo", "Dark Charizard", "Pikachu VMAX", "Dark Alolan Ninetales Tag Team GX", "EX", "Dark", "", "", "Mr. Mime"]


def test_likely_and_valid(spark, lex):
    likely = {"Dark Charizard": True, "Team Rocket's Mewtwo": True, "Alolan Ninetales GX": True, "Pikachu VMAX": True, "ex": True, "Dark": True, "harizar": True, "xxpikachuxx": True, "abc def": False, "": False, None: False, "q": False, "har": False, "Mew": True}
    assert values(spark, likely, lambda t: N.likely_name(t, lex)) == list(likely.values())
    valid = {"pikachu": True, "mr. mime": True, "pikach": True, "pika": False, "xyz": False, "": False, "mew": True}
    assert values(spark, valid, lambda t: N.valid_base(t, lex)) == list(valid.values())


def test_parsed_names(spark, lex):
    cases = {
        "Pikachu": "Pikachu", "Pikachu HP 60": "Pikachu", "Dark Charizard something else": "Dark Charizard", "Team Rocket's Mewtwo GX\nsecond line": "Team Rocket's Mewtwo GX", "Alolan Ninetales GX": "Alolan Ninetales GX",
        "Basic Pokemon": "", "": "", None: "", "Evolves from Pikachu": "", "  *Pikachu*  ex  retreat": "Pikachu EX", "Dark  Alakazam ex": "Dark Alakazam EX",
    }
    assert dict(zip(cases, values(spark, cases, lambda t: N.parsed_name(t, lex)))) == cases
    put = values(spark, ["Trainer Put 2 damage", "A" * 45, "A" * 80, "p cl ikachu", "Chaclzard"], lambda t: N.parsed_name(t, lex))
    assert "damage" not in put[0].lower() and put[1] == "A" * 45 and put[2] == ""
    assert values(spark, ["rnewtwo", "rnewtwo gx"], lambda t: N.parsed_name(t, lex)) == ["Mewtwo", "Mewtwo GX"]


def test_known_names(spark, lex):
    cases = {"see PIKACHU! here": "Pikachu", "xx charizardyy": "Charizard", "the mew cat": "Mew", "charizord": "Charizard", "alakazom ex": "Alakazam", "nothing of it": "", "": "", None: "", "pikacho mew": "Mew"}
    assert dict(zip(cases, values(spark, cases, lambda t: N.known_name(t, lex)))) == cases


def test_cleaning(spark):
    cases = {"  12. rare   candy! ": ("Rare Candy", "Rare Candy"), "BOSS'S ORDERS": ("BOSS'S ORDERS", "Boss'S Orders"), "n-": ("N-", "N"), "": ("", ""), None: ("", ""), "123": ("", ""), "o'hara- 7": ("O'Hara-", "O'Hara-")}
    got = values(spark, cases, lambda t: F.struct(N.clean_trainer(t), N.clean_energy(t)))
    assert [tuple(g) for g in got] == [(a.strip(), b.strip()) for a, b in cases.values()]


def plain_garbage(t):
    if not t or len(t) < 2 or sum(not c.isalnum() and c not in " '-" for c in t) > 0.3 * len(t):
        return True
    w = t.split()
    if len(w) > 2 and sum(len(x) == 1 and x.upper() not in "AI" for x in w) > 0.5 * len(w):
        return True
    return bool(re.search("xx|qq|zz|ww|vv|kk|yy", t.lower()) or re.search("[^aeiou]{6}", "".join(c for c in t.lower() if c.isalpha())))


def test_trainer_and_energy_scores(spark, lex):
    texts = ["Rare Candy", "RARE CANDY", "boss's orders", "Professor's Research", "Quick Ball", "Fire Energy", "double colorless energy", "Pikachu", "xxqq", "ab", "water", "A very long name of a stadium card", "Switch", "", "it's 5 o'clock"]
    trainer = values(spark, texts, lambda t: N.trainer_score(t, lex))
    energy = values(spark, texts, lambda t: N.energy_score(t, lex))
    likely = dict(zip(texts, values(spark, texts, lambda t: N.likely_name(t, lex))))
    for t, a, b in zip(texts, trainer, energy):
        low = t.lower()
        known = len(t) >= 3 and (low in WORDS["trainer"] or low.replace("'", "") in WORDS["trainer"] or any(x in low for x in WORDS["trainer"]) or bool(re.search(N.TRAINER_PATTERN, low)))
        want = 5 * known + (2 if 6 <= len(t) <= 25 else 1 if 3 <= len(t) < 6 else 0.5 if len(t) > 25 else 0) - 3 * plain_garbage(t) + (t.istitle() or t.isupper()) + 1.5 * sum(w in low for w in N.TRAINER_WORDS) - likely[t]
        assert a == pytest.approx(want), t
        typed = any(x in low for x in WORDS["energy_type"])
        assert b == pytest.approx(5 * (len(t) >= 3 and (low in WORDS["energy"] or typed or "energy" in low)) + 2 * ("energy" in low) + 2 * typed - 3 * plain_garbage(t)), t


def test_registered_parse(spark):
    rows = {r.p_partkey: r.name for r in catalog.QUERIES["name_parse"](spark, D).collect()}
    for p in spark.read.parquet(f"{D}/part.parquet").collect():
        if p.p_partkey % 8 == 0:
            assert rows[p.p_partkey].lower().endswith(p.p_name.lower()) or flat(p.p_name) in flat(rows[p.p_partkey])
    scores = catalog.QUERIES["trainer_energy_scores"](spark, D)
    assert scores.filter("trainer IS NULL OR energy IS NULL").count() == 0 and scores.agg(F.max("trainer")).first()[0] >= 8
