"""Scores of names against a plain reading of the rule."""

import re

import pytest
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.plans import catalog
from foilframe.plans.reports import PREFIXES, SUFFIXES

D = "/root/testdata/sf0.001"
NAMES = ["mewtwo", "pikachu", "mr mime", "ring", "widget", "bolt"]
flat = lambda s: re.sub("[^a-z0-9]+", "", s.strip().lower())


def splits(words, affixes, most):
    """Every way to take known phrases off the front: (lengths of the phrases, words left)."""
    yield (), words
    for n in range(1, min(most, len(words)) + 1):
        if any(" ".join(words[:n]) in (a, a.removesuffix("'s")) for a in affixes):
            for lengths, rest in splits(words[n:], affixes, most):
                yield (n, *lengths), rest


def parts_of(name):
    """Of all ways to take prefixes off the front, then suffixes off the end, that with the longest phrases first."""
    before, rest = max(splits(re.sub(r"[^a-z0-9\s'.\-]+", "", name.strip().lower()).split(), PREFIXES, 3))
    after, base = max(splits(rest[::-1], [" ".join(s.split()[::-1]) for s in SUFFIXES], 2))
    return len(before), " ".join(base[::-1]), len(after)


def valid(base, names):
    return len(flat(base)) >= 2 and (any(flat(w) in names for w in [base, *base.split()]) or any(min(len(p), len(flat(base))) >= 5 and (p in flat(base) or flat(base) in p) or len(p) >= 5 and p in flat(base) or len(flat(base)) >= 5 and flat(base) in p for p in names))


def plain(name, names):
    """The points of a name: each line of the table that holds counts."""
    before, base, after = parts_of(name)
    known = valid(base, names)
    kept = " ".join(re.sub(r"[^a-z0-9\s'.\-]+", "", name.strip().lower()).split())
    words = name.lower().split()
    hits = sum(flat(w) in names for w in words)
    modifiers = sum(flat(w) not in names and (flat(w) in SUFFIXES or w in kept and any(flat(w) in flat(p) for p in PREFIXES)) for w in words)
    part = any(len(p) >= 5 and (p in flat(name) or flat(name) in p) for p in names)
    table = [
        (3 <= len(name) <= 50, 2), (len(name) > 50, -1), (5 <= len(name) <= 30, 1), (True, 3 * len(re.sub(r"[^\w '.-]|[\d_]", "", name)) / max(len(name), 1)),
        (known, 12 + 4 * before + 3 * after), (not known, 10 * hits + 2 * modifiers), (not known and hits and modifiers, 5), (not known and not hits and part, 5),
        (re.search("[A-Z]{5,}", name), -2), (re.search(r"(.)\1{3,}", name.lower()), -2), (re.search(r"\d{3,}", name), -3),
    ]
    return float(sum(points for holds, points in table if holds)) if name else 0.0


def test_score(spark):
    texts = ["Team Rocket's Mewtwo ex", "team rocket Mewtwo", "Pikachu Tag Team GX", "old hot ring", "Mewt", "Mewtw", "xxMewtwoxx ex", "ex gx", "old", "rocket ex 1234", "PIKACHU", "aaaa", "", "a", "é!", "wid get", "ring " * 12, "q" * 51, "hot - ex", "r!ing old"]
    lex = N.Lexicon.of(name=NAMES, owner=[p for p in PREFIXES if "'" in p], variant=[p for p in PREFIXES if "'" not in p], suffix=SUFFIXES)
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "name string").select("name", N.name_score(F.col("name"), lex)).collect()}
    assert got == {t: pytest.approx(plain(t, NAMES)) for t in texts}


def test_best_card_name(spark):
    rows = {r.p_partkey: r for r in catalog.QUERIES["best_card_name"](spark, D).collect()}
    for p in spark.read.parquet(f"{D}/part.parquet").collect():
        n = p.p_name
        tries = [n + " 1234", n.upper(), p.p_brand, n[:7] + " gx", n, f"Team Rocket's {n} ex" if p.p_size % 2 == 0 else ""]
        best = max(range(6), key=lambda k: (round(plain(tries[k], catalog.LEXICON), 6), -k))
        r = rows.pop(p.p_partkey)
        assert (r.name, r.ord) == (tries[best], best + 1) and r.score == pytest.approx(plain(tries[best], catalog.LEXICON), abs=1e-6)
    assert not rows
