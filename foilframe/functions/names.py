"""Card names as array expressions over a lexicon: parts, likelihood, scores, parsing, cleaning.

Everything is a Column. A lexicon is an array of names for each kind: a short list
of the caller's, or what operators/lexicon.py notes beside each row of a table of
any size. Where a rule says that any name will do, the first in order decides:
the longest, then by code point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foilframe.functions import texts as T

KINDS = ("name", "owner", "variant", "suffix", "trainer", "energy", "energy_type")


@dataclass(frozen=True)
class Lexicon:
    """An array of lower-case strings for each kind; names are letters and digits only."""

    name: Column
    owner: Column
    variant: Column
    suffix: Column
    trainer: Column
    energy: Column
    energy_type: Column

    @classmethod
    def of(cls, **words: Iterable[str]) -> "Lexicon":
        in_order = {k: sorted(set(words.get(k, ())), key=lambda w: (-len(w), w)) for k in KINDS}
        # for short lists: a constant of one string, which Catalyst folds to an array
        return cls(**{k: F.split(F.lit("\n".join(x)), "\n") if x else F.array().cast("array<string>") for k, x in in_order.items()})

    @property
    def prefix(self) -> Column:
        return F.concat(self.owner, self.variant)


def title(x: Column) -> Column:
    """Title case in which a capital follows every character that isn't a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit("\\p{L}+|\\P{L}+"), F.lit(0)), capitalised), "")


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))


def words_of(x: Column) -> Column:
    return F.filter(F.split(x, "\\s+"), lambda w: w != "")


def _phrase(words: Column, at: Column, n: int) -> Column:
    """n words after the first at."""
    return F.array_join(F.slice(words, at + 1, F.lit(n)), " ")


def name_parts(name: Column, lex: Lexicon) -> Column:
    """prefixes, base, suffixes of a name: folds that take known phrases off both ends, the longest first."""
    known = lambda p: F.array_contains(lex.prefix, p) | F.array_contains(lex.owner, F.concat(p, F.lit("'s")))
    none = F.array().cast("array<string>")

    def longest(words: Column, start: Callable[[int], Column], within: Callable[[int], Column], fits: Callable[[Column], Column], most: int) -> Column:
        """The longest phrase of at most most words that fits and how many words it has; null if there is none."""
        tried = lambda n: T.bound(_phrase(words, start(n), n), lambda p: F.when(fits(p), F.struct(F.lit(n).alias("n"), p.alias("phrase"))))
        return F.coalesce(*[F.when(within(n), tried(n)) for n in range(most, 0, -1)])

    def parts(words: Column) -> Column:
        # a fold ends with the first place where nothing is found
        def ahead(s: Column, _: Column) -> Column:
            found = longest(words, lambda n: s["at"], lambda n: s["at"] + n <= F.size(words), known, 3)
            more = lambda f: F.struct((s["at"] + F.coalesce(f["n"], F.lit(0))).alias("at"), F.when(f.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(f["phrase"]))).alias("out"), f.isNotNull().alias("on"))
            return F.when(s["on"], T.bound(found, more)).otherwise(s)

        def behind(first: Column) -> Callable[[Column, Column], Column]:
            def step(s: Column, _: Column) -> Column:
                found = longest(words, lambda n: s["at"] - n, lambda n: s["at"] - n >= first, lambda p: F.array_contains(lex.suffix, p), 2)
                more = lambda f: F.struct((s["at"] - F.coalesce(f["n"], F.lit(0))).alias("at"), F.when(f.isNull(), s["out"]).otherwise(F.concat(F.array(f["phrase"]), s["out"])).alias("out"), f.isNotNull().alias("on"))
                return F.when(s["on"], T.bound(found, more)).otherwise(s)

            return step

        start = lambda at: F.struct(at.alias("at"), none.alias("out"), F.lit(True).alias("on"))
        return T.bound(F.aggregate(words, start(F.lit(0)), ahead), lambda f: T.bound(
            F.aggregate(words, start(F.size(words)), behind(f["at"])),
            lambda b: F.struct(f["out"].alias("prefixes"), F.array_join(F.slice(words, f["at"] + 1, b["at"] - f["at"]), " ").alias("base"), b["out"].alias("suffixes")),
        ))

    return T.bound(words_of(T.spaced(F.coalesce(name, F.lit("")))), parts)


def _either_within(a: Column, b: Column, least_a: int, least_b: int) -> Column:
    """b, if long enough, stands in a, or a in b."""
    return ((F.length(b) >= least_b) & a.contains(b)) | ((F.length(a) >= least_a) & b.contains(a))


def valid_base(base: Column, lex: Lexicon) -> Column:
    """Whether a base name is known, by one of its words at least, or stands in a known name or one in it."""

    def valid(b: Column, norm: Column) -> Column:
        word = F.exists(F.split(b, " "), lambda w: T.bound(T.squashed(w), lambda v: F.array_contains(lex.name, v)))
        return (F.length(norm) >= 2) & (F.array_contains(lex.name, norm) | word | F.exists(lex.name, lambda x: _either_within(norm, x, 5, 5)))

    return T.bound(base, lambda b: T.bound(T.squashed(b), lambda norm: valid(b, norm)))


def likely_name(name: Column, lex: Lexicon, parts: Column | None = None) -> Column:
    """Whether a text is likely a name; parts: its parts, where they are known."""

    def likely(x: Column, norm: Column) -> Column:
        base = (name_parts(x, lex) if parts is None else parts)["base"]
        affix = F.array_contains(lex.variant, norm) | F.array_contains(lex.suffix, norm)
        word = F.exists(words_of(F.lower(x)), lambda w: F.array_contains(lex.name, T.squashed(w)))
        within = F.exists(lex.name, lambda x: _either_within(norm, x, 4, 4))
        return F.coalesce((F.length(norm) >= 2) & (F.array_contains(lex.name, norm) | affix | valid_base(base, lex) | within | word), F.lit(False))

    return T.bound(name, lambda x: T.bound(T.squashed(x), lambda norm: likely(x, norm)))


def name_score(name: Column, lex: Lexicon, parts: Column | None = None) -> Column:
    """Length, letters, prefixes, base name and suffixes, else single words; less for shouting, repeats and digits."""
    known = lambda w: F.array_contains(lex.name, w)

    def modifies(word: Column, kept: Column) -> Column:
        starts = lambda flat: kept.contains(word) & F.exists(lex.prefix, lambda x: T.squashed(x).contains(flat))
        return T.bound(T.squashed(word), lambda flat: ~known(flat) & (F.array_contains(lex.suffix, flat) | starts(flat)))

    def single(x: Column, words: Column) -> Column:
        hits = F.size(F.filter(words, lambda w: known(T.squashed(w))))
        modifiers = T.bound(T.spaced(x), lambda kept: F.size(F.filter(words, lambda w: modifies(w, kept))))
        within = T.bound(T.squashed(x), lambda norm: F.exists(lex.name, lambda x: (F.length(x) >= 5) & (norm.contains(x) | x.contains(norm))))
        points = lambda h, m: 10 * h + 2 * m + F.when((h >= 1) & (m >= 1), 5).otherwise(0) + F.when((h == 0) & within, 5).otherwise(0)
        return T.bound(hits, lambda h: T.bound(modifiers, lambda m: points(h, m)))

    def score(x: Column, p: Column) -> Column:
        n = F.length(x)
        return (
            F.when(n.between(3, 50), 2.0).when(n > 50, -1.0).otherwise(0.0) + F.when(n.between(5, 30), 1).otherwise(0)
            + 3.0 * F.length(F.regexp_replace(x, "[^\\p{L} '.-]", "")) / F.greatest(n, F.lit(1))
            + F.when(valid_base(p["base"], lex), 12 + 4 * F.size(p["prefixes"]) + 3 * F.size(p["suffixes"])).otherwise(T.bound(words_of(F.lower(x)), lambda words: single(x, words)))
            - F.when(x.rlike("[A-Z]{5,}"), 2).otherwise(0) - F.when(F.lower(x).rlike("(.)\\1{3,}"), 2).otherwise(0) - F.when(x.rlike("[0-9]{3,}"), 3).otherwise(0)
        )

    scored = lambda x: F.when(F.length(x) > 0, T.bound(name_parts(x, lex) if parts is None else parts, lambda p: score(x, p))).otherwise(0.0)
    return T.bound(name, scored)


#: Suffixes in capitals, and those in title case; all others are in lower case.
CAPITAL_SUFFIXES = ("ex", "gx", "v", "vmax", "vstar", "lv.x", "break", "legend", "prime")
TITLE_SUFFIXES = ("tag team", "single strike", "rapid strike", "fusion strike")


def rebuilt(parts: Column) -> Column:
    """A name from its parts in the casing of cards."""
    owner = lambda p: F.array_join(F.transform(F.split(p, " "), capitalised), " ")
    before = F.transform(parts["prefixes"], lambda p: F.when(p.contains("'"), owner(p)).otherwise(title(p)))
    after = F.transform(parts["suffixes"], lambda s: F.when(s.isin(*CAPITAL_SUFFIXES), F.upper(s)).when(s.isin(*TITLE_SUFFIXES), title(s)).otherwise(s))
    return F.array_join(F.concat(before, F.when(parts["base"] != "", F.array(title(parts["base"]))).otherwise(F.array().cast("array<string>")), after), " ")


#: What ends a name in a line that was read, in the order in which it is looked for.
NOISE = ("evolves from", "stage 2", "stage 1", "stage", "basic pokemon", "from", "hp ", " hp", "weakness", "resistance", "retreat", "put", "damage", "attack")


def name_line(raw: Column) -> Column:
    """The first line of a text that was read, without marks and from the first word of NOISE on."""
    line = F.regexp_replace(F.substring_index(F.coalesce(raw, F.lit("")), "\n", 1), "[^A-Za-z\\s'\\-\u00e9\u00c9.]", " ")
    cut = lambda x, token: F.when(F.instr(F.lower(x), token) > 0, F.trim(x.substr(F.lit(1), F.instr(F.lower(x), token) - 1))).otherwise(x)
    return F.aggregate(F.array(*map(F.lit, NOISE)), F.array_join(words_of(line), " "), cut)


def parsed_name(raw: Column, lex: Lexicon) -> Column:
    """The card's name in a text that was read: of the first one to six words of its first line the best score, rebuilt from its parts; of equal scores the shortest."""
    line = name_line(raw)

    def tried(words: Column) -> Column:
        names = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.size(words))), lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")), lambda x: F.length(x) <= 50)
        scored = F.transform(F.transform(names, lambda x: F.struct(x.alias("x"), name_parts(x, lex).alias("p"))), lambda y: candidate(y["x"], y["p"], lex))
        best = F.array_max(F.transform(scored, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("i"), s["name"].alias("name"))))
        return F.when(best["score"] > -1, best["name"]).otherwise("")

    best = F.transform(F.array(words_of(line)), lambda w: F.when(F.size(w) > 0, tried(w)).otherwise(""))[0]
    return F.transform(F.array(best), lambda b: F.when((b == "") | likely_name(b, lex), b).otherwise(_mended(b, lex)))[0]


def candidate(x: Column, parts: Column, lex: Lexicon) -> Column:
    """score, and name: x rebuilt from its parts if their base is known."""
    valid = (parts["base"] != "") & valid_base(parts["base"], lex)
    bonus = 15.0 + F.when(F.size(parts["prefixes"]) > 0, 5.0).otherwise(0.0) + F.when(F.size(parts["suffixes"]) > 0, 3.0).otherwise(0.0)
    return F.struct((name_score(x, lex, parts) + F.when(valid, bonus).otherwise(0.0)).alias("score"), F.when(valid, rebuilt(parts)).otherwise(x).alias("name"))


def _mended(x: Column, lex: Lexicon) -> Column:
    """x with a confusion of the reader undone and rebuilt, if that makes a likely name of it."""
    tries = F.filter(T.confusions(x), lambda t: likely_name(t, lex))
    made = F.transform(F.transform(F.slice(tries, 1, 1), lambda t: F.struct(t.alias("t"), name_parts(t, lex).alias("p"))), lambda y: F.when(y["p"]["base"] != "", rebuilt(y["p"])).otherwise(title(y["t"])))
    return F.coalesce(F.get(made, F.lit(0)), x)


def known_name(text: Column, lex: Lexicon) -> Column:
    """The known name in a noisy text: a word that is one, else one that stands in the text, else one that a word of about its length agrees with in seven tenths of its places; empty if none."""
    words = words_of(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z\\s]", " "))
    exact = F.get(F.filter(words, lambda w: (F.length(w) >= 3) & F.array_contains(lex.name, w)), F.lit(0))
    inside = F.get(F.filter(lex.name, lambda x: (F.length(x) >= 4) & F.array_join(words, " ").contains(x)), F.lit(0))
    same = lambda w, x: F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(w), F.length(x))), lambda i: w.substr(i, F.lit(1)) == x.substr(i, F.lit(1))))
    alike = lambda w: F.filter(lex.name, lambda x: (F.length(x) >= 4) & (F.abs(F.length(w) - F.length(x)) <= 2) & (same(w, x) >= 0.7 * F.length(x)))
    close = F.get(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 4), alike)), F.lit(0))
    return F.coalesce(capitalised(F.coalesce(exact, inside, close)), F.lit(""))


def _trimmed_ends(text: Column, kept: str) -> Column:
    flat = F.array_join(words_of(F.coalesce(text, F.lit(""))), " ")
    return F.regexp_replace(F.regexp_replace(flat, "^[^a-zA-Z]+", ""), f"[^a-zA-Z\\s{kept}]+$", "")


def clean_trainer(text: Column) -> Column:
    """Single spaces, no marks at the ends, title case unless it is all in capitals."""
    x = _trimmed_ends(text, "'-")
    return F.trim(F.when((F.upper(x) == x) & (F.lower(x) != x), x).otherwise(title(x)))


def clean_energy(text: Column) -> Column:
    return F.trim(title(_trimmed_ends(text, "")))


#: Patterns of trainer cards, and words that occur on them.
TRAINER_PATTERN = "professor\\s*'?s?\\s*\\w+|boss\\s*'?s?\\s*orders?|\\w+\\s*ball|\\w+\\s*potion|\\w+\\s*city\\s*gym|team\\s*\\w+\\s*grunt"
TRAINER_WORDS = ("ball", "potion", "catcher", "switch", "trainer", "professor", "boss", "research", "nest", "ultra", "quick", "rare", "candy", "gym", "stadium", "supporter", "energy", "retrieval", "search")


def likely_trainer(name: Column, lex: Lexicon) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.array_contains(lex.trainer, low) | F.array_contains(lex.trainer, F.replace(low, F.lit("'"), F.lit(""))) | F.exists(lex.trainer, lambda x: (F.length(x) >= 4) & low.contains(x))
    return (F.length(F.coalesce(name, F.lit(""))) >= 3) & (known | low.rlike(TRAINER_PATTERN))


def likely_energy(name: Column, lex: Lexicon) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (F.length(F.coalesce(name, F.lit(""))) >= 3) & (F.array_contains(lex.energy, low) | F.exists(lex.energy_type, lambda x: low.contains(x)) | low.contains("energy"))


def trainer_score(text: Column, lex: Lexicon, parts: Column | None = None) -> Column:
    """How likely a text is the name of a trainer card; parts: its parts as a name, where they are known."""
    n, low = F.length(text), F.lower(text)
    cased = F.upper(text) != F.lower(text)
    return (
        F.when(likely_trainer(text, lex), 5.0).otherwise(0.0) + F.when(n.between(6, 25), 2.0).when(n.between(3, 5), 1.0).when(n > 25, 0.5).otherwise(0.0) - F.when(T.garbage(text), 3.0).otherwise(0.0)
        + F.when(cased & ((text == title(text)) | (text == F.upper(text))), 1.0).otherwise(0.0)
        + 1.5 * F.size(F.filter(F.array(*map(F.lit, TRAINER_WORDS)), lambda w: low.contains(w))) - F.when(likely_name(text, lex, parts), 1.0).otherwise(0.0)
    )


def energy_score(text: Column, lex: Lexicon) -> Column:
    """How likely a text is the name of an energy card."""
    low = F.lower(text)
    return (
        F.when(likely_energy(text, lex), 5.0).otherwise(0.0) + F.when(low.contains("energy"), 2.0).otherwise(0.0)
        + F.when(F.exists(lex.energy_type, lambda x: low.contains(x)), 2.0).otherwise(0.0) - F.when(T.garbage(text), 3.0).otherwise(0.0)
    )
