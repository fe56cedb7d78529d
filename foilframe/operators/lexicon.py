"""Names of a lexicon found in texts, by an inverted index of short runs of characters instead of a list of all names.

A lexicon is a table (kind, name) of any size. What matters of it for a text are
few entries: those equal to one of the text's phrases, the first one in order
that stands in a text, the first in which a text stands. They are found by joins
and noted beside the text, and the rules of functions/names.py are applied to
them: a rule gives the same answer over them as over the whole lexicon.

Containment is an equi-join: of the shorter string the gram that is rarest among
the longer ones is looked up, and what it meets is verified. A string one of
whose grams is nowhere meets nothing. Strings are made distinct first, so hot
texts cost one look-up. In order means: the longest first, then by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.functions import texts as T
from foilframe.operators.relational import alike
from foilframe.operators.tables import written

#: Characters of a gram; no rule asks for containment of shorter names or texts but those that short() finds.
GRAM = 4
KINDS = N.KINDS


def grams(x: Column, n: int = GRAM) -> Column:
    """The different runs of n characters; none of a shorter text."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: x.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _meets(shorter: DataFrame, a: str, longer: DataFrame, b: str) -> DataFrame:
    """a, b: which strings of a, of GRAM characters at least, stand in which of b. Both columns are distinct and not null."""
    index = longer.select(b, F.explode(grams(F.col(b))).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    tried = shorter.select(a, F.explode(grams(F.col(a))).alias("gram")).join(often, "gram", "left")
    rarest = tried.groupBy(a).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key")).filter("key.n > 0").select(a, F.col("key.gram").alias("gram"))
    return rarest.join(index, "gram").filter(F.col(b).contains(F.col(a))).select(a, b)


def _first(met: DataFrame, x: str, name: str) -> DataFrame:
    """The first name in order for each x."""
    return met.groupBy(x).agg(F.min(F.struct((-F.length(name)).alias("n"), F.col(name).alias("name"))).alias("f")).select(x, F.col("f.name").alias("name"))


def inside(texts: DataFrame, names: DataFrame) -> DataFrame:
    """x, name: for each text x the first name that stands in it. texts: x; names: name; both distinct and not null."""
    short = names.filter(F.length("name") < GRAM)
    pieces = texts.select("x", F.explode(F.array_distinct(F.concat(*[grams(F.col("x"), n) for n in range(1, GRAM)]))).alias("name"))
    met = _meets(names.filter(F.length("name") >= GRAM), "name", texts, "x").select("x", "name").unionByName(pieces.join(short, "name").select("x", "name"))
    return _first(met, "x", "name")


def around(texts: DataFrame, names: DataFrame) -> DataFrame:
    """x, name: for each text x the first name in which it stands; texts and names as for inside(). A text without characters stands in any name."""
    long = _meets(texts.filter(F.length("x") >= GRAM), "x", names, "name")
    pieces = names.select("name", F.explode(F.concat(F.array(F.lit("")), *[grams(F.col("name"), n) for n in range(1, GRAM)])).alias("x"))
    short = texts.filter(F.length("x") < GRAM).join(_first(pieces, "x", "name"), "x").select("x", "name")
    return _first(long, "x", "name").unionByName(short)


def _windows(words: Column, most: int = 3) -> Column:
    """The phrases of one to most words."""
    at = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[at(n) for n in range(1, most + 1)])


def _gathered(found: DataFrame) -> DataFrame:
    """x and, for each kind, its entries in order. found: x, kind, name, a few for each x."""
    entry = F.struct((-F.length("name")).alias("n"), F.col("name").alias("name"))
    lists = [F.transform(F.array_sort(F.collect_set(F.when(F.col("kind") == k, entry))), lambda e: e["name"]).alias(k) for k in KINDS]
    return found.groupBy("x").agg(*lists)


def _beside(texts: DataFrame, entries: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """texts with the entries of some kinds, empty where a text has none."""
    none = F.array().cast("array<string>")
    met = texts.join(entries.select("x", *[F.col(k).alias(f"__{k}") for k in kinds]), "x", "left")
    return met.withColumns({f"__{k}": F.coalesce(f"__{k}", none) for k in kinds})


AFFIXES = ("owner", "variant", "suffix", "trainer", "energy", "energy_type")


def with_entries(df: DataFrame, x: str, lexicon: DataFrame, cards: bool = False) -> tuple[DataFrame, N.Lexicon]:
    """df with the column parts (as name_parts gives them) for its text x, and a lexicon of what matters for each row.

    The lexicon's columns are those of the frame returned. cards: also the entries
    that the rules of trainer and energy cards look for. Everything is found for
    the different texts, which are written, and joined to df at the end.
    """
    lexicon = lexicon.select("kind", "name").filter("name != ''").distinct()
    texts = written(df.select(F.col(x).alias("x")).filter("x IS NOT NULL").distinct(), "lexicon-texts")
    kind = lambda *k: lexicon.filter(F.col("kind").isin(*k))

    # phrases that are a prefix or a suffix, and words that stand in a prefix
    squashed_words = F.transform(N.words_of(F.lower("x")), T.squashed)
    phrases = F.array_distinct(F.concat(_windows(N.words_of(T.spaced(F.col("x")))), squashed_words, F.array(T.squashed(F.col("x")))))
    affixes = kind("variant", "suffix").withColumn("key", F.col("name")).unionByName(kind("owner").withColumn("key", F.explode(F.array("name", F.regexp_replace("name", "'s$", "")))))
    found = texts.select("x", F.explode(phrases).alias("key")).join(affixes, "key").select("x", "kind", "name")
    runs = kind("owner", "variant").select("kind", "name", F.explode(F.array_distinct(_runs(T.squashed(F.col("name"))))).alias("key")).groupBy("key").agg(F.min(F.struct("kind", "name")).alias("e"))
    found = found.unionByName(texts.select("x", F.explode(F.array_distinct(squashed_words)).alias("key")).join(runs, "key").select("x", "e.kind", "e.name"))
    if cards:
        low = texts.select("x", F.lower(F.trim("x")).alias("low"))
        of_low = low.select("x", F.explode(F.array_distinct(F.array("low", F.replace("low", F.lit("'"), F.lit(""))))).alias("key"))
        found = found.unionByName(of_low.join(kind("trainer", "energy").withColumnRenamed("name", "key"), "key").select("x", "kind", F.col("key").alias("name")))
        lows = low.select(F.col("low").alias("x")).distinct()
        for k in ("trainer", "energy_type"):
            stands = inside(lows, kind(k).select("name")).withColumnRenamed("x", "low")
            found = found.unionByName(low.join(stands, "low").select("x", F.lit(k).alias("kind"), "name"))
    ahead = N.Lexicon(name=F.array().cast("array<string>"), **{k: F.col(f"__{k}") for k in AFFIXES})
    first = written(_beside(texts, _gathered(found), AFFIXES).withColumn("parts", N.name_parts(F.col("x"), ahead)), "lexicon-parts")

    # names: equal to the text, its base or a word of either, standing in them, or holding them
    base = F.col("parts.base")
    strings = F.array_distinct(F.concat(F.array(T.squashed(F.col("x")), T.squashed(base)), squashed_words, F.transform(F.split(base, " "), T.squashed)))
    asked = first.select("x", F.explode(strings).alias("key"))
    facts = known(written(asked.select(F.col("key").alias("x")).distinct(), "lexicon-strings"), kind("name").select("name")).withColumnRenamed("x", "key")
    entries = _gathered(asked.join(facts, "key").select("x", F.lit("name").alias("kind"), "name"))
    noted = _beside(first, entries, ("name",)).withColumnRenamed("x", "__x")
    # a null text has the parts of an empty one
    none, no_parts = F.array().cast("array<string>"), F.struct(F.array().cast("array<string>").alias("prefixes"), F.lit("").alias("base"), F.array().cast("array<string>").alias("suffixes"))
    out = df.join(noted, F.col(x) == F.col("__x"), "left").select(*df.columns, F.coalesce("parts", no_parts).alias("parts"), *[F.coalesce(f"__{k}", none).alias(f"__{k}") for k in KINDS])
    return out, N.Lexicon(**{k: F.col(f"__{k}") for k in KINDS})


def _runs(x: Column) -> Column:
    """All runs of characters of a short text."""
    starts = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit("")), F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(x) - i + 1), lambda n: x.substr(i, n)))))


def known(strings: DataFrame, names: DataFrame) -> DataFrame:
    """x, name: of the names, the one equal to x, the first that stands in it and the first in which it stands. Both distinct and not null."""
    equal = strings.join(names, F.col("x") == F.col("name")).select("x", "name")
    return equal.unionByName(inside(strings, names)).unionByName(around(strings, names)).distinct()


def parsed_names(df: DataFrame, key: str, raw: str, lexicon: DataFrame) -> DataFrame:
    """key, name: the card's name in the text raw that was read on it; see names.parsed_name for the rule.

    The first one to six words of a line are rows; the best of a key is an
    aggregate. Only names that aren't likely are tried with a reader's confusions
    undone. key is unique.
    """
    words = N.words_of(N.name_line(F.col(raw)))
    lines = df.select(key, words.alias("words"))
    tries = F.transform(F.when(F.size("words") > 0, F.sequence(F.lit(1), F.least(F.lit(6), F.size("words")))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice("words", F.lit(1), k), " "))
    rows = lines.select(key, F.posexplode(tries).alias("k", "x")).filter(F.length("x") <= 50)
    noted, lex = with_entries(rows, "x", lexicon)
    scored = noted.select(key, "k", N.candidate(F.col("x"), F.col("parts"), lex).alias("s"))
    best = scored.groupBy(key).agg(F.max(F.struct(F.col("s.score").alias("score"), (-F.col("k")).alias("k"), F.col("s.name").alias("name"))).alias("b"))
    found = written(best.select(key, F.when(F.col("b.score") > -1, F.col("b.name")).otherwise("").alias("name")), "lexicon-best")

    noted, lex = with_entries(found, "name", lexicon)
    judged = written(noted.select(key, "name", ((F.col("name") == "") | N.likely_name(F.col("name"), lex, F.col("parts"))).alias("fine")), "lexicon-judged")
    undone = judged.filter("NOT fine").select(key, F.posexplode(T.confusions(F.col("name"))).alias("k", "x"))
    noted, lex = with_entries(undone, "x", lexicon)
    made = F.when(F.col("parts.base") != "", N.rebuilt(F.col("parts"))).otherwise(N.title(F.col("x")))
    mended = noted.filter(N.likely_name(F.col("x"), lex, F.col("parts"))).select(key, "k", made.alias("made")).groupBy(key).agg(F.min_by("made", "k").alias("made"))
    out = df.select(key).join(judged, key, "left").join(mended, key, "left")
    return out.select(key, F.coalesce("made", "name", F.lit("")).alias("name"))


def known_names(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, name: the known name in a noisy text; see names.known_name for the rule. key is unique."""
    names = lexicon.filter("kind = 'name' AND name != ''").select("name").distinct()
    words = N.words_of(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z\\s]", " "))
    rows = df.select(key, words.alias("words"))
    each = rows.select(key, F.posexplode("words").alias("k", "x"))
    exact = each.filter(F.length("x") >= 3).join(names.withColumnRenamed("name", "x"), "x").groupBy(key).agg(F.min_by("x", "k").alias("exact"))
    lines = rows.select(key, F.array_join("words", " ").alias("x"))
    stands = lines.join(inside(lines.select("x").distinct(), names.filter(F.length("name") >= GRAM)), "x").select(key, F.col("name").alias("inside"))
    long = each.filter(F.length("x") >= GRAM)
    near = _first(alike(long.select("x").distinct(), names), "x", "name")
    close = long.join(near, "x").groupBy(key).agg(F.min_by("name", "k").alias("close"))
    met = df.select(key).join(exact, key, "left").join(stands, key, "left").join(close, key, "left")
    return met.select(key, F.coalesce(N.capitalised(F.coalesce("exact", "inside", "close")), F.lit("")).alias("name"))


def contained_names(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, exact, within, name: whether a text, squashed, is a name, and the first name that stands in it or in which it stands, of GRAM characters at least on the shorter side."""
    names = lexicon.filter("kind = 'name' AND name != ''").select("name").distinct()
    rows = df.select(key, T.squashed(F.col(text)).alias("x"))
    strings = rows.filter("x IS NOT NULL").select("x").distinct()
    met = inside(strings, names.filter(F.length("name") >= GRAM)).unionByName(around(strings.filter(F.length("x") >= GRAM), names))
    equal = names.select(F.col("name").alias("x"), F.lit(True).alias("exact"))
    out = rows.join(equal, "x", "left").join(_first(met, "x", "name"), "x", "left")
    return out.select(key, F.when(F.col("x").isNotNull(), F.coalesce("exact", F.lit(False))).alias("exact"), F.when(F.col("x").isNotNull(), F.col("name").isNotNull()).alias("within"), "name")
