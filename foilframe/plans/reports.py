"""More registered queries: routing, texts of signals, name scores, evaluation reports and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.functions import observations as O
from foilframe.functions import scores as S
from foilframe.functions import texts as T
from foilframe.operators import lexicon as X
from foilframe.operators import relational as R
from foilframe.plans.catalog import _FLAT, _LIMIT, _READ, LEX, LEXICON, SCORED_ROWS, lexicon, line_key, query, readings, table
from foilframe.streaming import queries as Q

c = F.col
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("""
SELECT event_id, CASE WHEN method = 'GET' AND path = '/v1/health' THEN 'health' WHEN method = 'POST' AND path = '/v1/analyze' THEN 'analyze' WHEN method = 'POST' AND path = '/v1/grade' THEN 'grade' ELSE 'not_found' END AS handler,
  CASE WHEN (method = 'GET' AND path = '/v1/health') OR (method = 'POST' AND path IN ('/v1/analyze', '/v1/grade')) THEN 200 ELSE 404 END AS status
FROM (SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'GET' ELSE 'POST' END AS method, CASE event_type WHEN 'view' THEN '/v1/health' WHEN 'click' THEN '/v1/analyze' WHEN 'purchase' THEN '/v1/grade' ELSE '/v2' END AS path FROM events)""")
def route_dispatch(spark, d):
    kind = c("event_type")
    method = F.when(kind.isin("view", "signup"), "GET").otherwise("POST")
    path = F.when(kind == "view", "/v1/health").when(kind == "click", "/v1/analyze").when(kind == "purchase", "/v1/grade").otherwise("/v2")
    routes = {("GET", "/v1/health"): "health", ("POST", "/v1/analyze"): "analyze", ("POST", "/v1/grade"): "grade"}
    handler = F.lit("not_found")
    for (m, p), name in routes.items():
        handler = F.when((c("method") == m) & (c("path") == p), name).otherwise(handler)
    return table(spark, d, "events").select("event_id", method.alias("method"), path.alias("path")).select("event_id", handler.alias("handler"), F.when(handler == "not_found", 404).otherwise(200).alias("status"))


@query(f"""
SELECT {KEYS}, CASE WHEN g > r AND g > b AND g > 100 THEN 'grass' WHEN r > g AND r > b AND r > 150 AND b > 100 THEN 'psychic' WHEN r > g AND r > b AND r > 150 THEN 'fire' WHEN b > r AND b > g AND b > 120 THEN 'water'
  WHEN r > 180 AND g > 180 AND b < 100 THEN 'lightning' WHEN r > 150 AND g > 100 AND b < 100 THEN 'fighting' WHEN r < 100 AND g < 100 AND b < 100 THEN 'darkness' WHEN r > 150 AND g > 150 AND b > 150 THEN 'colorless'
  WHEN r > 100 AND g > 100 AND b > 100 AND abs(r - g) < 30 AND abs(g - b) < 30 THEN 'metal' END AS energy,
  CASE WHEN (b - (r + g) / 2) / 255 > 0.12 AND l_quantity * 2 / 255 > 0.18 THEN 'back' ELSE 'front' END AS side
FROM (SELECT *, (l_partkey % 256)::DOUBLE AS r, (l_suppkey * 7 % 256)::DOUBLE AS g, (l_orderkey % 256)::DOUBLE AS b FROM lineitem)""")
def colour_rules(spark, d):
    r, g, b = ((x % 256).cast("double") for x in (c("l_partkey"), c("l_suppkey") * 7, c("l_orderkey")))
    return table(spark, d, "lineitem").select(*line_key(), S.energy_type(r, g, b).alias("energy"), S.back_side(r, g, b, c("l_quantity") * 2)["label"].alias("side"))


@query("""
WITH b AS (SELECT CAST(floor(event_id / 50) AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS h FROM events GROUP BY 1)
SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS total, CAST(sum(h) OVER (ORDER BY batch) AS BIGINT) AS hits, round(100.0 * sum(h) OVER (ORDER BY batch) / sum(n) OVER (ORDER BY batch), 2) AS hit_pct FROM b""")
def running_hit_rate(spark, d):
    batches = table(spark, d, "events").groupBy(F.floor(c("event_id") / 50).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") >= 50).alias("h"))
    runs = R.running_totals(batches, "batch", ["n", "h"])
    return runs.select("batch", c("run_n").alias("total"), c("run_h").alias("hits"), F.round(100.0 * c("run_h") / c("run_n"), 2).alias("hit_pct"))


@query("""SELECT lang AS expected, source AS predicted, doc_id FROM documents WHERE lang <> 'en' ORDER BY lang, source, doc_id LIMIT 25""")
def failure_list(spark, d):
    return table(spark, d, "documents").filter("lang <> 'en'").select(c("lang").alias("expected"), c("source").alias("predicted"), "doc_id").orderBy("expected", "predicted", "doc_id").limit(25)


@query("""
SELECT avg(CASE WHEN quality IS NOT NULL THEN (quality = guess)::INT::DOUBLE END) * 100 AS known_pct, coalesce(avg((coalesce(quality, 1) = guess)::INT::DOUBLE), 0) AS accuracy, count(*) AS n, count(quality) AS known
FROM (SELECT d.doc_id, quality, CASE WHEN n_chars % 7 = 0 THEN 0 ELSE 1 END AS guess FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def eval_accuracy(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("guess", F.when(c("n_chars") % 7 == 0, 0).otherwise(1))
    right = lambda q: (q == c("guess")).cast("double")
    return met.agg((F.avg(right(c("quality"))) * 100).alias("known_pct"), F.coalesce(F.avg(right(F.coalesce("quality", F.lit(1)))), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.count("quality").alias("known"))


@query("""
SELECT event_id, status, detected, expected FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_type <> 'view' AS accepted, CASE WHEN value < 30 THEN 'trainer' ELSE 'pokemon' END AS detected, 'pokemon' AS expected FROM events)
WHERE status <> 200 OR (accepted AND detected <> expected) ORDER BY event_id LIMIT 20""")
def manifest_failures(spark, d):
    status = F.when(c("event_type") == "error", 500).otherwise(200)
    rows = table(spark, d, "events").select("event_id", status.alias("status"), (c("event_type") != "view").alias("accepted"), F.when(c("value") < 30, "trainer").otherwise("pokemon").alias("detected"), F.lit("pokemon").alias("expected"))
    return rows.filter((c("status") != 200) | (c("accepted") & (c("detected") != c("expected")))).orderBy("event_id").limit(20).drop("accepted")


@query("""
WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'ECONOMY'), b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'PROMO'), done AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size = 7)
SELECT name, 'union' AS set_op FROM (SELECT name FROM a UNION SELECT name FROM b) UNION ALL SELECT name, 'difference' FROM (SELECT name FROM a UNION SELECT name FROM b) WHERE name NOT IN (SELECT name FROM done)""")
def set_operations(spark, d):
    part = table(spark, d, "part").select(c("p_name").alias("name"), "p_type", "p_size")
    every = part.filter("p_type = 'ECONOMY'").select("name").union(part.filter("p_type = 'PROMO'").select("name")).distinct()
    rest = R.remaining(every, part.filter("p_size = 7"), "name")
    return every.withColumn("set_op", F.lit("union")).unionByName(rest.withColumn("set_op", F.lit("difference")))


_BASE = """(length({0}) >= 2 AND (list_contains({1}, {0}) OR len(list_filter(string_split({2}, ' '), lambda w: list_contains({1}, regexp_replace(w, '[^a-z0-9]+', '', 'g')))) > 0
  OR len(list_filter({1}, lambda x: (length(x) >= 5 AND contains({0}, x)) OR (length({0}) >= 5 AND contains(x, {0})))) > 0))"""


@query(f"""
WITH {LEX}, r AS (SELECT p_partkey, p_name, {_READ} AS t FROM part), n AS (SELECT *, {_FLAT.format("t")} AS f, list_filter(string_split(lower(t), ' '), lambda w: w <> '') AS w FROM r)
SELECT p_partkey, list_contains(names, f) AS exact, len(list_filter(w, lambda x: list_contains(names, regexp_replace(x, '[^a-z0-9]+', '', 'g')))) > 0 AS any_word,
  length(f) >= 2 AND (list_contains(names, f) OR list_contains(variants, f) OR f IN ('ex', 'gx', 'tag team') OR len(list_filter(names, lambda x: (length(x) >= 4 AND contains(f, x)) OR (length(f) >= 4 AND contains(x, f)))) > 0
    OR len(list_filter(w, lambda x: list_contains(names, regexp_replace(x, '[^a-z0-9]+', '', 'g')))) > 0) AS likely,
  {_BASE.format("f", "names", "lower(t)")} AS valid_base FROM n, lex""")
def likely_names(spark, d):
    """Readings that are likely a name, and those that are a known base name by themselves."""
    noted, lex = X.with_entries(readings(spark, d), "t", lexicon(spark, d))
    f, words = T.squashed(c("t")), F.exists(N.words_of(F.lower("t")), lambda w: F.array_contains(lex.name, T.squashed(w)))
    return noted.select("p_partkey", F.array_contains(lex.name, f).alias("exact"), words.alias("any_word"), N.likely_name(c("t"), lex, c("parts")).alias("likely"), N.valid_base(F.lower("t"), lex).alias("valid_base"))


_NAMES = "['ring', 'widget', 'bolt', 'gear', 'gizmo', 'plate']"


@query(f"""
WITH a AS (SELECT p_partkey, unnest([p_name, upper(p_name), p_brand, p_name || ' 1234']) AS name, unnest([1, 2, 3, 4]) AS ord FROM part),
n AS (SELECT *, {_FLAT.format("name")} AS f, trim(regexp_replace(lower(trim(name)), '[^a-z0-9\\s''.-]+', '', 'g')) AS base, len(list_filter(string_split(lower(name), ' '), lambda w: list_contains({_NAMES}, regexp_replace(w, '[^a-z0-9]+', '', 'g')))) AS hits FROM a),
s AS (SELECT *, round(CASE WHEN length(name) BETWEEN 3 AND 50 THEN 2 WHEN length(name) > 50 THEN -1 ELSE 0 END + CASE WHEN length(name) BETWEEN 5 AND 30 THEN 1 ELSE 0 END + 3.0::DOUBLE * length(regexp_replace(name, '[^\\p{{L}} ''.-]', '', 'g')) / greatest(length(name), 1)
  + CASE WHEN {_BASE.format("f", _NAMES, "base")} THEN 12 ELSE 10 * hits + CASE WHEN hits = 0 AND len(list_filter({_NAMES}, lambda x: length(x) >= 5 AND (contains(f, x) OR contains(x, f)))) > 0 THEN 5 ELSE 0 END END
  - CASE WHEN regexp_matches(name, '[A-Z]{{5,}}') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(name, '[0-9]{{3,}}') THEN 3 ELSE 0 END, 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, ord) AS k FROM s) SELECT p_partkey, name, ord, score FROM r WHERE k = 1""")
def best_name(spark, d):
    """The best of four readings of a name, over names without prefixes and suffixes."""
    lex = N.Lexicon.of(name=LEXICON)
    tries = F.posexplode(F.array("p_name", F.upper("p_name"), "p_brand", F.concat("p_name", F.lit(" 1234")))).alias("k", "name")
    part = R.spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", SCORED_ROWS)
    scored = part.select("p_partkey", tries).select("p_partkey", "name", (c("k") + 1).alias("ord"), F.round(N.name_score(c("name"), lex), 6).alias("score"))
    return R.first_best(scored, ["p_partkey"], [F.desc("score"), c("ord")])


PREFIXES, SUFFIXES = ["small", "large", "old", "hot", "red", "blue", "team rocket's"], ["ex", "gx", "tag team"]


@query()
def best_card_name(spark, d):
    """The best of six readings of a name by the whole rule; of equal ones the first."""
    name = c("p_name")
    readings = [F.concat(name, F.lit(" 1234")), F.upper(name), c("p_brand"), F.concat(F.substring(name, 1, 7), F.lit(" gx")), name, F.when(c("p_size") % 2 == 0, F.concat(F.lit("Team Rocket's "), name, F.lit(" ex"))).otherwise("")]
    part = R.spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", SCORED_ROWS)
    tries = part.select("p_partkey", F.posexplode(F.array(*readings)).alias("k", "name"))
    lex = N.Lexicon.of(name=LEXICON, owner=[p for p in PREFIXES if "'" in p], variant=[p for p in PREFIXES if "'" not in p], suffix=SUFFIXES)
    scored = tries.withColumn("parts", N.name_parts(c("name"), lex)).select("p_partkey", "name", (c("k") + 1).alias("ord"), F.round(N.name_score(c("name"), lex, c("parts")), 6).alias("score"))
    return R.first_best(scored, ["p_partkey"], [F.desc("score"), c("ord")])


@query(f"""
WITH a AS (SELECT p_partkey, unnest([p_brand, p_name || ' 1234', 'qz' || p_partkey, upper(p_name), '']) AS name, unnest([1, 2, 3, 4, 5]) AS ord FROM part WHERE p_size % 3 > 0
  UNION ALL SELECT p_partkey, unnest([p_brand, 'zz ' || p_size, 'qz' || p_partkey]), unnest([1, 2, 3]) FROM part WHERE p_size % 3 = 0),
n AS (SELECT *, {_FLAT.format("name")} AS f, trim(regexp_replace(lower(trim(name)), '[^a-z0-9\\s''.-]+', '', 'g')) AS base, len(list_filter(string_split(lower(name), ' '), lambda w: list_contains({_NAMES}, regexp_replace(w, '[^a-z0-9]+', '', 'g')))) AS hits FROM a WHERE name <> ''),
s AS (SELECT *, length(f) >= 2 AND (hits > 0 OR {_BASE.format("f", _NAMES, "base")} OR len(list_filter({_NAMES}, lambda x: (length(x) >= 4 AND contains(f, x)) OR (length(f) >= 4 AND contains(x, f)))) > 0) AS likely,
  round(CASE WHEN length(name) BETWEEN 3 AND 50 THEN 2 WHEN length(name) > 50 THEN -1 ELSE 0 END + CASE WHEN length(name) BETWEEN 5 AND 30 THEN 1 ELSE 0 END + 3.0::DOUBLE * length(regexp_replace(name, '[^\\p{{L}} ''.-]', '', 'g')) / greatest(length(name), 1)
  + CASE WHEN {_BASE.format("f", _NAMES, "base")} THEN 12 ELSE 10 * hits + CASE WHEN hits = 0 AND len(list_filter({_NAMES}, lambda x: length(x) >= 5 AND (contains(f, x) OR contains(x, f)))) > 0 THEN 5 ELSE 0 END END
  - CASE WHEN regexp_matches(name, '[A-Z]{{5,}}') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(name, '[0-9]{{3,}}') THEN 3 ELSE 0 END, 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN likely THEN 0 ELSE 1 END, CASE WHEN likely THEN ord ELSE 0 END, score DESC, ord) AS k FROM s)
SELECT p.p_partkey, coalesce(CASE WHEN likely OR score > -1 THEN name END, '') AS name, coalesce(likely, false) AS likely FROM part p LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (p_partkey)""")
def chosen_reading(spark, d):
    """Of several readings of a card the first that is likely a name, whatever the scores; else the best score above -1, of equal ones the first; else none."""
    lex = N.Lexicon.of(name=LEXICON)
    many = F.array("p_brand", F.concat("p_name", F.lit(" 1234")), F.concat(F.lit("qz"), c("p_partkey").cast("string")), F.upper("p_name"), F.lit(""))
    few = F.array(c("p_brand"), F.concat(F.lit("zz "), c("p_size").cast("string")), F.concat(F.lit("qz"), c("p_partkey").cast("string")))
    part = R.spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", SCORED_ROWS)
    tries = part.select("p_partkey", F.posexplode(F.when(c("p_size") % 3 > 0, many).otherwise(few)).alias("ord", "name")).filter("name != ''")
    judged = tries.select("p_partkey", "ord", "name", N.likely_name(c("name"), lex).alias("likely"), F.round(N.name_score(c("name"), lex), 6).alias("score"))
    best = judged.groupBy("p_partkey").agg(F.min_by(c("name"), F.when(c("likely"), c("ord"))).alias("first"), F.max(F.struct("score", (-c("ord")).alias("ord"), "name")).alias("top"))
    name = F.coalesce(c("first"), F.when(c("top.score") > -1, c("top.name")), F.lit(""))
    return part.select("p_partkey").join(best, "p_partkey", "left").select("p_partkey", name.alias("name"), c("first").isNotNull().alias("likely"))


#: The sets of names that are united: nine of generations, and those of owners and variants.
GENERATIONS = 9


@query(f"""
WITH n AS (SELECT 'gen' || (1 + (p_size - 1) % {GENERATIONS}) AS source, split_part(p_name, ' ', 2) AS name FROM part UNION ALL SELECT 'owner', p_brand FROM part UNION ALL SELECT 'variant', split_part(p_name, ' ', 1) FROM part)
SELECT CASE WHEN source LIKE 'gen%' THEN 'name' ELSE 'prefix' END AS kind, name, count(DISTINCT source) AS sources, min(source) AS first_source FROM n GROUP BY ALL""")
def name_unions(spark, d):
    """All names of nine generations and all prefixes, each once, with how many sets hold it and the first of them."""
    part = table(spark, d, "part")
    sets = [part.filter(((c("p_size") - 1) % GENERATIONS) == g).select(F.lit(f"gen{g + 1}").alias("source"), F.split("p_name", " ")[1].alias("name")) for g in range(GENERATIONS)]
    sets += [part.select(F.lit("owner").alias("source"), c("p_brand").alias("name")), part.select(F.lit("variant").alias("source"), F.split("p_name", " ")[0].alias("name"))]
    return R.united(sets, ["name"], F.when(c("source").startswith("gen"), "name").otherwise("prefix").alias("kind"))


@query("""
WITH f AS (SELECT l_orderkey AS file FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R'), r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'front' WHEN 'F' THEN 'back' ELSE '' END AS label, (o_orderkey % 100) / 100.0 AS conf, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey END AS file FROM orders)
SELECT CASE WHEN file IS NULL THEN 'blank' WHEN file NOT IN (SELECT file FROM f) THEN 'missing' WHEN label = 'front' AND conf >= 0.9 THEN 'front' WHEN label = 'back' AND conf >= 0.9 THEN 'back' ELSE 'review' END AS class, count(*) AS n FROM r GROUP BY ALL""")
def file_classes(spark, d):
    """Labelled rows by where their file goes; rows without a name and rows without a file are counted apart, in the scan that splits the others."""
    files = table(spark, d, "lineitem").filter("l_linenumber = 1 AND l_returnflag != 'R'").select(c("l_orderkey").alias("file"))
    label = F.when(c("o_orderstatus") == "O", "front").when(c("o_orderstatus") == "F", "back").otherwise("")
    rows = table(spark, d, "orders").select(F.when(c("o_orderkey") % 37 != 0, c("o_orderkey")).alias("file"), label.alias("label"), (c("o_orderkey") % 100 / 100.0).alias("conf"))
    placed, passed = R.with_files(rows, files, "file")
    kind = F.when((c("label") == "front") & (c("conf") >= 0.9), "front").when((c("label") == "back") & (c("conf") >= 0.9), "back").otherwise("review")
    counts = [(r["class"], r["n"]) for r in placed.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n")).collect()]  # three classes
    counts += [(k, passed.get[k]) for k in ("blank", "missing")]  # delivered with the result
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.lit(n).cast("long").alias("n")) for k, n in counts if n])))


@query("""
SELECT l_orderkey, count(*) AS n, array_to_string(list('BR_' || l_linenumber || ':' || l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey), ' ') AS log FROM lineitem GROUP BY l_orderkey""")
def candidate_log(spark, d):
    """What was read for each order, in the order in which it was tried."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("BR_"), c("l_linenumber").cast("string"), F.lit(":"), c("l_returnflag")).alias("what"))
    tried = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(one)).alias("x"))  # the lines of one order
    return tried.select("l_orderkey", "n", F.array_join(F.transform("x", lambda x: x["what"]), " ").alias("log"))


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2)
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM gone) THEN NULL ELSE o_custkey END AS tenant, o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM gone) AS key_kept FROM orders""")
def tenant_deletion(spark, d):
    """What deleting tenants does: their keys (open orders) go with them, usage stays without a tenant."""
    gone = table(spark, d, "customer").filter("c_nationkey % 5 = 2").select(c("c_custkey").alias("o_custkey"), F.lit(True).alias("gone"))
    met = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(gone, "o_custkey", "left")
    return met.select("o_orderkey", F.when(c("gone").isNull(), c("o_custkey")).alias("tenant"), ((c("o_orderstatus") == "O") & c("gone").isNull()).alias("key_kept"))


@query("""SELECT page_id, CASE kind WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.png' WHEN 'image/webp' THEN '.webp' ELSE '' END AS extension, replace(replace(url, 'I', '1'), 'l', '1') AS digits, '1970-01-01T00:00:00Z' AS processed_at
FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'text/html' END AS kind FROM pages)""")
def upload_names(spark, d):
    k = c("page_id") % 4
    kind = F.when(k == 0, "image/jpeg").when(k == 1, "image/png").when(k == 2, "image/webp").otherwise("text/html")
    return table(spark, d, "pages").select("page_id", T.extension(kind).alias("extension"), T.as_digits(c("url")).alias("digits"), F.lit(T.PROCESSED_AT).alias("processed_at"))


#: What ends a file's name, in the order in which it is taken off, and the sets that may follow a card's name, in the order in which they are looked for.
NAME_ENDS = ("-[a-z]{2,4}-[0-9]+$", "-[0-9]+$", "-[a-z0-9]+[0-9]{4}[a-z0-9]*$")
SET_MARKERS = (
    "base-set", "jungle", "fossil", "team-rocket", "gym-heroes", "gym-challenge", "neo-genesis", "neo-discovery", "neo-revelation", "neo-destiny", "expedition", "aquapolis", "skyridge", "ruby-sapphire",
    "sandstorm", "dragon", "magma-aqua", "hidden-legends", "firered-leafgreen", "team-rocket-returns", "deoxys", "emerald", "unseen-forces", "delta-species", "legend-maker", "holon-phantoms", "crystal-guardians",
    "dragon-frontiers", "power-keepers", "diamond-pearl", "mysterious-treasures", "secret-wonders", "great-encounters", "majestic-dawn", "legends-awakened", "stormfront", "platinum", "rising-rivals", "supreme-victors", "arceus",
    "heartgold-soulsilver", "unleashed", "undaunted", "triumphant", "call-of-legends", "black-white", "emerging-powers", "noble-victories", "next-destinies", "dark-explorers", "dragons-exalted", "boundaries-crossed",
    "plasma-storm", "plasma-freeze", "plasma-blast", "legendary-treasures", "x-y", "flashfire", "furious-fists", "phantom-forces", "primal-clash", "roaring-skies", "ancient-origins", "breakthrough", "breakpoint",
    "generations", "fates-collide", "steam-siege", "evolutions", "sun-moon", "guardians-rising", "burning-shadows", "shining-legends", "crimson-invasion", "ultra-prism", "forbidden-light", "celestial-storm",
    "dragon-majesty", "lost-thunder", "team-up", "unbroken-bonds", "unified-minds", "hidden-fates", "cosmic-eclipse", "sword-shield",
)


def expected_name(file_name: Column) -> Column:
    """The name a file name states: without extension and NAME_ENDS, up to the first of SET_MARKERS in their order, words in title case; null if it is too short or without letters."""
    stem = F.regexp_replace(file_name, "(?<=[^.])\\.[^.]*$", "")
    for end in NAME_ENDS:
        stem = F.regexp_replace(stem, f"(?i){end}", "")
    # the marker that comes first in the list, if it doesn't begin the name
    found = lambda x: F.get(F.filter(F.array(*map(F.lit, SET_MARKERS)), lambda m: F.instr(F.lower(x), m) > 1), F.lit(0))
    cut = F.transform(F.array(stem), lambda x: F.transform(F.array(found(x)), lambda m: F.when(m.isNull(), x).otherwise(F.regexp_replace(x.substr(F.lit(1), F.instr(F.lower(x), m) - 1), "-+$", "")))[0])[0]
    name = F.array_join(F.transform(F.split(cut, "-"), N.capitalised), " ")
    return F.when((F.length(name) >= 2) & name.rlike("\\p{L}"), name)


_FILE = """CASE p_size % 6 WHEN 0 THEN 'base' || p_size || '-' || (p_partkey % 9999) || '.png' WHEN 1 THEN replace(p_name, ' ', '-') || '-team-rocket-tr-' || p_size || '.jpg' WHEN 2 THEN upper(replace(p_name, ' ', '-')) || '-Dragon-frontiers-' || p_size || '.JPEG'
  WHEN 3 THEN replace(p_name, ' ', '-') || '-ab12345c.webp' WHEN 4 THEN 'jungle-' || replace(p_name, ' ', '-') || '-sword-shield.png' ELSE p_size || '.png' END"""


@query(f"""
WITH f AS (SELECT p_partkey, {_FILE} AS f FROM part), s AS (SELECT p_partkey, f, {"regexp_replace(" * 3}regexp_replace(f, '\\.[^.]*$', ''), {", '', 'i'), ".join(f"'{e}'" for e in NAME_ENDS)}, '', 'i') AS s FROM f),
m AS (SELECT *, list_filter({list(SET_MARKERS)}, lambda m: instr(lower(s), m) > 1)[1] AS m FROM s),
n AS (SELECT p_partkey, f, array_to_string(list_transform(string_split(CASE WHEN m IS NULL THEN s ELSE rtrim(substr(s, 1, instr(lower(s), m) - 1), '-') END, '-'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS n FROM m)
SELECT p_partkey, CASE WHEN length(n) >= 2 AND regexp_matches(n, '[A-Za-z]') THEN n END AS expected, CASE WHEN regexp_matches(f, '^([a-z0-9]+)-([0-9]{{1,4}})\\.(png|jpg|jpeg|webp)$') THEN CAST(regexp_extract(f, '^([a-z0-9]+)-([0-9]{{1,4}})\\.', 2) AS INT) END AS number FROM n""")
def expected_from_file(spark, d):
    """Names and numbers that files of six kinds of names state."""
    f, dashed = c("p_size").cast("string"), F.replace("p_name", F.lit(" "), F.lit("-"))
    kinds = [
        F.concat(F.lit("base"), f, F.lit("-"), (c("p_partkey") % 9999).cast("string"), F.lit(".png")), F.concat(dashed, F.lit("-team-rocket-tr-"), f, F.lit(".jpg")), F.concat(F.upper(dashed), F.lit("-Dragon-frontiers-"), f, F.lit(".JPEG")),
        F.concat(dashed, F.lit("-ab12345c.webp")), F.concat(F.lit("jungle-"), dashed, F.lit("-sword-shield.png")), F.concat(f, F.lit(".png")),
    ]
    files = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*kinds), (c("p_size") % 6 + 1).cast("int")).alias("f"))
    return files.select("p_partkey", expected_name(c("f")).alias("expected"), T.file_key(c("f"))["number"].alias("number"))


@query(f"""
SELECT {KEYS}, CASE WHEN s >= 0.75 THEN 'clear wear' WHEN s >= 0.25 THEN 'some wear' ELSE 'clean' END || ' at ' || CASE WHEN l_discount >= l_tax THEN 'top left' ELSE 'top right' END AS observation,
  coalesce(nullif(concat_ws('; ', CASE WHEN l_discount > 0.05 THEN 'top left: ' || printf('%.1f', l_discount * 100) || '%' END, CASE WHEN l_tax > 0.05 THEN 'top right: ' || printf('%.1f', l_tax * 100) || '%' END), ''), 'nothing found') AS evidence
FROM (SELECT *, greatest(l_discount, l_tax) * 10 AS s FROM lineitem)""")
def signal_texts(spark, d):
    parts = F.array(F.struct(F.lit("top_left").alias("name"), c("l_discount").alias("w")), F.struct(F.lit("top_right").alias("name"), c("l_tax").alias("w")))
    s = F.greatest("l_discount", "l_tax") * 10
    first = F.when(c("l_discount") >= c("l_tax"), "top_left").otherwise("top_right")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["w"] > 0.05), lambda p: F.concat(T.part_name(p["name"]), F.lit(": "), F.format_string("%.1f", p["w"] * 100), F.lit("%"))), "; ")
    return table(spark, d, "lineitem").select(*line_key(), F.concat(S.ladder(s, [(0.75, "clear wear"), (0.25, "some wear")], "clean"), F.lit(" at "), T.part_name(first)).alias("observation"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("nothing found")).alias("evidence"))


@query(f"""SELECT {KEYS}, round(greatest(0, least(a1, b1) - greatest(a0, b0))::DOUBLE / greatest(1, least(a1 - a0, b1 - b0)), 6) AS overlap FROM (SELECT *, l_partkey % 100 AS a0, l_partkey % 100 + 30 AS a1, l_suppkey % 100 AS b0, l_suppkey % 100 + 20 + l_linenumber AS b1 FROM lineitem)""")
def box_overlap(spark, d):
    a0, b0 = c("l_partkey") % 100, c("l_suppkey") % 100
    return table(spark, d, "lineitem").select(*line_key(), F.round(S.overlap_1d(a0, a0 + 30, b0, b0 + 20 + c("l_linenumber")), 6).alias("overlap"))


#: Reading regions in the order in which they are tried.
ROUTES = {"corner": ["BL_tight", "BL_wide", "BR_tight", "BR_wide"], "vintage": ["BR_tight", "BR_wide"], "special": ["BL_tight", "BL_wide", "BR_tight", "BR_wide"], "modern": ["BR_tight", "BR_wide", "BL_tight", "BL_wide"]}


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 'corner' WHEN p_type = 'PROMO' THEN 'vintage' WHEN p_type = 'SMALL' THEN 'special' ELSE 'modern' END AS route FROM part)
SELECT p_partkey, route, unnest(CASE route WHEN 'vintage' THEN ['BR_tight', 'BR_wide'] WHEN 'modern' THEN ['BR_tight', 'BR_wide', 'BL_tight', 'BL_wide'] ELSE ['BL_tight', 'BL_wide', 'BR_tight', 'BR_wide'] END) AS region,
  unnest(range(1, CASE route WHEN 'vintage' THEN 3 ELSE 5 END)) AS ord FROM r""")
def region_routes(spark, d):
    dim = spark.createDataFrame([(k, i, r) for k, v in ROUTES.items() for i, r in enumerate(v, 1)], "route string, ord long, region string")
    route = F.when(c("p_size") % 4 < 2, "corner").when(c("p_type") == "PROMO", "vintage").when(c("p_type") == "SMALL", "special").otherwise("modern")
    return table(spark, d, "part").select("p_partkey", route.alias("route")).join(F.broadcast(dim), "route").select("p_partkey", "route", "region", "ord")  # a fixed list


@query("""SELECT event_id, concat_ws(':', 'ocr_extraction', substr(sha256(props), 1, 16), CASE event_type WHEN 'view' THEN 'BR_tight' ELSE 'none' END, CASE WHEN value > 50 THEN 'warp_strict' ELSE 'warp_not_found' END) AS match_method, strftime(ts + INTERVAL 900 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM events""")
def match_methods(spark, d):
    method = F.concat_ws(":", F.lit("ocr_extraction"), F.substring(F.sha2("props", 256), 1, 16), F.when(c("event_type") == "view", "BR_tight").otherwise("none"), F.when(c("value") > 50, "warp_strict").otherwise("warp_not_found"))
    return table(spark, d, "events").select("event_id", method.alias("match_method"), F.date_format(c("ts").cast("timestamp") + F.expr("INTERVAL 900 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("expires_at"))


#: Lines of orders that one task sorts.
INK_ROWS = 250_000


def _islands(spark, d) -> DataFrame:
    """l_orderkey, x, island: the columns of ink of an order, each once, and how many gaps wider than 15 lie before, the order's start included.

    Lines are dealt out by order and count, so that a task's sorts and hash tables are as large however many lines there are.
    """
    x = R.spread(table(spark, d, "lineitem").select("l_orderkey", (c("l_partkey") % 200).alias("x")), "l_orderkey", INK_ROWS).distinct()
    order = Window.partitionBy("l_orderkey").orderBy("x")
    gap = F.coalesce((c("x") - F.lag("x").over(order) > 15).cast("long"), F.lit(1))
    return x.withColumn("gap", gap).withColumn("island", F.sum("gap").over(order))


@query("""
WITH g AS (SELECT l_orderkey, x, lag(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS p FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey % 200 AS BIGINT) AS x FROM lineitem)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR x - p > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x) AS island FROM g)
SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(x) AS x0, max(x) AS x1, count(*) AS n FROM i GROUP BY l_orderkey, island""")
def ink_islands(spark, d):
    return _islands(spark, d).groupBy("l_orderkey", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag AS pipeline, count(*) AS total, count(*) FILTER (WHERE l_discount >= 0.04) AS success, round(100.0 * count(*) FILTER (WHERE l_discount >= 0.04) / greatest(count(*), 1), 2) AS success_pct, count(*) FILTER (WHERE l_discount < 0.04 AND l_tax > 0.06) AS best_effort FROM lineitem GROUP BY l_returnflag""")
def warp_success(spark, d):
    good = c("l_discount") >= 0.04
    return table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("pipeline")).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.round(100.0 * F.count_if(good) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("success_pct"), F.count_if(~good & (c("l_tax") > 0.06)).alias("best_effort"))


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 97 AS x1, l_suppkey % 89 AS y1, l_partkey % 97 + l_quantity AS x2, l_suppkey % 89 + l_linenumber AS y2, l_returnflag = 'R' AS t FROM lineitem),
k AS (SELECT l_orderkey, t, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, least(abs(x2 - x1), abs(y2 - y1)) AS short FROM s),
o AS (SELECT l_orderkey, bool_or(t) AS textured, count(*) FILTER (WHERE short / len > 0.1 OR len > 60) AS n FROM k GROUP BY l_orderkey)
SELECT l_orderkey, textured, CASE WHEN textured AND n >= 3 THEN 0 ELSE n END AS scratches FROM o""")
def scratch_filter(spark, d):
    x1, y1 = c("l_partkey") % 97, c("l_suppkey") % 89
    seg = table(spark, d, "lineitem").select("l_orderkey", x1.alias("x1"), y1.alias("y1"), (x1 + c("l_quantity")).alias("x2"), (y1 + c("l_linenumber")).alias("y2"), (c("l_returnflag") == "R").alias("t")).distinct()
    dx, dy = F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1"))
    length = F.sqrt(dx * dx + dy * dy)
    per = seg.groupBy("l_orderkey").agg(F.bool_or("t").alias("textured"), F.count_if((F.least(dx, dy) / length > 0.1) | (length > 60)).alias("n"))
    return per.select("l_orderkey", "textured", F.when(c("textured") & (c("n") >= 3), F.lit(0)).otherwise(c("n")).alias("scratches"))


@query(_LIMIT.format(width=86400, limit=3).replace("SELECT event_id, user_id, bucket, place, place <= 3 AS allowed,", "SELECT event_id, user_id, bucket, place <= 3 AS allowed --").split("--")[0] + " FROM b")
def stream_rate_limit(spark, d):
    """The rate limit kept by a stateful stream over all events, as far as they are there."""
    return Q.limited_so_far(spark, f"{d}/{{events.parquet}}", 3, 86400).select("event_id", "user_id", "bucket", "allowed")


_Q = lambda x: "'" + x.replace("'", "''") + "'"
_SAID = lambda severity, texts: f"CASE WHEN {severity} < 0.25 THEN {texts[0]} WHEN {severity} < 0.5 THEN {texts[1]} WHEN {severity} < 0.75 THEN {texts[2]} ELSE {texts[3]} END"


@query(f"""
WITH v AS (SELECT {KEYS}, l_quantity * 2 AS lr, 50 + l_tax * 100 AS tb, 6 + l_linenumber AS grade, l_discount * 10 AS s, l_discount AS a, l_tax AS b, l_tax * 10 AS chip, CAST(l_suppkey % 3 AS INT) AS n,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS method, CASE WHEN greatest(l_discount, l_tax) > 0 THEN CASE WHEN l_discount >= l_tax THEN 'top left' ELSE 'top right' END END AS worst FROM lineitem)
SELECT {KEYS}, CASE {' '.join(f"WHEN grade >= {k} THEN printf({_Q(t)}, lr, tb)" for k, t in O.CENTERING)} ELSE printf({_Q(O.CENTERING_WORST)}, lr, tb) END AS centering,
  printf({_Q(O.CENTERING_EVIDENCE)}, lr, tb, coalesce(method, 'unknown')) AS centering_evidence,
  {_SAID("s", [_Q(O.CORNERS[0]), *(f"printf({_Q(t)}, coalesce(worst, '{x}'))" for t, x in zip(O.CORNERS[1:], ("corners", "multiple corners", "multiple corners")))])} AS corners,
  CASE WHEN a * 100 > 5 OR b * 100 > 5 THEN concat_ws('; ', CASE WHEN a * 100 > 5 THEN printf('top left: %.1f%% whitening', a * 100) END, CASE WHEN b * 100 > 5 THEN printf('top right: %.1f%% whitening', b * 100) END) ELSE {_Q(O.NO_WHITENING)} END AS corners_evidence,
  {_SAID("s", [_Q(O.EDGES[0]), *(f"printf({_Q(t)}, coalesce(replace(worst, 'top ', ''), '{x}'))" for t, x in zip(O.EDGES[1:], ("edges", "multiple edges", "multiple edges")))])} AS edges,
  CASE WHEN a * 100 > 5 OR chip * 100 > 20 THEN printf('left: whitening %.1f%%, chipping %.0f%%', a * 100, chip * 100) ELSE {_Q(O.EVEN_EDGES)} END AS edges_evidence,
  {_SAID("s", [_Q(O.SURFACE_CLEAN), *(f"CASE WHEN n > 0 THEN printf({_Q(a)}, n) ELSE {_Q(b)} END" for a, b in zip(O.SURFACE_SCRATCHED, O.SURFACE_WORN))])} AS surface,
  CASE WHEN n > 0 THEN printf('%d linear artifacts detected; ', n) ELSE '' END || printf('texture variance %.1f', lr) AS surface_evidence FROM v""")
def observation_texts(spark, d):
    """What is said of each of the four signals, and the evidence, for measures taken from the lines."""
    a, b, s = c("l_discount"), c("l_tax"), c("l_discount") * 10
    lr, tb, n = c("l_quantity") * 2, 50 + b * 100, (c("l_suppkey") % 3).cast("int")
    corners = F.array(F.struct(F.lit("top_left").alias("name"), a.alias("whitening")), F.struct(F.lit("top_right").alias("name"), b.alias("whitening")))
    edges = F.array(F.struct(F.lit("left").alias("name"), a.alias("whitening"), (b * 10).alias("chipping")))
    worst = O.worst_of(corners, lambda p: p["whitening"])
    return table(spark, d, "lineitem").select(
        *line_key(), O.centering(6 + c("l_linenumber"), lr, tb).alias("centering"), O.centering_evidence(lr, tb, F.nullif(c("l_returnflag"), F.lit("N"))).alias("centering_evidence"),
        O.corners(s, worst).alias("corners"), O.corners_evidence(corners).alias("corners_evidence"), O.edges(s, F.replace(worst, F.lit("top "), F.lit(""))).alias("edges"), O.edges_evidence(edges).alias("edges_evidence"),
        O.surface(s, n).alias("surface"), O.surface_evidence(n, lr).alias("surface_evidence"),
    )


#: Pieces of request bodies: every field in several forms, right and wrong, that are combined by the key.
_PIECES = {
    "card": ['"card_type":"pokemon",', '"card_type":"trainer",', '"card_type":"energy",', '"card_type":"coin",', '"card_type":7,', "", '"card_type":"pokemon",', '"card_type":null,'],
    "front": ['{"encoding":"base64","data":"QUJD"}', '{"data":"QUJDRA==","encoding":"base64","more":[1]}', '{"encoding":"url","data":"https://x/y"}', '{"encoding":"hex","data":"00"}', '{"encoding":"base64","data":""}', '{"encoding":"base64","data":"A*"}', '{"encoding":"base64"}', '"QUJD"', "null", '{"encoding":"url","data":"  "}', '{"encoding":"base64","data":"QQ=="}'],
    "back": ['"back_image":{"encoding":"base64","data":"QUI="},', '"back_image":{"encoding":"url","data":"https://b"},', "", '"back_image":{"encoding":"base64","data":"QQ=="},', '"back_image":null,'],
    "kind": ['"kind":"front_image",', '"kind":"back_image",', '"kind":"side",', "", '"kind":"front_image",'],
    "mime": ['"content_type":"image/png",', '"content_type":"image/jpeg",', '"content_type":"text/plain",', '"content_type":"",', '"content_type":3,', '"content_type":"image/webp",'],
}
_STEPS = {"card": 3, "front": 5, "back": 7, "kind": 11, "mime": 13}  # a key takes piece (key * step + key // 8) % number of pieces


def _bodies_in_sql() -> str:
    """The same bodies in SQL."""
    piece = {k: f"{[x.replace(chr(39), chr(39) * 2) for x in v]}[1 + (event_id * {_STEPS[k]} + event_id // 8) % {len(v)}]" for k, v in _PIECES.items()}
    length = "'\"content_length\":' || CASE event_id % 7 WHEN 0 THEN '-1' WHEN 1 THEN '\"9\"' ELSE CAST(event_id * 30011 % 20000000 AS VARCHAR) END"
    return f"SELECT event_id, CASE WHEN event_id % 19 = 0 THEN '{{not json' WHEN event_id % 23 = 0 THEN '[' || event_id || ']' ELSE '{{' || {piece['card']} || {piece['back']} || {piece['kind']} || {piece['mime']} || {length} || ',\"front_image\":' || {piece['front']} || ',\"n\":' || event_id || '}}' END AS body FROM events"


def request_bodies(spark, d) -> DataFrame:
    """event_id, body: JSON texts of every combination of pieces, some broken."""
    key = c("event_id")
    piece = lambda k: F.element_at(F.array(*map(F.lit, _PIECES[k])), (1 + (key * _STEPS[k] + F.floor(key / 8)) % len(_PIECES[k])).cast("int"))
    length = F.concat(F.lit('"content_length":'), F.when(key % 7 == 0, "-1").when(key % 7 == 1, '"9"').otherwise((key * 30011 % 20_000_000).cast("string")))
    whole = F.concat(F.lit("{"), piece("card"), piece("back"), piece("kind"), piece("mime"), length, F.lit(',"front_image":'), piece("front"), F.lit(',"n":'), key.cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.when(key % 19 == 0, "{not json").when(key % 23 == 0, F.concat(F.lit("["), key.cast("string"), F.lit("]"))).otherwise(whole).alias("body"))


_TOLD = f"""WITH b AS ({_bodies_in_sql()}), j AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b),
t AS (SELECT *, j IS NULL OR json_type(j) <> 'OBJECT' AS bad, CASE WHEN json_type(j, '$.card_type') = 'VARCHAR' THEN j ->> '$.card_type' END AS card, json_type(j, '$.front_image') AS front, j ->> '$.front_image.encoding' AS enc, CASE WHEN json_type(j, '$.front_image.data') = 'VARCHAR' THEN j ->> '$.front_image.data' END AS data,
  j ->> '$.back_image.encoding' AS back_enc, CASE WHEN json_type(j, '$.back_image.data') = 'VARCHAR' THEN j ->> '$.back_image.data' END AS back_data, CASE WHEN json_type(j, '$.kind') = 'VARCHAR' THEN j ->> '$.kind' END AS kind, CASE WHEN json_type(j, '$.content_type') = 'VARCHAR' THEN j ->> '$.content_type' END AS mime,
  CASE WHEN json_type(j, '$.content_length') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(j ->> '$.content_length' AS DOUBLE) END AS size FROM j)"""


@query(f"""{_TOLD}, e AS (SELECT event_id, CASE WHEN bad THEN 'INVALID_REQUEST_FORMAT' WHEN coalesce(card, '') NOT IN ('pokemon', 'trainer', 'energy') THEN 'UNSUPPORTED_CARD_TYPE' WHEN coalesce(front, '') <> 'OBJECT' THEN 'MISSING_REQUIRED_FIELD' WHEN coalesce(enc, '') NOT IN ('base64', 'url') THEN 'INVALID_FIELD_VALUE'
  WHEN coalesce(data, '') = '' THEN 'MISSING_REQUIRED_FIELD' WHEN enc = 'base64' AND NOT regexp_full_match(data, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') THEN 'INVALID_IMAGE_FORMAT' END AS error_code FROM t)
SELECT event_id, error_code, CASE WHEN error_code IS NULL THEN 200 ELSE 400 END AS status FROM e""")
def request_cascade(spark, d):
    """The checks of an analysis request in turn; the first that fails decides."""
    code = S.analysis_error(c("body"))
    return request_bodies(spark, d).select("event_id", code.alias("error_code"), F.when(code.isNull(), 200).otherwise(400).alias("status"))


_FRONT = "coalesce(enc, '') NOT IN ('base64', 'url') OR trim(coalesce(data, '')) = ''"


@query(f"""{_TOLD} SELECT event_id, CASE WHEN bad OR coalesce(card, '') NOT IN ('pokemon', 'trainer', 'energy') THEN 'UNSUPPORTED_CARD_TYPE' WHEN {_FRONT} THEN 'MISSING_REQUIRED_FIELD' END AS job,
  CASE WHEN bad OR coalesce(card, '') <> 'pokemon' THEN 'UNSUPPORTED_CARD_TYPE' WHEN coalesce(enc, '') <> 'base64' OR coalesce(data, '') = '' OR coalesce(back_enc, '') <> 'base64' OR coalesce(back_data, '') = '' THEN 'MISSING_REQUIRED_FIELD' END AS grade,
  CASE WHEN bad OR coalesce(kind, '') NOT IN ('front_image', 'back_image') OR coalesce(mime, '') = '' THEN 'MISSING_REQUIRED_FIELD' WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'INVALID_REQUEST_FORMAT' WHEN size IS NULL OR size <= 0 THEN 'MISSING_REQUIRED_FIELD' WHEN size > 12582912 THEN 'INVALID_REQUEST_FORMAT' END AS upload FROM t""")
def gateway_checks(spark, d):
    """What the gateway answers to a body sent as a job, a grading or an upload; null where it passes."""
    return request_bodies(spark, d).select("event_id", S.job_error(c("body")).alias("job"), S.grade_error(c("body")).alias("grade"), S.upload_request_error(c("body")).alias("upload"))


@query(f"""
WITH {LEX}, r AS (SELECT p_partkey, p_name, p_size, {_READ} AS t FROM part),
x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(t, 'o', '0') ELSE t END AS t FROM r),
k AS (SELECT p_partkey, t, list_filter([t, CASE WHEN contains(lower(t), '0') THEN replace(lower(t), '0', 'o') END, CASE WHEN contains(lower(t), '1') THEN replace(lower(t), '1', 'l') END, CASE WHEN contains(lower(t), '5') THEN replace(lower(t), '5', 's') END, CASE WHEN contains(lower(t), '8') THEN replace(lower(t), '8', 'b') END, CASE WHEN contains(lower(t), 'rn') THEN replace(lower(t), 'rn', 'm') END, CASE WHEN contains(lower(t), 'cl') THEN replace(lower(t), 'cl', 'd') END, CASE WHEN contains(lower(t), 'li') THEN replace(lower(t), 'li', 'h') END, CASE WHEN contains(lower(t), 'vv') THEN replace(lower(t), 'vv', 'w') END],
  lambda y: y IS NOT NULL AND len(list_filter(string_split(y, ' '), lambda w: list_contains(names, w))) > 0) AS good FROM x, lex)
SELECT p_partkey, coalesce(good[1], t) AS text, CASE WHEN contains(lower(t), 'tool') THEN 'tool' WHEN contains(lower(t), 'old') THEN 'old' WHEN contains(lower(t), 'gear') THEN 'gear' END AS subtype FROM k""")
def ocr_corrections(spark, d):
    """Readings with a confusion undone where that makes a known name of a word, and the first subtype in order that they hold."""
    t = F.when(c("p_size") % 2 == 0, F.replace(c("t"), F.lit("o"), F.lit("0"))).otherwise(c("t"))
    read = readings(spark, d).select("p_partkey", t.alias("t"))
    names = lexicon(spark, d).filter("kind = 'name'").select(c("name").alias("word")).distinct()
    tried = read.select("p_partkey", F.posexplode(F.concat(F.array("t"), T.confusions(c("t")))).alias("k", "x"))
    good = tried.select("p_partkey", "k", "x", F.explode(F.split("x", " ")).alias("word")).join(names, "word").groupBy("p_partkey").agg(F.min_by("x", "k").alias("good"))
    return read.join(good, "p_partkey", "left").select("p_partkey", F.coalesce("good", "t").alias("text"), T.trainer_subtype(c("t"), ["tool", "old", "gear"]).alias("subtype"))


@query("""
WITH g AS (SELECT l_orderkey, x, lag(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS p FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey % 200 AS BIGINT) AS x FROM lineitem)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR x - p > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x) AS island FROM g), s AS (SELECT l_orderkey, island, min(x) AS a, max(x) + 1 AS b FROM i GROUP BY ALL),
k AS (SELECT l_orderkey, list([a, b] ORDER BY a) FILTER (WHERE b - a >= 8) AS kept, min(a) AS lo, max(b) AS hi FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN coalesce(len(kept), 0) <= 1 THEN 1 ELSE len(kept) END AS boxes, CASE WHEN coalesce(len(kept), 0) <= 1 THEN hi - lo ELSE list_sum(list_transform(kept, lambda x: x[2] - x[1]))::BIGINT END AS width FROM k""")
def wide_box_split(spark, d):
    """A wide box cut at gaps of ink: segments of at least 8 columns; the whole box if fewer than two are left."""
    parts = _islands(spark, d).groupBy("l_orderkey", "island").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    wide = c("b") - c("a") >= 8
    per = parts.groupBy("l_orderkey").agg(F.count_if(wide).alias("n"), F.sum(F.when(wide, c("b") - c("a"))).alias("kept"), (F.max("b") - F.min("a")).alias("whole"))
    return per.select("l_orderkey", F.when(c("n") <= 1, F.lit(1)).otherwise(c("n")).cast("long").alias("boxes"), F.when(c("n") <= 1, c("whole")).otherwise(c("kept")).alias("width"))


@query("""
WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice, [x FOR x IN [o_custkey % 7, o_custkey % 11, o_custkey % 13] IF x > 0] AS l, [x FOR x IN [o_orderkey % 5, o_orderkey % 9] IF x > 0] AS r FROM orders)
SELECT o_orderkey, CASE WHEN len(l) > 0 AND len(r) > 0 THEN list_median(l)::DOUBLE END AS left_width, CASE WHEN len(l) > 0 AND len(r) > 0 THEN list_median(r)::DOUBLE END AS right_width FROM w""")
def border_median(spark, d):
    """The median of the widths that were found on each side; null for all where a side has none."""
    found = lambda *x: F.array_sort(F.filter(F.array(*x), lambda v: v > 0))
    middle = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    k, o = c("o_custkey"), c("o_orderkey")
    sides = table(spark, d, "orders").select("o_orderkey", found(k % 7, k % 11, k % 13).alias("l"), found(o % 5, o % 9).alias("r"))
    both = (F.size("l") > 0) & (F.size("r") > 0)
    return sides.select("o_orderkey", F.when(both, middle(c("l"))).alias("left_width"), F.when(both, middle(c("r"))).alias("right_width"))


@query("""
SELECT p_type AS family, count(*) AS total, count(*) FILTER (WHERE p_size <= 25) AS hits, round(100.0 * count(*) FILTER (WHERE p_size <= 25) / greatest(count(*), 1), 2) AS hit_pct, count(*) FILTER (WHERE n_known AND p_size % 10 = p_partkey % 10) AS number_right
FROM (SELECT *, p_partkey % 3 <> 0 AS n_known FROM part) GROUP BY p_type""")
def family_stats(spark, d):
    """Rows, hits and their share of each template family, and how often a number agrees with the truth where there is one."""
    hit = c("p_size") <= 25
    known = table(spark, d, "part").withColumn("truth", F.when(c("p_partkey") % 3 != 0, c("p_partkey") % 10))
    return known.groupBy(c("p_type").alias("family")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits"), F.round(100.0 * F.count_if(hit) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("hit_pct"), F.count_if(c("p_size") % 10 == c("truth")).alias("number_right")
    )
