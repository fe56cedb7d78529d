"""Caches, checkpoints and folders by class; broken lines; the cascade of request checks; texts of observations."""

from pyspark.sql import functions as F

from foilframe.functions import observations as O
from foilframe.functions import scores as S
from foilframe.functions import texts as T
from foilframe.sources import readers, writers


def test_read_through_and_checkpoints(spark):
    cache = spark.createDataFrame([("en", "1", "A")], "lang string, id string, name string")
    source = spark.createDataFrame([("en", "1", "other"), ("en", "2", "B"), ("fr", "2", "C")], "lang string, id string, name string")
    wanted = spark.createDataFrame([("en", "1"), ("en", "2"), ("en", "2"), ("en", "9"), (None, "2")], "lang string, id string")
    got = sorted(map(tuple, writers.read_through(cache, wanted, source, ["lang", "id"]).collect()))
    assert got == [("en", "1", "A"), ("en", "2", "B")]
    assert sorted(map(tuple, writers.merged_checkpoint(cache, source.limit(2), "id").select(*cache.columns).collect())) == [("en", "1", "other"), ("en", "2", "B")]


def test_classes_that_are_there_stay(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("front", "a"), ("back", "b")], "kind string, file string")
    for _ in range(2):
        writers.add_new_classes(rows, "kind", path)
    writers.add_new_classes(spark.createDataFrame([("front", "x"), ("review", "c")], "kind string, file string"), "kind", path)
    assert sorted((r.kind, r.file) for r in spark.read.parquet(path).collect()) == [("back", "b"), ("front", "a"), ("review", "c")]


def test_broken_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,card_name\nx.png,A\ny.png\nz.png,B,C,D\n")
    assert sorted(r.line for r in readers.broken_rows(spark, "truth_names", str(tmp_path / "a.csv")).collect()) == ["y.png", "z.png,B,C,D"]
    assert len(readers.results_csv(spark, "truth_names", str(tmp_path / "a.csv")).collect()) == 3


def test_analysis_requests(spark):
    cases = {
        None: "INVALID_REQUEST_FORMAT", "": "INVALID_REQUEST_FORMAT", "{": "INVALID_REQUEST_FORMAT", "[]": "INVALID_REQUEST_FORMAT", "5": "INVALID_REQUEST_FORMAT", "{}": "UNSUPPORTED_CARD_TYPE", '{"card_type":"Pokemon"}': "UNSUPPORTED_CARD_TYPE",
        '{"card_type":"energy"}': "MISSING_REQUIRED_FIELD", '{"card_type":"energy","front_image":null}': "MISSING_REQUIRED_FIELD", '{"card_type":"energy","front_image":{}}': "INVALID_FIELD_VALUE",
        '{"card_type":"energy","front_image":{"encoding":"url"}}': "MISSING_REQUIRED_FIELD", '{"card_type":"energy","front_image":{"encoding":"base64","data":"QUI="}}': None,
    }
    df = spark.createDataFrame([(i, b) for i, b in enumerate(cases)], "i int, b string")
    assert [r.e for r in df.select("i", S.analysis_error(F.col("b")).alias("e")).orderBy("i").collect()] == list(cases.values())


def test_observations(spark):
    r = spark.range(1).select(
        O.centering(F.lit(9.0), F.lit(52.25), F.lit(50.0)).alias("a"), O.corners(F.lit(0.6), F.lit(None).cast("string")).alias("b"), O.edges(F.lit(0.3), F.lit("left")).alias("c"), O.surface(F.lit(0.8), F.lit(3)).alias("d"), O.surface(F.lit(0.8), F.lit(0)).alias("e"),
        O.worst_of(F.array(F.struct(F.lit("top_left").alias("name"), F.lit(0.0).alias("s"))), lambda p: p["s"]).alias("f"), T.extension(F.lit("image/webp")).alias("g"), T.as_digits(F.lit("Il2")).alias("h"),
    ).first()
    assert r.a.startswith("Centering shows slight variance (LR 52.") and r.b == "Moderate corner wear detected at multiple corners, showing whitening"
    assert r.c.endswith("most noticeable along left") and r.d == "Surface has 3 notable scratches and visible wear" and r.e == "Surface shows significant wear, scuffs, or damage" and r.f is None and (r.g, r.h) == (".webp", "112")
