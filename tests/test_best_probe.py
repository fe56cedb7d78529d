"""The best probe of a card, found within its row."""

from pyspark.sql import functions as F

from foilframe.operators import relational as R
from foilframe.plans import catalog

D = "/root/testdata/sf0.001"


def test_ties_nulls_and_cards_without_a_number(spark):
    texts = {1: ["12/100", "12/100"], 2: [None, "x"], 3: [None, " 7 / 60 "], 4: [], 5: None, 6: ["9/0", "300/40"]}
    df = spark.createDataFrame([(k, [(i, "crop", 0, 7 + i, t) for i, t in enumerate(v)] if v is not None else None) for k, v in texts.items()], "id int, read array<struct<probe:int,crop:string,angle:int,mode:int,text:string>>")
    got = {r.id: r.b and tuple(r.b) for r in df.select("id", R.best_probe(F.col("read")).alias("b")).collect()}
    assert got == {1: ("12/100", "crop", 0, 7, "12/100", 0.9), 2: None, 3: ("7/60", "crop", 0, 8, "7 / 60", 0.9), 4: None, 5: None, 6: ("9/0", "crop", 0, 7, "9/0", 0.6)}


def test_probes_are_neither_sorted_nor_sent(spark):
    plan = catalog.QUERIES["vintage_sweep"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "Sort", "Window", "Join", "Generate"))
