import json

from pyspark.sql import functions as F

from foilframe.plans import catalog
from foilframe.sources import readers, writers
from foilframe.streaming import queries


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,pred_label,confidence,method\nx.png,front,0.9,onnx\ny.png,back,oops,onnx\n")
    assert [r.confidence for r in readers.results_csv(spark, "classifier", str(tmp_path / "a.csv")).orderBy("filename").collect()] == [0.9, 0.0]
    (tmp_path / "sets.json").write_text(json.dumps([{"id": "b1", "name": "Base", "cardCount": {"official": 102, "total": "x"}}, {"id": "", "name": "no"}]))
    assert [tuple(r) for r in readers.card_sets(spark, str(tmp_path / "sets.json")).collect()] == [("b1", "Base", 102, None)]
    (tmp_path / "cache.json").write_text(json.dumps({"en:b1:4": {"name": "Charizard"}}))
    assert readers.card_cache(spark, str(tmp_path / "cache.json")).first().card_name == "Charizard"
    (tmp_path / "img").mkdir()
    for n in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / "img" / n).write_bytes(b"1")
    assert sorted(r.filename for r in readers.image_files(spark, str(tmp_path / "img")).collect()) == ["a.jpg", "b.PNG"]
    truth = spark.createDataFrame([("x", "A", 1), ("x", "B", 2), (" ", "C", 3), ("y", "", 4)], "filename string, card_name string, ord int")
    assert [tuple(r) for r in readers.truth_map(truth, "card_name").collect()] == [("x", "B")]


def test_stable_json_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ("z", 2))], "b int, a struct<y:string,x:int>")
    assert writers.stable_json(df).first().json == '{"a":{"x":2,"y":"z"},"b":1}'
    for _ in range(2):
        writers.append_csv(df.select("b"), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 2
    assert spark.range(1).select(writers.safe_name(F.lit("a/b c-1_.png"))).first()[0] == "abc-1_png"


def test_stream_agrees_with_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = queries.rate_limit(stream, 3, 86400).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.event_id, r.allowed) for r in spark.table("limited").collect()}
    want = {(r.event_id, r.allowed) for r in catalog.QUERIES["rate_limit_day"](spark, d).collect()}
    assert got == want


def test_job_states(spark, tmp_path):
    log = spark.createDataFrame([("j", 1, "pending", 1), ("j", 2, "completed", 2), ("k", 1, "processing", 1)], "job_id string, ts int, status string, seq int")
    log.write.parquet(str(tmp_path / "log"))
    queries.append_jobs(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = {r.job_id: r.completed_at for r in queries.job_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert rows == {"j": 2, "k": None}
