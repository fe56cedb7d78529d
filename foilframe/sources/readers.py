"""Sources: images, result files, manifests, set lists and caches, each with its schema stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_GLOB = "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}"
MAX_BYTES = 15 * 1024 * 1024

SCHEMAS = {
    "classifier": "filename string, pred_label string, confidence string, method string",
    "identity": "filename string, card_name string, card_number string, set_name string, confidence string, match_method string",
    "truth_names": "filename string, card_name string",
    "truth_numbers": "filename string, card_number string",
}
MANIFEST = "id string, url string, card_type string"
SETS = "id string, name string, cardCount struct<official:string,total:string>"
WARPS = "total int, success int, success_rate double, best_effort_count int, images array<struct<image:string,quad_found:boolean,method:string,pipeline:string,gate_mode:string,score:double,area_pct:double,aspect:double,rectangularity:double,center_dist:double,candidates_total:int,candidates_gated:int,reason:string,gate_failures:struct<aspect:int,area_min:int,area_max:int,rectangularity:int>,warp_success:boolean>>"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def image_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """path, filename, length and content of the image files of folders or globs; only files up to the cap are read on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    return files.filter(F.col("length") <= MAX_BYTES).select("path", file_name(F.col("path")).alias("filename"), "length", "content")


def decoded_images(spark: SparkSession, *paths: str) -> DataFrame:
    """path, height, width, data in RGB; the image source gives BGR rows, which are turned round byte by byte in Arrow batches."""
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def rgb(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for h, w, n, x in zip(height, width, channels, data):
            a = np.frombuffer(x, dtype=np.uint8).reshape(h, w, n)
            out.append((np.repeat(a, 3, axis=2) if n == 1 else a[:, :, 2::-1] if n >= 3 else a[:, :, :3]).tobytes())
        return pd.Series(out)

    images = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", IMAGE_GLOB).load(list(paths)).select("image.*")
    return images.select(F.col("origin").alias("path"), "height", "width", rgb("height", "width", "nChannels", "data").alias("data"))


def base64_bytes(column: Column) -> Column:
    """The bytes of a base64 text; null where it isn't one."""
    return F.try_to_binary(column, F.lit("base64"))


def results_csv(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """A results file by its header; a confidence that isn't a number is 0."""
    rows = spark.read.schema(SCHEMAS[kind]).option("header", True).option("enforceSchema", False).csv(list(paths))
    return rows.withColumn("confidence", F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))) if "confidence" in rows.columns else rows


def broken_rows(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """The lines of a results file that don't have the fields of their kind, with what was read of them, and whole as line; results_csv() reads them with nulls."""
    schema = SCHEMAS[kind] + ", line string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "line").csv(list(paths))
    return rows.filter("line IS NOT NULL")


def truth_map(rows: DataFrame, value: str) -> DataFrame:
    """filename and value, without blank ones; of rows with one name the last counts, by an ordinal column ord."""
    kept = rows.filter((F.trim("filename") != "") & (F.trim(value) != ""))
    return kept.groupBy("filename").agg(F.max_by(value, "ord").alias(value))


def card_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_id, name, official_total, total of a list of sets; totals that aren't whole numbers are null, sets without id are left out."""
    rows = spark.read.schema(SETS).option("multiLine", True).json(path)
    return rows.filter(F.coalesce("id", F.lit("")) != "").select(F.col("id").alias("set_id"), "name", F.col("cardCount.official").try_cast("int").alias("official_total"), F.col("cardCount.total").try_cast("int").alias("total"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def warp_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each image of warp summaries."""
    return spark.read.schema(WARPS).option("multiLine", True).json(list(paths)).select(F.inline("images"))


def card_cache(spark: SparkSession, path: str) -> DataFrame:
    """lang, set_id, local_id and the card as JSON, from a map of lang:set:local to cards."""
    text = spark.read.option("wholetext", True).text(path)
    cards = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "card"))
    part = F.split("k", ":")
    return cards.select(part[0].alias("lang"), part[1].alias("set_id"), part[2].alias("local_id"), "card", F.get_json_object("card", "$.name").alias("card_name"))


def http_events(rows: DataFrame, schema: str) -> DataFrame:
    """method, path and body of gateway events of either version; a base64 envelope is opened, a body that isn't JSON gives null."""
    body = F.when(F.col("isBase64Encoded"), F.decode(base64_bytes(F.col("body")), "UTF-8")).otherwise(F.col("body"))
    method = F.upper(F.coalesce(F.col("httpMethod"), F.col("requestContext.http.method"), F.lit("")))
    return rows.select(method.alias("method"), F.coalesce(F.col("path"), F.col("rawPath"), F.lit("/")).alias("path"), F.transform_keys("headers", lambda k, v: F.lower(k)).alias("headers"), F.from_json(body, schema).alias("body"))
