"""The registered queries of the card-image operators, bound to the driver's tables, each beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.functions import names as N
from foilframe.functions import scores as S
from foilframe.functions import texts as T
from foilframe.operators import lexicon as X
from foilframe.operators import patches as P
from foilframe.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows for which one task works out names or the best of many probes.
SCORED_ROWS = 5_000


def line_key() -> list[str]:
    return ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


# ---- rate limits, usage, jobs -------------------------------------------------

_LIMIT = """
WITH b AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / {width}) AS BIGINT) AS bucket,
  row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / {width}) AS BIGINT) ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, user_id, bucket, place, place <= {limit} AS allowed, CAST(greatest(0, {limit} - least(place - 1, {limit})) AS BIGINT) AS remaining, (bucket + 1) * {width} AS reset_at FROM b"""


def _limited(spark: SparkSession, d: str, width: int, limit: int) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", c("ts").cast("timestamp").alias("ts"))
    bucket = F.floor(F.unix_timestamp("ts") / width).cast("long")
    out = R.rate_limited(events, "user_id", bucket, [c("ts"), c("event_id")], limit)
    return out.select("event_id", "user_id", "bucket", c("place").cast("long").alias("place"), "allowed", c("remaining").cast("long").alias("remaining"), ((c("bucket") + 1) * width).alias("reset_at"))


@query(_LIMIT.format(width=60, limit=1))
def rate_limit_minute(spark, d):
    return _limited(spark, d, 60, 1)


@query(_LIMIT.format(width=86400, limit=3))
def rate_limit_day(spark, d):
    return _limited(spark, d, 86400, 3)


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) AS place FROM events),
s AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CASE WHEN place > 3 THEN 429 WHEN event_type = 'error' THEN 400 ELSE 200 END AS status, value FROM b)
SELECT user_id, day, count(*) AS requests, count(*) FILTER (WHERE status = 200) AS accepted, count(*) FILTER (WHERE status = 429) AS limited,
  count(*) FILTER (WHERE status = 400) AS failed, round(100.0 * count(*) FILTER (WHERE status >= 400) / count(*), 2) AS error_pct, round(sum(value), 2) AS value_sum FROM s GROUP BY user_id, day""")
def usage_rollup(spark, d):
    events = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    limited = R.rate_limited(events, "user_id", F.floor(F.unix_timestamp("ts") / 86400).cast("long"), [c("ts"), c("event_id")], 3)
    status = F.when(~c("allowed"), 429).when(c("event_type") == "error", 400).otherwise(200)
    rows = limited.select("user_id", c("bucket").alias("day"), status.alias("status"), "value")
    return rows.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(c("status") == 200).alias("accepted"), F.count_if(c("status") == 429).alias("limited"), F.count_if(c("status") == 400).alias("failed"),
        F.round(100.0 * F.count_if(c("status") >= 400) / F.count(F.lit(1)), 2).alias("error_pct"), F.round(F.sum("value"), 2).alias("value_sum"),
    )


@query("""
WITH t AS (SELECT unnest(list_concat(['type:' || event_type, 'band:' || CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'mid' ELSE 'low' END],
  CASE WHEN event_type = 'error' THEN ['reason:IMAGE_UNREADABLE', 'reason:CARD_TYPE_MISMATCH'] ELSE [] END)) AS tag FROM events)
SELECT tag, count(*) AS n FROM t GROUP BY tag""")
def reason_tag_counter(spark, d):
    reasons = F.when(c("event_type") == "error", F.array(F.lit("reason:IMAGE_UNREADABLE"), F.lit("reason:CARD_TYPE_MISMATCH"))).otherwise(F.array().cast("array<string>"))
    tags = F.concat(F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("band:"), S.ladder(c("value"), [(75, "high"), (25, "mid")], "low"))), reasons)
    return R.tag_counts(table(spark, d, "events"), tags)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id AS job_id, event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM r WHERE k = 1""")
def job_latest_state(spark, d):
    last = R.latest(table(spark, d, "events"), "user_id", [c("ts"), c("event_id")])
    kind = c("event_type")
    return last.select(c("user_id").alias("job_id"), "event_id", F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "error", "failed").otherwise("completed").alias("status"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus = 'F'""")
def tenant_visibility(spark, d):
    tenant = F.nullif(c("o_orderstatus"), F.lit("P"))  # P: no tenant
    return table(spark, d, "orders").filter(tenant.isNull() | (tenant == "F")).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def semi_valid_keys(spark, d):
    valid = table(spark, d, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(valid, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR) || event_type), 1, 24) || '_' || substr(sha256(event_type), 1, 8) AS request_id, sha256('pepper:' || CAST(user_id AS VARCHAR)) AS key_hash FROM events""")
def request_id(spark, d):
    return table(spark, d, "events").select("event_id", T.request_id(F.concat(c("event_id").cast("string"), "event_type"), c("event_type")).alias("request_id"), T.key_hash(F.lit("pepper"), c("user_id").cast("string")).alias("key_hash"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS body FROM events""")
def stable_json(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("body"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') IS NULL AS missing FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing"))


@query("""
SELECT event_id, CASE WHEN content_type IS NULL OR content_type NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'INVALID_CONTENT_TYPE'
  WHEN bytes IS NULL OR bytes <= 0 THEN 'EMPTY_BODY' WHEN bytes > 12582912 THEN 'TOO_LARGE' END AS error_code, path IN ('/v1/health') OR path LIKE '/docs/%' OR path = '/docs' AS exempt
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'image/png' WHEN 'click' THEN 'image/jpeg' WHEN 'purchase' THEN 'image/webp' WHEN 'signup' THEN 'text/plain' END AS content_type,
  CAST(floor(value * 200000) AS BIGINT) - 100000 AS bytes, CASE event_type WHEN 'view' THEN '/v1/health' WHEN 'click' THEN '/docs/a' ELSE '/v1/analyze' END AS path FROM events)""")
def request_checks(spark, d):
    kind = c("event_type")
    mime = F.when(kind == "view", "image/png").when(kind == "click", "image/jpeg").when(kind == "purchase", "image/webp").when(kind == "signup", "text/plain")
    path = F.when(kind == "view", "/v1/health?full=1").when(kind == "click", "/docs/a").otherwise("/v1/analyze")
    return table(spark, d, "events").select("event_id", S.upload_error(mime, F.floor(c("value") * 200000).cast("long") - 100000).alias("error_code"), S.exempt_path(path, ["/v1/health", "/docs"]).alias("exempt"))


# ---- severities and grades ----------------------------------------------------


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN s >= 0.75 THEN 'significant' WHEN s >= 0.5 THEN 'moderate' WHEN s >= 0.25 THEN 'minor' ELSE 'none' END AS label,
  round(least(1.0, CASE WHEN s >= 0.5 THEN 1.0 WHEN s >= 0.3 THEN 0.6 WHEN s >= 0.15 THEN 0.3 ELSE s / 0.15 * 0.3 END + CASE WHEN l_tax < 0.02 THEN 0.2 ELSE 0.0 END), 6) AS corner
FROM (SELECT *, l_discount * 10 AS s FROM lineitem)""")
def severity_bands(spark, d):
    s = c("l_discount") * 10
    return table(spark, d, "lineitem").select(*line_key(), S.severity_label(s).alias("label"), F.round(S.corner_severity(s, c("l_tax")), 6).alias("corner"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(chip, 6) AS chipping, round(least(1.0, greatest(CASE WHEN w >= 0.55 THEN 1.0 WHEN w >= 0.35 THEN 0.6 WHEN w >= 0.2 THEN 0.3 ELSE w / 0.2 * 0.3 END, chip)), 6) AS edge
FROM (SELECT *, l_discount * 8 AS w, CASE WHEN l_quantity >= 60 THEN 1.0 WHEN l_quantity >= 40 THEN 0.6 WHEN l_quantity >= 25 THEN 0.3 ELSE l_quantity / 25 * 0.3 END AS chip FROM lineitem)""")
def chipping_edge_severity(spark, d):
    chip = S.chipping_score(c("l_quantity"))
    return table(spark, d, "lineitem").select(*line_key(), F.round(chip, 6).alias("chipping"), F.round(S.edge_severity(c("l_discount") * 8, chip), 6).alias("edge"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(CASE WHEN n <= 0 THEN 0.0 WHEN n / m >= 10 THEN 1.0 WHEN n / m >= 5 THEN 0.6 WHEN n / m >= 2 THEN 0.3 ELSE n / m / 2 * 0.3 END, 6) AS scratch,
  round(CASE WHEN m = 2 THEN CASE WHEN s >= 1 THEN 1.0 WHEN s >= 0.5 THEN 0.6 WHEN s >= 0.2 THEN 0.3 ELSE s * 0.3 / 0.2 END
    ELSE CASE WHEN v >= 40 THEN 1.0 WHEN v >= 25 THEN 0.6 WHEN v >= 15 THEN 0.3 ELSE v / 15 * 0.3 END END, 6) AS scuff
FROM (SELECT *, l_linenumber - 1 AS n, CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 1.0 END AS m, CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 20 ELSE l_quantity END AS v,
  greatest(0.0, CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 20 ELSE l_quantity END - 1500) / 200 AS s FROM lineitem)""")
def scratch_scuff_severity(spark, d):
    textured = c("l_returnflag") == "R"
    v = F.when(textured, c("l_extendedprice") / 20).otherwise(c("l_quantity"))
    return table(spark, d, "lineitem").select(*line_key(), F.round(S.scratch_severity(c("l_linenumber") - 1, textured), 6).alias("scratch"), F.round(S.scuff_severity(v, textured), 6).alias("scuff"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(CASE WHEN v >= 500 THEN 0.0 WHEN v >= 300 THEN 0.1 WHEN v >= 100 THEN 0.1 + 0.4 * (300 - v) / 200 ELSE least(1.0, 0.5 + 0.5 * (100 - v) / 100) END, 6) AS blur,
  round(CASE WHEN g >= 0.15 THEN 1.0 WHEN g >= 0.08 THEN 0.5 + 0.5 * (g - 0.08) / 0.07 WHEN g >= 0.02 THEN 0.2 + 0.3 * (g - 0.02) / 0.06 ELSE g / 0.02 * 0.2 END, 6) AS glare,
  round(CASE WHEN k >= 0.25 THEN 1.0 WHEN k >= 0.15 THEN 0.5 + 0.5 * (k - 0.15) / 0.1 WHEN k >= 0.05 THEN 0.2 + 0.3 * (k - 0.05) / 0.1 ELSE k / 0.05 * 0.2 END, 6) AS occlusion,
  NOT (v < 100 OR g >= 0.15 OR k >= 0.25) AS usable,
  concat_ws(',', CASE WHEN v < 100 THEN 'too_blurry' WHEN CASE WHEN v >= 500 THEN 0.0 WHEN v >= 300 THEN 0.1 ELSE 0.1 + 0.4 * (300 - v) / 200 END > 0.3 THEN 'soft' END,
    CASE WHEN g >= 0.15 THEN 'strong_glare' WHEN g >= 0.08 THEN 'some_glare' END, CASE WHEN k >= 0.25 THEN 'too_dark' WHEN k >= 0.15 THEN 'dark_areas' END) AS reasons
FROM (SELECT *, l_quantity * 13 AS v, l_discount * 1.7 AS g, l_tax * 3.1 AS k FROM lineitem)""")
def photo_quality_scores(spark, d):
    v, g, k = c("l_quantity") * 13, c("l_discount") * 1.7, c("l_tax") * 3.1
    return table(spark, d, "lineitem").select(
        *line_key(), F.round(S.blur_score(v), 6).alias("blur"), F.round(S.glare_score(g), 6).alias("glare"), F.round(S.occlusion_score(k), 6).alias("occlusion"),
        S.photo_usable(v, g, k).alias("usable"), F.array_join(S.photo_reasons(v, g, k), ",").alias("reasons"),
    )


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_discount * 10 + l_tax * 10 + l_quantity / 50) / 3 AS w,
  CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 WHEN 4 THEN 0.55 WHEN 5 THEN 0.4 WHEN 6 THEN 0.3 ELSE 0.25 END::DOUBLE AS s FROM lineitem),
b AS (SELECT *, greatest(0.0, least(1.0, 0.05 + 0.9 * s - 0.6 * w)) AS top FROM a),
x AS (SELECT *, 2 * top AS x10, 1.2 * (0.9 - w) + 0.2 * s AS x9, 1 - 0.6 * s AS x8, 0.7 + 0.2 * w AS x7 FROM b),
e AS (SELECT *, exp(x10 - greatest(x10, x9, x8, x7)) AS e10, exp(x9 - greatest(x10, x9, x8, x7)) AS e9, exp(x8 - greatest(x10, x9, x8, x7)) AS e8, exp(x7 - greatest(x10, x9, x8, x7)) AS e7 FROM x)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(top, 6) AS p_psa10, round(e7 / (e10 + e9 + e8 + e7), 6) AS p7, round(e8 / (e10 + e9 + e8 + e7), 6) AS p8, round(e9 / (e10 + e9 + e8 + e7), 6) AS p9,
  round(e10 / (e10 + e9 + e8 + e7), 6) AS p10, round((7 * e7 + 8 * e8 + 9 * e9 + 10 * e10) / (e10 + e9 + e8 + e7), 6) AS expected, round(greatest(0.0, least(1.0, 0.3 + 0.4 * s + 0.3 * (1 - w))), 6) AS confidence FROM e""")
def grade_distribution(spark, d):
    grade = F.element_at(F.array(*map(F.lit, (10.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0))), F.least(c("l_linenumber"), F.lit(7)))
    cols = S.grade_columns(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50, grade)
    return table(spark, d, "lineitem").select(*line_key(), *[F.round(v, 6).alias(k) for k, v in cols.items()])


#: Grade, worst front and worst back side in percent.
CENTERING = [(10.0, 55.0, 75.0), (9.0, 60.0, 90.0), (8.0, 65.0, 90.0), (7.0, 70.0, 90.0), (6.0, 80.0, 90.0), (5.0, 85.0, 90.0), (4.0, 85.0, 90.0), (3.0, 90.0, 90.0), (2.0, 90.0, 90.0), (1.5, 90.0, 90.0)]


@query(f"""
WITH g(grade, front_max, back_max) AS (VALUES {', '.join(map(str, CENTERING))}),
a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity + 20 <= 0 THEN 50.0 ELSE greatest(l_quantity, 20) / (l_quantity + 20) * 100 END::DOUBLE AS front,
  greatest(50 + (l_discount * 8) * 50, 100 - (50 + (l_discount * 8) * 50))::DOUBLE AS back FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(front, 6) AS front, round(least(back, 100), 6) AS back,
  coalesce((SELECT max(g.grade) FROM g WHERE front <= front_max AND least(back, 100) <= back_max), 1.0)::DOUBLE AS grade,
  CASE WHEN coalesce((SELECT max(g.grade) FROM g WHERE front <= front_max AND least(back, 100) <= back_max), 1.0) >= 9 THEN 'none' WHEN coalesce((SELECT max(g.grade) FROM g WHERE front <= front_max AND least(back, 100) <= back_max), 1.0) >= 8 THEN 'minor'
    WHEN coalesce((SELECT max(g.grade) FROM g WHERE front <= front_max AND least(back, 100) <= back_max), 1.0) >= 7 THEN 'moderate' ELSE 'significant' END AS severity FROM a""")
def centering_max_grade(spark, d):
    rows = table(spark, d, "lineitem").select(*line_key(), S.side_ratio(c("l_quantity"), F.lit(20.0)).alias("front"), S.centre_ratio(c("l_discount") * 8).alias("back"))
    out = rows.withColumn("grade", R.highest_passing([c("front"), c("back")], CENTERING, 1.0))
    return out.select(*line_key(), F.round("front", 6).alias("front"), F.round("back", 6).alias("back"), "grade", S.centering_severity(c("grade")).alias("severity"))


@query("""
SELECT o_orderkey, coalesce(border, inner_art, 50.0)::DOUBLE AS ratio, CASE WHEN border IS NOT NULL THEN 'border' WHEN inner_art IS NOT NULL THEN 'inner' ELSE 'none' END AS method,
  CASE WHEN border IS NOT NULL AND inner_art IS NOT NULL THEN 0.9 WHEN border IS NOT NULL OR inner_art IS NOT NULL THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 10000 END AS border, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 20000 END AS inner_art FROM orders)""")
def centering_tiers(spark, d):
    border = F.when(c("o_orderstatus") != "F", c("o_totalprice") / 10000)
    inner = F.when(c("o_orderpriority") != "5-LOW", c("o_totalprice") / 20000)
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(border, inner, F.lit(50.0)).alias("ratio"), F.when(border.isNotNull(), "border").when(inner.isNotNull(), "inner").otherwise("none").alias("method"), S.centering_confidence(border.isNotNull(), inner.isNotNull()).alias("confidence"))


@query("""
WITH p AS (SELECT l_orderkey, unnest([1, 2, 3, 4]) AS ord, unnest(['top_left', 'top_right', 'bottom_left', 'bottom_right']) AS part, unnest([a, b, e, f]) AS v
  FROM (SELECT l_orderkey, max(l_discount) AS a, max(l_tax) AS b, max(l_discount * (l_linenumber % 2)) AS e, max(l_tax * (l_linenumber % 3)) AS f FROM lineitem GROUP BY l_orderkey)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, ord) AS k FROM p)
SELECT l_orderkey, replace(part, '_', ' ') AS worst_any, CASE WHEN v > 0 THEN replace(part, '_', ' ') ELSE 'corners' END AS worst_positive, round(v, 6) AS severity FROM r WHERE k = 1""")
def worst_part(spark, d):
    sides = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("a"), F.max("l_tax").alias("b"), F.max(c("l_discount") * (c("l_linenumber") % 2)).alias("e"), F.max(c("l_tax") * (c("l_linenumber") % 3)).alias("f"))
    named = [F.struct(F.lit(k).alias("ord"), F.lit(name).alias("part"), c(v).alias("v")) for k, (name, v) in enumerate(zip(("top_left", "top_right", "bottom_left", "bottom_right"), "abef"), 1)]
    best = R.first_best(sides.select("l_orderkey", F.inline(F.array(*named))), ["l_orderkey"], [F.desc("v"), c("ord")])
    return best.select("l_orderkey", T.part_name(c("part")).alias("worst_any"), F.when(c("v") > 0, T.part_name(c("part"))).otherwise("corners").alias("worst_positive"), F.round("v", 6).alias("severity"))


# ---- quads and gates ----------------------------------------------------------

_QUADS = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.5 + l_discount * 4 AS aspect, l_quantity / 50 AS area, 0.6 + l_tax * 5 AS rect, l_discount AS off FROM lineitem)"""
_SCORE = "0.4 * least(1.5 * sqrt(area), 1.0) + 0.4 * (1 - least(abs(aspect - 63.0::DOUBLE / 88) / (63.0::DOUBLE / 88), 1.0)) + 0.2 * least(rect, 1.0) - 0.15 * off"


def _quads(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (0.5 + c("l_discount") * 4).alias("aspect"), (c("l_quantity") / 50).alias("area"), (0.6 + c("l_tax") * 5).alias("rect"), c("l_discount").alias("off"))
    return q.withColumn("score", F.round(S.quad_score(c("area"), c("aspect"), c("rect"), c("off")), 6))


@query(f"""
WITH {_QUADS}, s AS (SELECT *, round({_SCORE}, 6) AS score, CASE WHEN aspect BETWEEN 0.66 AND 0.78 AND area BETWEEN 0.08 AND 0.97 AND rect >= 0.7 THEN 1 WHEN aspect BETWEEN 0.58 AND 0.84 AND area BETWEEN 0.08 AND 0.97 AND rect >= 0.7 THEN 2 END AS tier FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, score DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM s WHERE tier IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, CASE tier WHEN 1 THEN 'strict' ELSE 'relaxed' END AS gate_mode FROM r WHERE k = 1""")
def quad_gate_tiered(spark, d):
    g = (c("aspect"), c("area"), c("rect"))
    tiers = _quads(spark, d).withColumn("tier", F.when(S.quad_gates(*g, True), 1).when(S.quad_gates(*g, False), 2)).filter("tier is not null")
    best = R.first_best(tiers, ["l_orderkey"], [c("tier"), F.desc("score"), c("l_linenumber"), c("l_partkey"), c("l_suppkey")])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score", F.when(c("tier") == 1, "strict").otherwise("relaxed").alias("gate_mode"))


@query(f"""
WITH {_QUADS}, s AS (SELECT *, round({_SCORE}, 6) AS score, NOT aspect BETWEEN 0.58 AND 0.84 AS f1, area < 0.08 AS f2, area > 0.97 AS f3, rect < 0.7 AS f4 FROM q)
SELECT l_orderkey, count(*) AS candidates, count(*) FILTER (WHERE f1) AS aspect, count(*) FILTER (WHERE f2) AS area_min, count(*) FILTER (WHERE f3) AS area_max, count(*) FILTER (WHERE f4) AS rectangularity,
  max(score) FILTER (WHERE f1) AS closest_aspect, max(score) FILTER (WHERE f2) AS closest_area_min, max(score) FILTER (WHERE f3) AS closest_area_max, max(score) FILTER (WHERE f4) AS closest_rectangularity FROM s GROUP BY l_orderkey""")
def gate_failures(spark, d):
    flags = S.gate_flags(c("aspect"), c("area"), c("rect"))
    q = _quads(spark, d)
    return q.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(f).alias(k) for k, f in flags.items()], *[F.max(F.when(f, c("score"))).alias(f"closest_{k}") for k, f in flags.items()])


@query(f"""
WITH {_QUADS}, f AS (SELECT l_orderkey, count(*) FILTER (WHERE NOT aspect BETWEEN 0.58 AND 0.84) > 0 AS a, count(*) FILTER (WHERE area < 0.08) > 0 AS lo, count(*) FILTER (WHERE area > 0.97) > 0 AS hi, count(*) FILTER (WHERE rect < 0.7) > 0 AS r,
  count(*) FILTER (WHERE aspect BETWEEN 0.58 AND 0.84 AND area BETWEEN 0.08 AND 0.97 AND rect >= 0.7) AS ok FROM q GROUP BY l_orderkey),
p AS (SELECT CASE WHEN a::INT + lo::INT + hi::INT + r::INT > 1 THEN 'multiple' WHEN a THEN 'aspect_only' WHEN hi THEN 'area_max_only' WHEN lo THEN 'area_min_only' WHEN r THEN 'rect_only' ELSE 'no_candidates' END AS reason FROM f WHERE ok = 0)
SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 1) AS pct FROM p GROUP BY reason""")
def gate_primary_reason(spark, d):
    g = (c("aspect"), c("area"), c("rect"))
    flags = S.gate_flags(*g)
    per = _quads(spark, d).groupBy("l_orderkey").agg(*[(F.count_if(f) > 0).alias(k) for k, f in flags.items()], F.count_if(S.quad_gates(*g, False)).alias("ok")).filter("ok = 0")
    many = sum((c(k).cast("int") for k in flags), F.lit(0)) > 1
    reason = F.when(many, "multiple").when(c("aspect"), "aspect_only").when(c("area_max"), "area_max_only").when(c("area_min"), "area_min_only").when(c("rectangularity"), "rect_only").otherwise("no_candidates")
    counts = per.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", F.round(100.0 * c("n") / c("total"), 1).alias("pct"))  # a single row


@query(f"""
WITH {_QUADS}, s AS (SELECT *, round({_SCORE}, 6) AS score, CASE WHEN aspect < 0.58 THEN 'aspect_low' ELSE 'aspect_high' END AS reason FROM q
  WHERE area BETWEEN 0.08 AND 0.97 AND rect >= 0.7 AND ((aspect < 0.58 AND aspect >= 0.58 - 0.05) OR (aspect > 0.84 AND aspect <= 0.84 + 0.05))),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, reason, k FROM r WHERE k <= 3""")
def best_effort_quads(spark, d):
    near = _quads(spark, d).withColumn("reason", S.best_effort_reason(c("aspect"), c("area"), c("rect"))).filter("reason is not null")
    top = R.top_each(near, ["l_orderkey"], [F.desc("score"), c("l_linenumber"), c("l_partkey"), c("l_suppkey")], 3)
    return top.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score", "reason", c("rank").cast("long").alias("k"))


# ---- card numbers and names ---------------------------------------------------

_NT = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey % 600 AS INT) AS num, CAST(l_suppkey % 520 AS INT) AS total FROM lineitem"
_NSCORE = """greatest(0.0, least(1.0, 0.5 + CASE WHEN total BETWEEN 100 AND 250 THEN 0.35 WHEN total BETWEEN 50 AND 100 OR total BETWEEN 250 AND 350 THEN 0.25 WHEN total BETWEEN 20 AND 50 THEN 0.15 WHEN total < 20 OR total > 400 THEN -0.2 ELSE 0 END
  + CASE WHEN num <= total THEN 0.1 WHEN num <= total + 30 THEN 0.15 WHEN num <= total + 80 THEN 0.1 WHEN num <= total + 150 THEN 0.05 ELSE -0.15 END))"""


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*line_key(), (c("l_partkey") % 600).cast("int").alias("num"), (c("l_suppkey") % 520).cast("int").alias("total"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, num > 0 AND total BETWEEN 10 AND 500 AND num <= total + 150 AS plausible, round({_NSCORE}::DOUBLE, 6) AS score FROM ({_NT})""")
def number_plausibility(spark, d):
    return _numbers(spark, d).select(*line_key(), S.number_plausible(c("num"), c("total")).alias("plausible"), F.round(S.number_score(c("num"), c("total")), 6).alias("score"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(t, '([0-9]{1,3})\\s*/\\s*([0-9]{1,3})') THEN regexp_replace(regexp_extract(t, '([0-9]{1,3})\\s*/\\s*([0-9]{1,3})', 1), '^0+([0-9])', '\\1') || '/' || regexp_replace(regexp_extract(t, '([0-9]{1,3})\\s*/\\s*([0-9]{1,3})', 2), '^0+([0-9])', '\\1') END AS number,
  regexp_matches(t, '^([0-9]{1,3})\\s*/\\s*([0-9]{1,3})$') AS strict
FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE CASE WHEN p_size % 3 = 0 THEN 'No. ' ELSE '' END || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN p_size % 2 = 0 THEN ' / ' ELSE '/' END || p_size END AS t FROM part)""")
def number_parse(spark, d):
    n = F.lpad((c("p_partkey") % 1000).cast("string"), 3, "0")
    text = F.when(c("p_size") % 5 == 0, c("p_name")).otherwise(F.concat(F.when(c("p_size") % 3 == 0, "No. ").otherwise(""), n, F.when(c("p_size") % 2 == 0, " / ").otherwise("/"), c("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", T.parsed_number(c("t")).alias("number"), T.strict_number(c("t")).isNotNull().alias("strict"))


@query("""
WITH s AS (SELECT vec_id, list_avg(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m, CAST(vec_id % 300 AS INT) AS num, CAST(vec_id * 7 % 420 AS INT) AS total FROM embeddings)
SELECT vec_id, round(greatest(0.0, least(1.0, m + CASE WHEN total BETWEEN 50 AND 300 THEN 0.1 WHEN total BETWEEN 20 AND 50 OR total BETWEEN 300 AND 400 THEN 0.05 ELSE 0 END + CASE WHEN num <= total THEN 0.05 WHEN num <= total + 50 THEN 0.02 ELSE 0 END
  - CASE WHEN num > total + 100 THEN 0.1 ELSE 0 END - CASE WHEN total < 20 THEN 0.15 ELSE 0 END))::DOUBLE, 6) AS confidence FROM s""")
def number_confidence(spark, d):
    scores = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    num, total = (c("vec_id") % 300).cast("int"), (c("vec_id") * 7 % 420).cast("int")
    return table(spark, d, "embeddings").select("vec_id", F.round(S.number_confidence(mean, num, total), 6).alias("confidence"))


@query(f"""
WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey % 1000 AS VARCHAR) || '/' || CAST(l_suppkey % 400 AS VARCHAR) || CAST(l_linenumber AS VARCHAR) AS t FROM lineitem),
w AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, s, n, substr(t, s::INT, n::INT) AS v FROM g, range(1, 8) a(s), range(3, 8) b(n) WHERE s + n - 1 <= length(t)),
p AS (SELECT *, TRY_CAST(regexp_extract(v, '^([0-9]{{1,3}})/([0-9]{{1,3}})$', 1) AS INT) AS num, TRY_CAST(regexp_extract(v, '^([0-9]{{1,3}})/([0-9]{{1,3}})$', 2) AS INT) AS total FROM w),
k AS (SELECT *, round({_NSCORE}::DOUBLE, 6) AS score FROM p WHERE num > 0 AND total BETWEEN 10 AND 500 AND num <= total + 150),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY score DESC, s, n) AS z FROM k)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, v AS window_text, score FROM r WHERE z = 1""")
def number_window(spark, d):
    """The nine windows around a line's slash are compared within its row; a generator, as a filter on a column would make it twice."""
    glyphs = F.concat((c("l_partkey") % 1000).cast("string"), F.lit("/"), (c("l_suppkey") % 400).cast("string"), c("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").select(*line_key(), glyphs.alias("t"))
    return rows.select(*line_key(), F.explode(F.array(S.best_number_window(c("t")))).alias("best")).filter("best IS NOT NULL").select(*line_key(), "best.window_text", "best.score")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN t IS NULL AND o IS NULL THEN NULL WHEN t IS NULL THEN 'ocr' WHEN o IS NULL THEN 'template' WHEN o > t + 0.1 THEN 'ocr' WHEN family IN ('special', 'modern') AND o >= 0.9 AND l_partkey % 300 > l_suppkey % 300 THEN 'ocr' ELSE 'template' END AS winner,
  least(1.0, CASE WHEN family IN ('special', 'modern') AND coalesce(o, 0) >= 0.9 THEN 0.85 ELSE 0.8 END + CASE WHEN l_partkey % 300 >= 150 THEN 0.15 ELSE 0 END)::DOUBLE AS ocr_conf
FROM (SELECT *, nullif(l_discount * 10, 0) AS t, nullif(l_tax * 12, 0) AS o, CASE l_returnflag WHEN 'A' THEN 'vintage' WHEN 'N' THEN 'modern' ELSE 'special' END AS family FROM lineitem)""")
def arbitration(spark, d):
    t, o = F.nullif(c("l_discount") * 10, F.lit(0.0)), F.nullif(c("l_tax") * 12, F.lit(0.0))
    family = F.when(c("l_returnflag") == "A", "vintage").when(c("l_returnflag") == "N", "modern").otherwise("special")
    return table(spark, d, "lineitem").select(*line_key(), S.arbitrate(t, o, family, c("l_suppkey") % 300, c("l_partkey") % 300).alias("winner"), S.ocr_confidence(family, F.coalesce(o, F.lit(0.0)), c("l_partkey") % 300).alias("ocr_conf"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(least(0.9, greatest(0.5, 0.5 + (CASE WHEN total BETWEEN 20 AND 500 THEN 2.0 ELSE 0 END + CASE WHEN total >= 50 THEN 1.0 ELSE 0 END + CASE WHEN num > 0 THEN 0.5 ELSE 0 END
  - CASE WHEN num > total + 150 THEN 5.0 ELSE 0 END - CASE WHEN num BETWEEN 1900 AND 2099 THEN 5.0 ELSE 0 END - CASE WHEN total BETWEEN 1900 AND 2099 THEN 5.0 ELSE 0 END - 0.05 * abs(l_linenumber - 4)) / 5))::DOUBLE, 6) AS confidence
FROM (SELECT *, CAST(l_partkey % 600 AS INT) AS num, CAST(l_suppkey % 520 AS INT) AS total FROM lineitem)""")
def vintage_fallback(spark, d):
    num, total = (c("l_partkey") % 600).cast("int"), (c("l_suppkey") % 520).cast("int")
    return table(spark, d, "lineitem").select(*line_key(), F.round(S.vintage_confidence(num, total, c("l_linenumber") - 4), 6).alias("confidence"))


@query("""
WITH k AS (SELECT p_partkey, probe, p_partkey * 31 + probe * 17 AS seed, ['sub_0.2_0.15', 'sub_0.3_0.25', 'sub_0.35_0.3'][probe // 27 + 1] AS crop, CAST(probe // 3 % 9 * 3 - 12 AS INT) AS angle, [7, 8, 13][probe % 3 + 1]::INT AS mode FROM part, range(81) r(probe)),
t AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN seed % 3 = 0 THEN (seed % 700) || ' / ' || (seed % 613) WHEN seed % 3 = 1 THEN (seed % 99) || '/' END AS raw FROM k),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '([0-9]{1,3})\\s*/\\s*([0-9]{1,3})', 1), '') AS INT) AS num, TRY_CAST(nullif(regexp_extract(raw, '([0-9]{1,3})\\s*/\\s*([0-9]{1,3})', 2), '') AS INT) AS total FROM t),
s AS (SELECT *, CASE WHEN total BETWEEN 20 AND 500 THEN 2.0 ELSE 0 END + CASE WHEN total >= 50 THEN 1.0 ELSE 0 END + CASE WHEN num > 0 THEN 0.5 ELSE 0 END - CASE WHEN num > total + 150 THEN 5.0 ELSE 0 END - CASE WHEN num BETWEEN 1900 AND 2099 THEN 5.0 ELSE 0 END - CASE WHEN total BETWEEN 1900 AND 2099 THEN 5.0 ELSE 0 END - 0.05 * abs(angle) AS score FROM n WHERE num IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, probe) AS z FROM s)
SELECT p.p_partkey, num || '/' || total AS number, crop, angle, mode, trim(raw) AS raw, CASE WHEN score IS NOT NULL THEN round(least(0.9, greatest(0.5, 0.5 + score / 5))::DOUBLE, 6) END AS confidence FROM part p LEFT JOIN (SELECT * FROM b WHERE z = 1) b ON b.p_partkey = p.p_partkey""")
def vintage_sweep(spark, d):
    """All 81 probes of each part and the best number read; what a probe reads is made up from the key and the probe."""
    key = c("p_partkey")

    def text(seed):
        number = F.concat((seed % 700).cast("string"), F.lit(" / "), (seed % 613).cast("string"))
        return F.when(key % 9 == 0, "").when(seed % 3 == 0, number).when(seed % 3 == 1, F.concat((seed % 99).cast("string"), F.lit("/")))

    read = F.transform(R.every_probe(), lambda p: F.struct(p["probe"].alias("probe"), p["crop"].alias("crop"), p["angle"].alias("angle"), p["mode"].alias("mode"), T.bound(key * 31 + p["probe"] * 17, text).alias("text")))
    cards = R.spread(table(spark, d, "part").select("p_partkey"), "p_partkey", SCORED_ROWS)
    return cards.select("p_partkey", R.best_probe(read).alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, round(CASE WHEN length(coalesce(n, '')) BETWEEN 3 AND 50 THEN 0.5 WHEN length(coalesce(n, '')) > 0 THEN 0.2 ELSE 0 END + CASE WHEN coalesce(k, '') <> '' THEN 0.5 ELSE 0 END, 2)::DOUBLE AS confidence
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'AB' ELSE p_name END AS n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '4/102' END AS k FROM part)""")
def identity_confidence(spark, d):
    k = c("p_partkey")
    name, number = F.when(k % 7 == 0, None).when(k % 5 == 0, "AB").otherwise(c("p_name")), F.when(k % 3 != 0, "4/102")
    return table(spark, d, "part").select("p_partkey", S.identity_confidence(name, number).alias("confidence"))


@query("""
SELECT p_partkey, codes, codes = '' AS accepted, CASE WHEN codes = '' THEN p_name END AS identity FROM (SELECT p_partkey, p_name, concat_ws(',', CASE WHEN conf = 0 AND n = '' THEN 'IMAGE_UNREADABLE' END, CASE WHEN detected <> declared AND detected <> 'unknown' THEN 'CARD_TYPE_MISMATCH' END,
  CASE WHEN declared = 'energy' AND NOT contains(n, 'energy') THEN 'ENERGY_NAME_NOT_FOUND' END, CASE WHEN declared = 'trainer' AND length(n) < 3 THEN 'TRAINER_NAME_NOT_FOUND' END) AS codes
FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN p_name || ' energy' ELSE p_name END AS n, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE 0.5 END AS conf,
  CASE p_partkey % 3 WHEN 0 THEN 'pokemon' WHEN 1 THEN 'trainer' ELSE 'energy' END AS declared, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = 1 THEN 'pokemon' WHEN p_size % 4 = 2 THEN 'trainer' ELSE 'energy' END AS detected FROM part))""")
def gatekeeper(spark, d):
    k, z = c("p_partkey"), c("p_size") % 4
    name = F.when(k % 11 == 0, "").when(k % 4 == 0, F.concat("p_name", F.lit(" energy"))).otherwise(c("p_name"))
    declared = F.when(k % 3 == 0, "pokemon").when(k % 3 == 1, "trainer").otherwise("energy")
    detected = F.when(z == 0, "unknown").when(z == 1, "pokemon").when(z == 2, "trainer").otherwise("energy")
    codes = S.gatekeeper_codes(name, F.when(k % 11 == 0, 0.0).otherwise(0.5), detected, declared)
    return table(spark, d, "part").select("p_partkey", F.array_join(codes, ",").alias("codes"), (F.size(codes) == 0).alias("accepted"), F.when(F.size(codes) == 0, c("p_name")).alias("identity"))


@query("""
WITH s AS (SELECT min(p_partkey) AS set_id, CAST(p_size AS BIGINT) AS official, CAST(p_size + 50 AS BIGINT) AS total FROM part GROUP BY p_size),
k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 120 AS want FROM lineitem),
t1 AS (SELECT k.*, set_id, 1 AS tier FROM k JOIN s ON want = official), t2 AS (SELECT k.*, set_id, 2 AS tier FROM k JOIN s ON want = total WHERE want NOT IN (SELECT official FROM s))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, set_id, tier FROM t1 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, set_id, tier FROM t2""")
def set_lookup_tiered(spark, d):
    """Every line's set by official count, else by total; a set is the parts of one size."""
    sets = table(spark, d, "part").groupBy(c("p_size").cast("long").alias("official")).agg(F.min("p_partkey").alias("set_id")).withColumn("total", c("official") + 50)
    wanted = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_partkey") % 120).alias("want"))
    return R.tiered_lookup(wanted, "want", R.small(sets), ["official", "total"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "set_id", "tier")


@query("""
WITH s AS (SELECT p_partkey AS set_id, p_partkey // 2 * 4 AS official, p_partkey // 2 * 4 + CASE WHEN p_partkey % 2 = 1 THEN 4 ELSE 1 END AS total FROM part),
k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 2 + l_linenumber % 2 AS want FROM lineitem),
t1 AS (SELECT k.*, set_id, 1 AS tier FROM k JOIN s ON want = official), t2 AS (SELECT k.*, set_id, 2 AS tier FROM k JOIN s ON want = total WHERE want NOT IN (SELECT official FROM s))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, set_id, tier FROM t1 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, set_id, tier FROM t2""")
def set_lookup_every_line(spark, d):
    """set_lookup_tiered for every line: at most two sets share a count, so the result grows as the lines do."""
    k = c("p_partkey")
    official = F.floor(k / 2) * 4
    sets = table(spark, d, "part").select(k.alias("set_id"), official.alias("official"), (official + F.when(k % 2 == 1, 4).otherwise(1)).alias("total"))
    wanted = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_partkey") * 2 + c("l_linenumber") % 2).alias("want"))
    return R.tiered_lookup(wanted, "want", R.small(sets), ["official", "total"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "set_id", "tier")


@query("""
WITH l AS (SELECT o_orderkey, CAST(o_orderkey % 25 AS INT) AS k, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS seen FROM orders),
m AS (SELECT l.*, s_suppkey, s_name, row_number() OVER (PARTITION BY o_orderkey ORDER BY s_suppkey) AS t FROM l JOIN supplier ON k = s_nationkey),
g AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY s_suppkey) AS z FROM m WHERE t <= 40 AND (seen = '' OR contains(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '', 'g'), seen)))
SELECT l.o_orderkey, g.s_suppkey, g.s_name FROM l LEFT JOIN g ON l.o_orderkey = g.o_orderkey AND z = 1""")
def enrich_first_match(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", (c("o_orderkey") % 25).cast("int").alias("k"), F.when(c("o_orderkey") % 6 == 0, "").otherwise((c("o_orderkey") % 10).cast("string")).alias("seen"))
    cards = table(spark, d, "supplier").select(c("s_nationkey").alias("k"), "s_suppkey", "s_name", T.squashed(c("s_name")).alias("flat"))
    ok = lambda x: (c("seen") == "") | x["flat"].contains(c("seen"))
    return R.first_of_list(left, cards, ["k"], "s_suppkey", ok, 40).select("o_orderkey", "s_suppkey", "s_name")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY source, doc_id LIMIT 200""")
def resume_batch(spark, d):
    return R.resume(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id", [c("source"), c("doc_id")], 200)


@query("""SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END, d.lang) AS truth FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def truth_fallback(spark, d):
    truth = table(spark, d, "labels").select("doc_id", F.when(c("quality") == 1, "good").when(c("quality") == 0, "bad").alias("truth"))
    return R.with_fallback(table(spark, d, "documents").select("doc_id", "lang"), truth, "doc_id", "truth", c("lang")).select("doc_id", "truth")


@query("""
SELECT n_both AS n_both, total, n_a, n_b, round(100.0 * n_a / greatest(total, 1), 1) AS pct_a, round(100.0 * n_b / greatest(total, 1), 1) AS pct_b, round(100.0 * n_both / greatest(total, 1), 1) AS pct_both
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(lang, '') <> '') AS n_a, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_b, count(*) FILTER (WHERE coalesce(lang, '') <> '' AND l.doc_id IS NOT NULL) AS n_both FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def presence_stats(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.presence(joined, c("lang"), c("quality").cast("string"))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE lab = 'front') AS front, count(*) FILTER (WHERE lab = 'back') AS back, count(*) FILTER (WHERE lab <> 'front' OR conf < 0.7) AS low_or_not_front FROM (
  SELECT CASE WHEN quality = 1 THEN 'front' ELSE 'back' END AS lab, abs(embedding[1]::DOUBLE) * 4 AS conf FROM labels JOIN embeddings ON doc_id = vec_id)""")
def label_summary(spark, d):
    s = _labelled(spark, d)
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("lab") == "front").alias("front"), F.count_if(c("lab") == "back").alias("back"), F.count_if(S.low_or_not_front(c("lab"), c("conf"))).alias("low_or_not_front"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    met = table(spark, d, "labels").join(table(spark, d, "embeddings"), c("doc_id") == c("vec_id"))
    return met.select(F.when(c("quality") == 1, "front").otherwise("back").alias("lab"), (F.abs(c("embedding")[0].cast("double")) * 4).alias("conf"))


@query("""
SELECT split, count(*) AS n FROM (SELECT CASE WHEN lab = 'front' AND conf >= 0.9 THEN 'front' WHEN lab = 'back' AND conf >= 0.9 THEN 'back' ELSE 'review' END AS split FROM (
  SELECT CASE WHEN quality = 1 THEN 'front' ELSE 'back' END AS lab, abs(embedding[1]::DOUBLE) * 4 AS conf FROM labels JOIN embeddings ON doc_id = vec_id)) GROUP BY split""")
def triage_split(spark, d):
    return _labelled(spark, d).groupBy(S.triage(c("lab"), c("conf")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS region, count(*) AS attempts, count(*) FILTER (WHERE value >= 50) AS hits, round(100.0 * count(*) FILTER (WHERE value >= 50) / greatest(count(*), 1), 2) AS hit_pct, round(avg(CASE WHEN value >= 50 THEN value END), 4) AS mean_conf FROM events GROUP BY event_type""")
def region_stats(spark, d):
    hit = c("value") >= 50
    return table(spark, d, "events").groupBy(c("event_type").alias("region")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(hit).alias("hits"), F.round(100.0 * F.count_if(hit) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("hit_pct"), F.round(F.avg(F.when(hit, c("value"))), 4).alias("mean_conf"))


_BUCKETS = ["<0.65", "0.65-0.70", "0.70-0.75", "0.75-0.80", "0.80-0.85", "0.85-0.90", "0.90-0.95", ">=0.95"]


@query(f"""
WITH b(bucket) AS (VALUES {', '.join(f"('{x}')" for x in _BUCKETS)}), k AS (SELECT CASE WHEN v >= 0.95 THEN '>=0.95' WHEN v >= 0.9 THEN '0.90-0.95' WHEN v >= 0.85 THEN '0.85-0.90' WHEN v >= 0.8 THEN '0.80-0.85' WHEN v >= 0.75 THEN '0.75-0.80'
  WHEN v >= 0.7 THEN '0.70-0.75' WHEN v >= 0.65 THEN '0.65-0.70' ELSE '<0.65' END AS bucket FROM (SELECT l_quantity / 60 AS v FROM lineitem))
SELECT b.bucket, count(k.bucket) AS n FROM b LEFT JOIN k ON b.bucket = k.bucket GROUP BY b.bucket""")
def confidence_histogram(spark, d):
    steps = [(0.95, ">=0.95"), (0.9, "0.90-0.95"), (0.85, "0.85-0.90"), (0.8, "0.80-0.85"), (0.75, "0.75-0.80"), (0.7, "0.70-0.75"), (0.65, "0.65-0.70")]
    return R.histogram(table(spark, d, "lineitem"), S.ladder(c("l_quantity") / 60, steps, "<0.65"), _BUCKETS)


@query("""SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.1, 0) AS INT) + 1] AS p10, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5, 0) AS INT) + 1] AS p50, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.9, 0) AS INT) + 1] AS p90 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def nearest_rank_quantiles(spark, d):
    return R.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("""SELECT event_type, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.5), 6) AS med, CAST(floor(quantile_cont(value, 0.35)) AS BIGINT) AS cut FROM events GROUP BY event_type""")
def linear_percentiles(spark, d):
    found = R.linear_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p75": 0.75, "med": 0.5, "p35": 0.35})
    return found.select("event_type", F.round("p75", 6).alias("p75"), F.round("med", 6).alias("med"), F.floor("p35").alias("cut"))


@query("""
WITH p AS (SELECT p_partkey, p_type, p_name AS truth, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 4 = 2 THEN p_name || ' ex' ELSE p_brand END AS found FROM part),
n AS (SELECT *, regexp_replace(lower(trim(truth)), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(trim(found)), '[^a-z0-9]+', '', 'g') AS b FROM p)
SELECT p_type AS family, count(*) AS total, count(found) AS extracted, count(*) FILTER (WHERE a = b) AS correct, count(*) FILTER (WHERE contains(a, b) OR contains(b, a)) AS partial, round(avg(levenshtein(a, b)::DOUBLE / greatest(length(a), 1)), 6) AS distance FROM n GROUP BY p_type""")
def name_accuracy(spark, d):
    z = c("p_size") % 4
    found = F.when(z == 0, c("p_name")).when(z == 2, F.concat("p_name", F.lit(" ex"))).when(z == 3, c("p_brand"))
    named = table(spark, d, "part").select(c("p_type").alias("family"), found.alias("found"), T.squashed(c("p_name")).alias("a"), T.squashed(found).alias("b"))
    return named.groupBy("family").agg(F.count(F.lit(1)).alias("total"), F.count("found").alias("extracted"), F.count_if(c("a") == c("b")).alias("correct"), F.count_if(c("a").contains(c("b")) | c("b").contains(c("a"))).alias("partial"), F.round(F.avg(T.normalised_distance(c("a"), c("b"))), 6).alias("distance"))


@query("""SELECT substr(p_name, 1, 20) || ' -> ' || substr(p_brand, 1, 20) AS pattern, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY ALL ORDER BY n DESC, first_seen LIMIT 20""")
def top_errors(spark, d):
    return R.top_patterns(table(spark, d, "part"), F.concat(F.substring("p_name", 1, 20), F.lit(" -> "), F.substring("p_brand", 1, 20)), "p_partkey", 20)


@query("""
SELECT doc_id, coalesce(n < 2 OR marks > n * 0.3 OR (len(w) > 2 AND single > len(w) * 0.5) OR regexp_matches(lower(t), 'xx|qq|zz|ww|vv|kk|yy') OR regexp_matches(regexp_replace(lower(t), '\\P{L}', '', 'g'), '[^aeiou]{6,}'), true) AS garbage FROM (
  SELECT *, length(regexp_replace(t, '[\\p{L}\\p{N} ''-]', '', 'g')) AS marks, len(list_filter(w, lambda x: length(x) = 1 AND lower(x) NOT IN ('a', 'i'))) AS single FROM (
    SELECT doc_id, text AS t, length(text) AS n, list_filter(string_split_regex(trim(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents))""")
def garbage_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.garbage(c("text")).alias("garbage"))


@query("""
WITH p AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, len(list_filter(range(1, length(b.p_name) + 1), lambda i: substr(a.p_name, i::INT, 1) = substr(b.p_name, i::INT, 1))) AS same
FROM p a, p b WHERE a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 2 AND length(a.p_name) >= 4 AND length(b.p_name) >= 4
AND len(list_filter(range(1, length(b.p_name) + 1), lambda i: substr(a.p_name, i::INT, 1) = substr(b.p_name, i::INT, 1))) >= 0.7 * length(b.p_name)""")
def positional_similarity(spark, d):
    return R.similar_names(table(spark, d, "part").select("p_name"), "p_name")


#: Words that stand in for a lexicon of names.
LEXICON = ["ring", "widget", "bolt", "gear", "gizmo", "plate"]


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """kind, name: a lexicon made of part, whose names are a variant and a name; the other kinds are a few fixed words."""
    word = lambda kind, k: table(spark, d, "part").select(F.lit(kind).alias("kind"), F.split("p_name", " ")[k].alias("name")).distinct()
    fixed = [("suffix", "ex"), ("suffix", "gx"), ("suffix", "tag team"), ("owner", "team rocket's"), ("trainer", "rare candy"), ("trainer", "bosss orders"), ("energy", "double red energy"), ("energy_type", "red"), ("energy_type", "blue")]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in fixed]))
    return word("variant", 0).union(word("name", 1)).union(spark.range(1).select(rows.alias("r")).select("r.kind", "r.name"))


#: The same lexicon in SQL, as lists from the longest name on.
LEX = """lex AS (SELECT (SELECT list(n ORDER BY length(n) DESC, n) FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS n FROM part)) AS names, (SELECT list(DISTINCT split_part(p_name, ' ', 1)) FROM part) AS variants)"""
_FLAT = "regexp_replace(lower(trim({})), '[^a-z0-9]+', '', 'g')"
#: Readings of a part's name: whole, cut at both ends, inside another word, with marks, too short, and none.
_READ = """CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN substr(split_part(p_name, ' ', 2), 1, length(split_part(p_name, ' ', 2)) - 1) WHEN 2 THEN 'x' || split_part(p_name, ' ', 2) || '1 hp' WHEN 3 THEN upper(p_name) || ' ex!'
  WHEN 4 THEN p_brand WHEN 5 THEN '' WHEN 6 THEN 'qz ' || substr(split_part(p_name, ' ', 2), 1, 2) || 'o' || substr(split_part(p_name, ' ', 2), 4) WHEN 7 THEN split_part(p_name, ' ', 1) END"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    first, second, k = F.split("p_name", " ")[0], F.split("p_name", " ")[1], c("p_partkey") % 8
    cut = F.concat(F.lit("qz "), F.substring(second, 1, 2), F.lit("o"), second.substr(F.lit(4), F.length(second)))
    text = (
        F.when(k == 0, c("p_name")).when(k == 1, second.substr(F.lit(1), F.length(second) - 1)).when(k == 2, F.concat(F.lit("x"), second, F.lit("1 hp"))).when(k == 3, F.concat(F.upper("p_name"), F.lit(" ex!")))
        .when(k == 4, c("p_brand")).when(k == 5, "").when(k == 6, cut).otherwise(first)
    )
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", text.alias("t"))


@query(f"""
WITH {LEX}, r AS (SELECT p_partkey, p_name, {_READ} AS t FROM part), n AS (SELECT *, {_FLAT.format("t")} AS f FROM r)
SELECT p_partkey, list_contains(names, f) AS exact, len(list_filter(names, lambda x: (length(x) >= 4 AND contains(f, x)) OR (length(f) >= 4 AND contains(x, f)))) > 0 AS within,
  list_filter(names, lambda x: (length(x) >= 4 AND contains(f, x)) OR (length(f) >= 4 AND contains(x, f)))[1] AS name,
  CASE WHEN contains(lower(t), 'gizmo') THEN 'trainer' WHEN contains(lower(t), 'red energy') THEN 'energy' WHEN regexp_matches(lower(t), 'hp\\s*[0-9]{{2,3}}|[0-9]{{2,3}}\\s*hp') THEN 'pokemon' WHEN regexp_matches(lower(t), 'ring|widget|bolt|gear|plate') THEN 'pokemon' ELSE 'unknown' END AS card_type FROM n, lex""")
def containment_match(spark, d):
    """A reading against every name, in both directions; short ones count only as a whole."""
    kind = T.card_type(c("t"), [x for x in LEXICON if x != "gizmo"], ["gizmo"], ["red"])
    read = readings(spark, d)
    return read.select("p_partkey", kind.alias("card_type")).join(X.contained_names(read, "p_partkey", "t", lexicon(spark, d)), "p_partkey")


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[^a-z]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')"


@query(f"""
WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' ex' ELSE '' END AS name, split_part(p_name, ' ', 1) IN ('small', 'large', 'old', 'hot', 'red', 'blue') AS p, p_size % 2 = 0 AS s, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, CASE WHEN p THEN a ELSE '' END AS prefixes, CASE WHEN p THEN b ELSE a || ' ' || b END AS base, CASE WHEN s THEN 'ex' ELSE '' END AS suffixes, {_TITLE.format("name")} AS title,
  {_TITLE.format("a || ' ' || b")} || CASE WHEN s THEN ' EX' ELSE '' END AS rebuilt FROM n""")
def name_components(spark, d):
    lex = N.Lexicon.of(variant=["small", "large", "old", "hot", "red", "blue"], suffix=["ex", "gx"])
    named = F.concat(F.col("p_name"), F.when(c("p_size") % 2 == 0, " ex").otherwise(""))
    out = R.spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", SCORED_ROWS).select("p_partkey", N.name_parts(named, lex).alias("x"), N.title(named).alias("title"))
    return out.select("p_partkey", F.array_join("x.prefixes", " ").alias("prefixes"), "x.base", F.array_join("x.suffixes", " ").alias("suffixes"), "title", N.rebuilt(c("x")).alias("rebuilt"))


@query()
def name_parse(spark, d):
    """The name on a card from the text that was read on it, over the lexicon of part."""
    raw = F.concat(F.when(c("p_size") % 3 == 0, "Basic ").otherwise(""), c("t"), F.when(c("p_size") % 2 == 0, " HP 60").otherwise(" something"), F.lit("\nEvolves from"))
    return X.parsed_names(readings(spark, d).select("p_partkey", raw.alias("raw")), "p_partkey", "raw", lexicon(spark, d))


@query(f"""
WITH {LEX}, r AS (SELECT p_partkey, p_name, {_READ} AS t FROM part), w AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM r),
f AS (SELECT p_partkey, list_filter(w, lambda x: length(x) >= 3 AND list_contains(names, x))[1] AS exact, list_filter(names, lambda x: length(x) >= 4 AND contains(array_to_string(w, ' '), x))[1] AS within,
  flatten(list_transform(list_filter(w, lambda x: length(x) >= 4), lambda x: list_filter(names, lambda y: length(y) >= 4 AND abs(length(x) - length(y)) <= 2
    AND len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i::INT, 1) = substr(y, i::INT, 1))) >= 0.7 * length(y))))[1] AS near FROM w, lex)
SELECT p_partkey, coalesce(upper(substr(coalesce(exact, within, near), 1, 1)) || substr(coalesce(exact, within, near), 2), '') AS name FROM f""")
def known_name(spark, d):
    return X.known_names(readings(spark, d), "p_partkey", "t", lexicon(spark, d))


@query(f"""
WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '  12. ' ELSE '' END || replace({_READ}, ' ', '   ') || CASE WHEN p_size % 2 = 0 THEN '-!  7' ELSE '' END AS t FROM part), f AS (SELECT p_partkey, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM r),
x AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '^[^a-zA-Z]+', ''), '[^a-zA-Z\\s''-]+$', '') AS a, regexp_replace(regexp_replace(t, '^[^a-zA-Z]+', ''), '[^a-zA-Z\\s]+$', '') AS b FROM f)
SELECT p_partkey, trim(CASE WHEN upper(a) = a AND lower(a) <> a THEN a ELSE {_TITLE.format("a")} END) AS trainer, trim({_TITLE.format("b")}) AS energy FROM x""")
def name_clean(spark, d):
    t = F.concat(F.when(c("p_size") % 3 == 0, "  12. ").otherwise(""), F.replace(c("t"), F.lit(" "), F.lit("   ")), F.when(c("p_size") % 2 == 0, "-!  7").otherwise(""))
    return readings(spark, d).select("p_partkey", N.clean_trainer(t).alias("trainer"), N.clean_energy(t).alias("energy"))


@query()
def trainer_energy_scores(spark, d):
    """How likely each reading is the name of a trainer or an energy card."""
    t = F.concat(F.when(c("p_size") % 5 == 0, "Boss's Orders ").when(c("p_size") % 5 == 1, "red energy ").when(c("p_size") % 5 == 2, "Quick Ball ").otherwise(""), c("t"))
    noted, lex = X.with_entries(readings(spark, d).select("p_partkey", t.alias("t")), "t", lexicon(spark, d), cards=True)
    return noted.select("p_partkey", N.trainer_score(c("t"), lex, c("parts")).alias("trainer"), N.energy_score(c("t"), lex).alias("energy"))


# ---- pixels: an embedding read as an 8 x 8 patch or a profile --------------------

from foilframe.operators import kernels as K  # noqa: E402

_G = "list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 0.5) * 255)))::DOUBLE)"


def _patches(spark: SparkSession, d: str) -> DataFrame:
    level = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 0.5) * 255).cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", level.alias("g"))


@query(f"""SELECT vec_id, round(len(list_filter(g, lambda v: v > 150)) / 64.0, 6) AS whitening, round(list_avg(g), 6) AS mean, round(sqrt(list_var_pop(g)), 4) AS std FROM (SELECT vec_id, {_G} AS g FROM embeddings)""")
def whitening_stats(spark, d):
    g = c("g")
    return _patches(spark, d).select("vec_id", F.round(K.share_over(g, 150), 6).alias("whitening"), F.round(K.mean(g), 6).alias("mean"), F.round(F.sqrt(K.population_variance(g)), 4).alias("std"))


@query(f"""
WITH p AS (SELECT vec_id, {_G} AS g FROM embeddings),
l AS (SELECT vec_id, list_transform(range(0, 36), lambda k: g[(k // 6) * 8 + k % 6 + 2] + g[(k // 6 + 2) * 8 + k % 6 + 2] + g[(k // 6 + 1) * 8 + k % 6 + 1] + g[(k // 6 + 1) * 8 + k % 6 + 3] - 4 * g[(k // 6 + 1) * 8 + k % 6 + 2]) AS q FROM p)
SELECT vec_id, CAST(36 * list_sum(list_transform(q, lambda x: x * x)) - list_sum(q) * list_sum(q) AS BIGINT) AS laplacian_1296 FROM l""")
def laplacian_variance(spark, d):
    g = lambda i: F.element_at("g", i.cast("int") + 1)
    inner = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: (lambda m: g(m - 8) + g(m + 8) + g(m - 1) + g(m + 1) - 4 * g(m))((F.floor(k / 6) + 1) * 8 + k % 6 + 1))
    return _patches(spark, d).withColumn("q", inner).select("vec_id", (36 * K.total(F.transform("q", lambda x: x * x)) - K.total(c("q")) * K.total(c("q"))).cast("long").alias("laplacian_1296"))  # 36 * 36 times the variance, a whole number


@query("""
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 6) AS t FROM embeddings)
SELECT vec_id, round(1 - sqrt(list_sum(list_transform(t, lambda x: sin(x))) ** 2 + list_sum(list_transform(t, lambda x: cos(x))) ** 2) / len(t), 6) AS circular FROM a""")
def circular_variance(spark, d):
    angles = F.transform("embedding", lambda x: x.cast("double") * 6)
    s, k = K.total(F.transform("t", F.sin)), K.total(F.transform("t", F.cos))
    return table(spark, d, "embeddings").select("vec_id", angles.alias("t")).select("vec_id", F.round(1 - F.sqrt(s * s + k * k) / F.size("t"), 6).alias("circular"))


@query(f"""
WITH p AS (SELECT vec_id, {_G} AS g FROM embeddings), x AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(g) AS v FROM p),
t AS (SELECT vec_id, (k // 8) // 4 * 2 + (k % 8) // 4 AS tile, var_pop(v) AS s FROM x GROUP BY ALL)
SELECT vec_id, round(stddev_pop(s), 3) AS spread FROM t GROUP BY vec_id""")
def tile_variance(spark, d):
    tile = lambda y, x: F.concat(*[F.slice("g", 32 * y + 8 * r + 4 * x + 1, 4) for r in range(4)])
    one = lambda t: F.aggregate(t, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")), lambda a: a["q"] / 16 - (a["s"] / 16) * (a["s"] / 16))
    tiles = _patches(spark, d).withColumn("s", F.array(*[one(tile(y, x)) for y in (0, 1) for x in (0, 1)]))
    return tiles.select("vec_id", F.round(F.sqrt(K.population_variance(c("s"))), 3).alias("spread"))


@query(f"""SELECT vec_id, coalesce(list_min(list_filter(range(5, 49), lambda i: abs(g[i + 2] - g[i + 1]) > 60)), 0)::INT AS border FROM (SELECT vec_id, {_G} AS g FROM embeddings)""")
def border_scan(spark, d):
    hits = F.filter(F.sequence(F.lit(5), F.lit(48)), lambda i: F.abs(F.element_at("g", i + 2) - F.element_at("g", i + 1)) > 60)
    return _patches(spark, d).select("vec_id", F.coalesce(F.array_min(hits), F.lit(0)).alias("border"))


@query("""
WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings), t AS (SELECT vec_id AS template_id, bits AS tb FROM b WHERE vec_id < 10),
m AS (SELECT vec_id, template_id, list_sum(list_transform(range(1, 65), lambda i: (bits[i] = tb[i])::INT))::INT AS same FROM b, t),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY same DESC, template_id) AS k FROM m)
SELECT vec_id, template_id, same, CASE WHEN same / 64.0 >= 0.65 THEN same / 64.0 WHEN same / 64.0 >= 0.6 THEN round(same / 64.0 * 0.85, 6) END::DOUBLE AS score FROM r WHERE k = 1""")
def template_hamming(spark, d):
    bits = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    templates = bits.filter("vec_id < 10").agg(F.collect_list(F.struct("vec_id", "bits")).alias("t")).scalar()  # ten templates, as one value
    same = lambda t: F.aggregate(F.zip_with("bits", t["bits"], lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, v: a + v)
    best = bits.withColumn("templates", templates).select("vec_id", F.array_max(F.transform("templates", lambda t: F.struct(same(t).alias("same"), (-t["vec_id"]).alias("t")))).alias("m")).select("vec_id", (-c("m.t")).alias("template_id"), c("m.same").alias("same"))
    share = c("same") / 64.0
    return best.select("vec_id", "template_id", "same", F.when(share >= 0.65, share).when(share >= 0.6, F.round(share * 0.85, 6)).alias("score"))


@query("""
WITH RECURSIVE cells AS (SELECT vec_id, k FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings) WHERE v > 0),
reach AS (SELECT vec_id, k AS a, k AS b FROM cells UNION SELECT r.vec_id, r.a, n.k FROM reach r JOIN cells n ON n.vec_id = r.vec_id AND abs(n.k // 8 - r.b // 8) + abs(n.k % 8 - r.b % 8) = 1),
roots AS (SELECT vec_id, a, min(b) AS root FROM reach GROUP BY ALL), sizes AS (SELECT vec_id, root, count(*) AS n FROM roots GROUP BY ALL)
SELECT e.vec_id, CAST(count(root) AS INT) AS parts, coalesce(max(n), 0) AS largest FROM embeddings e LEFT JOIN sizes USING (vec_id) GROUP BY e.vec_id""")
def connected_components(spark, d):
    """Connected parts of the set cells of each patch, by runs and their overlaps."""
    patches = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("bits"))
    sizes = P.part_sizes(P.parts(P.runs(P.lines(patches, "vec_id", c("bits"), 8)))).withColumnRenamed("image", "vec_id")
    return patches.select("vec_id").join(sizes, "vec_id", "left").select("vec_id", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("largest", F.lit(0)).cast("long").alias("largest"))


@query(f"""
WITH p AS (SELECT vec_id, {_G} AS g FROM embeddings), x AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(g) AS v FROM p),
m AS (SELECT vec_id, 'x' AS axis, k % 8 AS i, avg(v) AS m FROM x GROUP BY ALL UNION ALL SELECT vec_id, 'y', k // 8, avg(v) FROM x GROUP BY ALL),
w AS (SELECT vec_id, axis, list(m ORDER BY i) AS m FROM m GROUP BY ALL),
s AS (SELECT vec_id, axis, list_transform(range(0, 8), lambda i: abs(m[i + 1] - (m[abs(i - 2) + 1] + 4 * m[abs(i - 1) + 1] + 6 * m[i + 1] + 4 * m[8 - abs(6 - i)] + m[8 - abs(5 - i)]) / 16)) AS h, m FROM w)
SELECT vec_id, axis, round(list_min(m), 6) AS least, round(list_max(m), 6) AS most, round(list_stddev_pop(h), 6) AS rough FROM s""")
def projection_profiles(spark, d):
    """Means of columns and lines of each patch, and how rough those profiles are beside themselves smoothed."""
    profile = P.profiles(P.lines(_patches(spark, d), "vec_id", c("g"), 8))
    ends = profile.groupBy("image", "axis").agg(F.round(F.min("mean"), 6).alias("least"), F.round(F.max("mean"), 6).alias("most"))
    return ends.join(P.roughness(profile), ["image", "axis"]).select(c("image").alias("vec_id"), "axis", "least", "most", F.round("rough", 6).alias("rough"))


#: Corners, edges and the inside of a patch of 8 x 8 cells, the far ends excluded.
RECTANGLES = [("top_left", 0, 0, 2, 2), ("top_right", 0, 6, 2, 8), ("bottom_left", 6, 0, 8, 2), ("bottom_right", 6, 6, 8, 8), ("top", 0, 0, 1, 8), ("bottom", 7, 0, 8, 8), ("left", 0, 0, 8, 1), ("right", 0, 7, 8, 8), ("inside", 1, 1, 7, 7), ("whole", 0, 0, 8, 8)]


@query(f"""
WITH p AS (SELECT vec_id, {_G} AS g FROM embeddings), x AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(g) AS v FROM p),
r AS (SELECT * FROM (VALUES {", ".join(map(str, RECTANGLES))}) t(name, y0, x0, y1, x1))
SELECT vec_id, name, round(avg(v), 4) AS mean, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS BIGINT) AS scaled_variance FROM x JOIN r ON k // 8 >= y0 AND k // 8 < y1 AND k % 8 >= x0 AND k % 8 < x1 GROUP BY ALL""")
def rectangle_stats(spark, d):
    """Mean and variance of the corners, edges and inside of each patch, by four look-ups in its summed areas."""
    rectangles = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("name", "y0", "x0", "y1", "x1"), r)]) for r in RECTANGLES])))
    found = P.rectangle_stats(P.summed_area(P.lines(_patches(spark, d), "vec_id", c("g"), 8)), rectangles)
    return found.select(c("image").alias("vec_id"), "name", F.round("mean", 4).alias("mean"), F.round(c("variance") * c("n") * c("n")).cast("long").alias("scaled_variance"))  # times the cells' number twice, a whole number


@query("""
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x0, y0, x1, y1) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (
  SELECT l_orderkey, CAST(l_partkey % 400 AS INT) AS x0, CAST(l_suppkey % 60 AS INT) AS y0, CAST(l_partkey % 400 + 20 AS INT) AS x1, CAST(l_suppkey % 60 + 30 AS INT) AS y1 FROM lineitem)),
f AS (SELECT l_orderkey, k, n, x0, y0, x1, y1, 1 AS boxes, x1 AS first_end FROM b WHERE k = 1
  UNION ALL SELECT b.l_orderkey, b.k, b.n, CASE WHEN j THEN least(f.x0, b.x0) ELSE b.x0 END, CASE WHEN j THEN least(f.y0, b.y0) ELSE b.y0 END, CASE WHEN j THEN greatest(f.x1, b.x1) ELSE b.x1 END, CASE WHEN j THEN greatest(f.y1, b.y1) ELSE b.y1 END,
    f.boxes + CASE WHEN j THEN 0 ELSE 1 END, CASE WHEN f.boxes = 1 AND j THEN greatest(f.x1, b.x1) ELSE f.first_end END
  FROM f JOIN b ON b.l_orderkey = f.l_orderkey AND b.k = f.k + 1, LATERAL (SELECT b.x0 - f.x1 <= 15 AND greatest(0, least(f.y1, b.y1) - greatest(f.y0, b.y0))::DOUBLE / greatest(1, least(f.y1 - f.y0, b.y1 - b.y0)) > 0.4 AS j))
SELECT l_orderkey, CAST(n AS INT) AS before, boxes AS after, first_end FROM f WHERE k = n""")
def box_merge(spark, d):
    box = F.struct((c("l_partkey") % 400).cast("int").alias("x0"), (c("l_suppkey") % 60).cast("int").alias("y0"), (c("l_partkey") % 400 + 20).cast("int").alias("x1"), (c("l_suppkey") % 60 + 30).cast("int").alias("y1"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(box)).alias("boxes"))  # the lines of one order
    return rows.select("l_orderkey", F.size("boxes").alias("before"), K.merged_boxes(c("boxes")).alias("m")).select("l_orderkey", "before", F.size("m").alias("after"), F.get("m", 0)["x1"].alias("first_end"))