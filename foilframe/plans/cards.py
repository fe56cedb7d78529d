"""The two card pipelines: analysis of a front, grading of a front and a back; both end in stable JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foilframe.functions import scores as S
from foilframe.functions import texts as T
from foilframe.operators import kernels as K
from foilframe.operators.relational import highest_passing
from foilframe.plans.catalog import CENTERING
from foilframe.sources.writers import sorted_fields


def severities(f: str = "f") -> dict[str, Column]:
    """corners, edges and surface of a column of features; the worst part decides."""
    c = lambda k: F.col(f"{f}.{k}")
    corners = F.array_max(F.transform(c("corners"), lambda p: S.corner_severity(p["whitening"], p["variance"])))
    edges = F.array_max(F.transform(c("edges"), lambda p: S.edge_severity(p["whitening"], S.chipping_score(p["chipping_std"]))))
    surface = F.greatest(S.scratch_severity(c("scratches"), c("is_textured")), S.scuff_severity(c("texture"), c("is_textured")))
    return {"corners": corners, "edges": edges, "surface": surface}


def worst(parts: Column, score) -> Column:
    """The name of the first part with the highest score."""
    return F.array_max(F.transform(parts, lambda p, k: F.struct(score(p).alias("s"), (-k).alias("k"), p["name"].alias("name"))))["name"]


def signals(f: str = "f") -> Column:
    """Three condition signals, each with severity, observation and evidence."""
    c = lambda k: F.col(f"{f}.{k}")
    s = severities(f)
    corner = T.part_name(worst(c("corners"), lambda p: S.corner_severity(p["whitening"], p["variance"])))
    edge = T.part_name(worst(c("edges"), lambda p: S.edge_severity(p["whitening"], S.chipping_score(p["chipping_std"]))))
    listed = lambda parts, odd: F.array_join(F.transform(F.filter(parts, odd), lambda p: F.concat(T.part_name(p["name"]), F.lit(": "), F.format_number(p["whitening"] * 100, 1), F.lit("% white"))), "; ")
    text = {
        "corners": (F.concat(F.lit("worst at "), corner), listed(c("corners"), lambda p: p["whitening"] > 0.05)),
        "edges": (F.concat(F.lit("worst at "), edge), listed(c("edges"), lambda p: (p["whitening"] > 0.05) | (S.chipping_score(p["chipping_std"]) > 0.2))),
        "surface": (F.format_string("%d lines", c("scratches")), F.lit("")),
    }
    return F.array(*[F.struct(F.lit(k).alias("name"), S.severity_label(s[k]).alias("severity"), F.round(s[k], 6).alias("score"), o.alias("observation"), F.coalesce(F.nullif(e, F.lit("")), F.lit("nothing found")).alias("evidence")) for k, (o, e) in text.items()])


def analyze(images: DataFrame) -> DataFrame:
    """request_id and body for rows of height, width, data, name, number, detected and declared; rejected ones carry reasons only."""
    made = images.withColumn("request_id", T.request_id(F.col("data"), F.col("declared"))).withColumn("canon", K.canonical_image("height", "width", "data")).drop("data")
    seen = made.withColumn("f", K.image_features(F.lit(K.CANONICAL[1]), F.lit(K.CANONICAL[0]), "canon.data")).withColumn("warp_used", F.col("canon.warp_used")).drop("canon")
    confidence = F.when(F.col("f").isNull() | F.col("f.corners").isNull(), 0.0).otherwise(S.identity_confidence(F.col("name"), F.col("number")))
    judged = seen.withColumn("confidence", confidence).withColumn("codes", S.gatekeeper_codes(F.col("name"), F.col("confidence"), F.col("detected"), F.col("declared")))
    ok = F.size("codes") == 0
    identity = F.struct("name", "number", "confidence", F.col("detected").alias("card_type"))
    out = judged.select("request_id", ok.alias("accepted"), F.col("codes").alias("reason_codes"), F.when(ok, identity).alias("identity"), F.when(ok, signals()).otherwise(F.array().cast("array<struct<name:string,severity:string,score:double,observation:string,evidence:string>>")).alias("signals"), "warp_used")
    return sorted_fields(out).select("request_id", "accepted", F.to_json(F.struct("*")).alias("body"))


def grade(pairs: DataFrame) -> DataFrame:
    """Grades rows of card_id, front features f, front_lr, front_tb, back_lr, back_tb (the larger sides in percent)."""
    s = severities()
    rows = pairs.select("card_id", F.greatest("front_lr", "front_tb").alias("front"), F.greatest("back_lr", "back_tb").alias("back"), *[v.alias(k) for k, v in s.items()])
    best = rows.withColumn("grade", highest_passing([F.col("front"), F.col("back")], CENTERING, 1.0))
    return best.select("card_id", F.col("grade").alias("max_grade"), "corners", "edges", "surface", *[F.round(v, 6).alias(k) for k, v in S.grade_columns(F.col("corners"), F.col("edges"), F.col("surface"), F.col("grade")).items()])
