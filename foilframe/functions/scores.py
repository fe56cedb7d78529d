"""Scores, bands and gates as Column expressions; all of them stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ladder(x: Column, steps: list[tuple[float, object]], rest) -> Column:
    """The value of the first step whose lower bound x reaches; rest below all."""
    out = None
    for bound, value in steps:
        out = (F if out is None else out).when(x >= bound, lit(value))
    return out.otherwise(lit(rest))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def severity_label(score: Column) -> Column:
    return ladder(score, [(0.75, "significant"), (0.5, "moderate"), (0.25, "minor")], "none")


def centering_severity(max_grade: Column) -> Column:
    return ladder(max_grade, [(9, "none"), (8, "minor"), (7, "moderate")], "significant")


def centering_confidence(front: Column, back: Column) -> Column:
    return F.when(front & back, 0.9).when(front | back, 0.7).otherwise(0.4)


def corner_severity(whitening: Column, variance: Column) -> Column:
    """Whitening bands, and half of 0.4 more for a flat corner."""
    white = ladder(whitening, [(0.5, 1.0), (0.3, 0.6), (0.15, 0.3)], whitening / 0.15 * 0.3)
    return F.least(F.lit(1.0), white + 0.5 * F.when(variance < 0.02, 0.4).otherwise(0.0))


def chipping_score(std: Column) -> Column:
    return ladder(std, [(60, 1.0), (40, 0.6), (25, 0.3)], std / 25 * 0.3)


def edge_severity(whitening: Column, chipping: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(ladder(whitening, [(0.55, 1.0), (0.35, 0.6), (0.2, 0.3)], whitening / 0.2 * 0.3), chipping))


def scratch_severity(n: Column, textured: Column) -> Column:
    """Thresholds of 2, 5 and 10 scratches, doubled on textured cards."""
    k = n / F.when(textured, 2.0).otherwise(1.0)
    return F.when(n <= 0, 0.0).otherwise(ladder(k, [(10, 1.0), (5, 0.6), (2, 0.3)], k / 2 * 0.3))


def scuff_severity(spread: Column, textured: Column) -> Column:
    plain = ladder(spread, [(40, 1.0), (25, 0.6), (15, 0.3)], spread / 15 * 0.3)
    s = F.greatest(F.lit(0.0), spread - 1500) / 200
    return F.when(textured, ladder(s, [(1, 1.0), (0.5, 0.6), (0.2, 0.3)], s * 0.3 / 0.2)).otherwise(plain)


def blur_score(v: Column) -> Column:
    return ladder(v, [(500, 0.0), (300, 0.1), (100, 0.1 + 0.4 * (300 - v) / 200)], F.least(F.lit(1.0), 0.5 + 0.5 * (100 - v) / 100))


def glare_score(r: Column) -> Column:
    return ladder(r, [(0.15, 1.0), (0.08, 0.5 + 0.5 * (r - 0.08) / 0.07), (0.02, 0.2 + 0.3 * (r - 0.02) / 0.06)], r / 0.02 * 0.2)


def occlusion_score(r: Column) -> Column:
    return ladder(r, [(0.25, 1.0), (0.15, 0.5 + 0.5 * (r - 0.15) / 0.1), (0.05, 0.2 + 0.3 * (r - 0.05) / 0.1)], r / 0.05 * 0.2)


def photo_usable(blur_variance: Column, glare: Column, dark: Column) -> Column:
    return ~((blur_variance < 100) | (glare >= 0.15) | (dark >= 0.25))


def photo_reasons(blur_variance: Column, glare: Column, dark: Column) -> Column:
    """Reasons in order, those that don't make a photo unusable included."""
    found = F.array(
        F.when(blur_variance < 100, "too_blurry").when(blur_score(blur_variance) > 0.3, "soft"),
        F.when(glare >= 0.15, "strong_glare").when(glare >= 0.08, "some_glare"),
        F.when(dark >= 0.25, "too_dark").when(dark >= 0.15, "dark_areas"),
    )
    return F.filter(found, lambda x: x.isNotNull())


#: The share a centering grade is worth.
GRADE_SHARE = {10.0: 1.0, 9.0: 0.85, 8.0: 0.7, 7.0: 0.55, 6.0: 0.4, 5.0: 0.3, 4.0: 0.25, 3.0: 0.2, 2.0: 0.15, 1.5: 0.12, 1.0: 0.1}


def grade_columns(corners: Column, edges: Column, surface: Column, max_grade: Column) -> dict[str, Column]:
    """Distribution over grades 7 to 10, expected grade and confidence."""
    wear = (corners + edges + surface) / 3
    share = F.lit(0.1)
    for grade, value in GRADE_SHARE.items():
        share = F.when(max_grade == grade, value).otherwise(share)
    top = clamp01(0.05 + 0.9 * share - 0.6 * wear)
    raw = {10: 2 * top, 9: 1.2 * (0.9 - wear) + 0.2 * share, 8: 1 - 0.6 * share, 7: 0.7 + 0.2 * wear}
    peak = F.greatest(*raw.values())
    weight = {g: F.exp(x - peak) for g, x in raw.items()}
    total = weight[10] + weight[9] + weight[8] + weight[7]
    p = {g: w / total for g, w in weight.items()}
    return {"p_psa10": top, **{f"p{g}": p[g] for g in (7, 8, 9, 10)}, "expected": sum((g * p[g] for g in (8, 9, 10)), 7 * p[7]), "confidence": clamp01(0.3 + 0.4 * share + 0.3 * (1 - wear))}


def side_ratio(a: Column, b: Column) -> Column:
    """The larger of two margins in percent of both; 50 where there are none."""
    return F.when(a + b <= 0, 50.0).otherwise(F.greatest(a, b) / F.nullif(a + b, F.lit(0.0)) * 100)


def centre_ratio(offset: Column) -> Column:
    """The larger side in percent, for an offset of the centre between -1 and 1."""
    left = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + offset * 50))
    return F.greatest(left, 100 - left)


STRICT, RELAXED, AREA, RECTANGULAR = (0.66, 0.78), (0.58, 0.84), (0.08, 0.97), 0.7
CARD_ASPECT = 63 / 88


def quad_gates(aspect: Column, area: Column, rect: Column, strict: bool) -> Column:
    return aspect.between(*(STRICT if strict else RELAXED)) & area.between(*AREA) & (rect >= RECTANGULAR)


def gate_flags(aspect: Column, area: Column, rect: Column) -> dict[str, Column]:
    """Which gates a candidate fails, with the relaxed aspect."""
    return {"aspect": ~aspect.between(*RELAXED), "area_min": area < AREA[0], "area_max": area > AREA[1], "rectangularity": rect < RECTANGULAR}


def quad_score(area: Column, aspect: Column, rect: Column, off_centre: Column) -> Column:
    return 0.4 * F.least(1.5 * F.sqrt(area), F.lit(1.0)) + 0.4 * (1 - F.least(F.abs(aspect - CARD_ASPECT) / CARD_ASPECT, F.lit(1.0))) + 0.2 * F.least(rect, F.lit(1.0)) - 0.15 * off_centre


def best_effort_reason(aspect: Column, area: Column, rect: Column, slack: float = 0.05) -> Column:
    """For a candidate that only just misses the relaxed aspect, which way; else null."""
    ok = area.between(*AREA) & (rect >= RECTANGULAR)
    low, high = RELAXED
    return F.when(ok & (aspect < low) & (aspect >= low - slack), "aspect_low").when(ok & (aspect > high) & (aspect <= high + slack), "aspect_high")


def number_plausible(num: Column, total: Column) -> Column:
    return F.coalesce((num > 0) & total.between(10, 500) & (num <= total + 150), F.lit(False))


def number_score(num: Column, total: Column) -> Column:
    """Plausibility of num/total; at shared bounds the first band wins."""
    by_total = F.when(total.between(100, 250), 0.35).when(total.between(50, 100) | total.between(250, 350), 0.25).when(total.between(20, 50), 0.15).when((total < 20) | (total > 400), -0.2).otherwise(0.0)
    by_num = F.when(num <= total, 0.1).when(num <= total + 30, 0.15).when(num <= total + 80, 0.1).when(num <= total + 150, 0.05).otherwise(-0.15)
    return clamp01(0.5 + by_total + by_num)


def number_confidence(mean_score: Column, num: Column, total: Column) -> Column:
    bonus = F.when(total.between(50, 300), 0.1).when(total.between(20, 50) | total.between(300, 400), 0.05).otherwise(0.0)
    fit = F.when(num <= total, 0.05).when(num <= total + 50, 0.02).otherwise(0.0)
    return clamp01(F.coalesce(mean_score, F.lit(0.5)) + bonus + fit - F.when(num > total + 100, 0.1).otherwise(0.0) - F.when(total < 20, 0.15).otherwise(0.0))


def identity_confidence(name: Column, number: Column) -> Column:
    n = F.length(F.coalesce(name, F.lit("")))
    return F.round(F.when(n.between(3, 50), 0.5).when(n > 0, 0.2).otherwise(0.0) + F.when(F.coalesce(number, F.lit("")) != "", 0.5).otherwise(0.0), 2)


def ocr_confidence(family: Column, plausibility: Column, total: Column) -> Column:
    base = F.when(family.isin("special", "modern") & (plausibility >= 0.9), 0.85).otherwise(0.8)
    return F.least(F.lit(1.0), base + F.when(total >= 150, 0.15).otherwise(0.0))


def vintage_score(num: Column, total: Column, angle: Column) -> Column:
    """Score of a number read off a turned crop."""
    year = lambda x: x.between(1900, 2099)
    return (
        F.when(total.between(20, 500), 2.0).otherwise(0.0) + F.when(total >= 50, 1.0).otherwise(0.0) + F.when(num > 0, 0.5).otherwise(0.0)
        - F.when(num > total + 150, 5.0).otherwise(0.0) - F.when(year(num), 5.0).otherwise(0.0) - F.when(year(total), 5.0).otherwise(0.0) - 0.05 * F.abs(angle)
    )


def vintage_confidence(num: Column, total: Column, angle: Column) -> Column:
    """The score as a confidence."""
    return F.least(F.lit(0.9), F.greatest(F.lit(0.5), 0.5 + vintage_score(num, total, angle) / 5))


def arbitrate(template_conf: Column, ocr_plaus: Column, family: Column, template_total: Column, ocr_total: Column) -> Column:
    """Which reading of a number wins: 'ocr' or 'template'."""
    return (
        F.when(template_conf.isNull() & ocr_plaus.isNull(), F.lit(None).cast("string")).when(template_conf.isNull(), "ocr").when(ocr_plaus.isNull(), "template")
        .when(ocr_plaus > template_conf + 0.1, "ocr")
        .when(family.isin("special", "modern") & (ocr_plaus >= 0.9) & (ocr_total > template_total), "ocr").otherwise("template")
    )


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1), F.least(a1 - a0, b1 - b0))


def energy_type(r: Column, g: Column, b: Column) -> Column:
    """Energy type by the mean colour of the centre; the first rule that holds decides."""
    near = (F.abs(r - g) < 30) & (F.abs(g - b) < 30)
    rules = [
        ("grass", (g > r) & (g > b) & (g > 100)), ("psychic", (r > g) & (r > b) & (r > 150) & (b > 100)), ("fire", (r > g) & (r > b) & (r > 150)),
        ("water", (b > r) & (b > g) & (b > 120)), ("lightning", (r > 180) & (g > 180) & (b < 100)), ("fighting", (r > 150) & (g > 100) & (b < 100)),
        ("darkness", (r < 100) & (g < 100) & (b < 100)), ("colorless", (r > 150) & (g > 150) & (b > 150)), ("metal", (r > 100) & (g > 100) & (b > 100) & near),
    ]
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def back_side(r: Column, g: Column, b: Column, centre_std: Column) -> Column:
    """Which side a photo shows, by its blue and its contrast."""
    blue = (b - (r + g) / 2) / 255
    return F.when((blue > 0.12) & (centre_std / 255 > 0.18), F.struct(F.lit("back").alias("label"), F.lit(0.7).alias("confidence"))).otherwise(F.struct(F.lit("front").alias("label"), F.lit(0.55).alias("confidence")))


def triage(label: Column, confidence: Column, sure: float = 0.9) -> Column:
    return F.when((label == "front") & (confidence >= sure), "front").when((label == "back") & (confidence >= sure), "back").otherwise("review")


def low_or_not_front(label: Column, confidence: Column) -> Column:
    return (label != "front") | (confidence < 0.7)


def gatekeeper_codes(name: Column, confidence: Column, detected: Column, declared: Column) -> Column:
    """Reason codes in order; none means accepted."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.filter(
        F.array(
            F.when((confidence == 0) & (plain == ""), "IMAGE_UNREADABLE"),
            F.when(~(detected.eqNullSafe(declared) | (detected == "unknown")), "CARD_TYPE_MISMATCH"),
            F.when((declared == "energy") & ~plain.contains("energy"), "ENERGY_NAME_NOT_FOUND"),
            F.when((declared == "trainer") & (F.length(plain) < 3), "TRAINER_NAME_NOT_FOUND"),
        ),
        lambda x: x.isNotNull(),
    )


def upload_error(content_type: Column, length: Column, limit: int = 12_582_912) -> Column:
    """The first failing check of an upload; null if all pass."""
    return F.when(content_type.isNull() | ~content_type.isin("image/jpeg", "image/png", "image/webp"), "INVALID_CONTENT_TYPE").when(length.isNull() | (length <= 0), "EMPTY_BODY").when(length > limit, "TOO_LARGE")


def exempt_path(path: Column, exempt: list[str]) -> Column:
    bare = F.regexp_replace(path, "\\?.*$", "")
    out = F.lit(False)
    for p in exempt:
        out = out | (bare == p) | bare.startswith(p + "/")
    return out


#: What an analysis request may say.
CARD_TYPES, ENCODINGS = ("pokemon", "trainer", "energy"), ("base64", "url")


def analysis_error(body: Column) -> Column:
    """The error code of an analysis request, a JSON text; null if nothing is wrong. The first check that fails decides."""
    told = F.try_parse_json(body)
    kind = F.schema_of_variant(told)
    field = lambda path: F.try_variant_get(told, path, "string")
    front = F.schema_of_variant(F.try_variant_get(told, "$.front_image", "variant"))
    data = field("$.front_image.data")
    return (
        F.when(told.isNull() | ~kind.startswith("OBJECT"), "INVALID_REQUEST_FORMAT").when(~F.coalesce(field("$.card_type"), F.lit("")).isin(*CARD_TYPES), "UNSUPPORTED_CARD_TYPE")
        .when(front.isNull() | ~front.startswith("OBJECT"), "MISSING_REQUIRED_FIELD").when(~F.coalesce(field("$.front_image.encoding"), F.lit("")).isin(*ENCODINGS), "INVALID_FIELD_VALUE")
        .when(F.coalesce(data, F.lit("")) == "", "MISSING_REQUIRED_FIELD").when((field("$.front_image.encoding") == "base64") & F.try_to_binary(data, F.lit("base64")).isNull(), "INVALID_IMAGE_FORMAT")
    )


def _told(body: Column) -> tuple[Column, Callable[[str], Column]]:
    """A JSON text, null unless it is an object, and its strings by path; other values count as none."""
    told = F.try_parse_json(body)
    whole = F.when(F.schema_of_variant(told).startswith("OBJECT"), told)
    string = lambda path: F.when(F.schema_of_variant(F.try_variant_get(whole, path, "variant")) == "STRING", F.try_variant_get(whole, path, "string"))
    return whole, lambda path: F.coalesce(string(path), F.lit(""))


def job_error(body: Column) -> Column:
    """The gateway's error code of an analysis or a job; null if it passes."""
    _, text = _told(body)
    bad = ~text("$.front_image.encoding").isin(*ENCODINGS) | (F.trim(text("$.front_image.data")) == "")
    return F.when(~text("$.card_type").isin(*CARD_TYPES), "UNSUPPORTED_CARD_TYPE").when(bad, "MISSING_REQUIRED_FIELD")


def grade_error(body: Column) -> Column:
    """The gateway's error code of a grading, which needs both sides as base64; null if it passes."""
    _, text = _told(body)
    bad = F.lit(False)
    for side in ("front_image", "back_image"):
        bad = bad | (text(f"$.{side}.encoding") != "base64") | (text(f"$.{side}.data") == "")
    return F.when(text("$.card_type") != "pokemon", "UNSUPPORTED_CARD_TYPE").when(bad, "MISSING_REQUIRED_FIELD")


def upload_request_error(body: Column, limit: int = 12_582_912) -> Column:
    """The gateway's error code of a request for an upload; null if it passes."""
    whole, text = _told(body)
    number = F.try_variant_get(whole, "$.content_length", "variant")
    size = F.when(F.schema_of_variant(number) != "STRING", F.try_variant_get(whole, "$.content_length", "double"))
    mime = text("$.content_type")
    return (
        F.when(~text("$.kind").isin("front_image", "back_image") | (mime == ""), "MISSING_REQUIRED_FIELD").when(~mime.isin("image/jpeg", "image/png", "image/webp"), "INVALID_REQUEST_FORMAT")
        .when(size.isNull() | (size <= 0), "MISSING_REQUIRED_FIELD").when(size > limit, "INVALID_REQUEST_FORMAT")
    )


def best_number_window(glyphs: Column) -> Column:
    """score and window_text of the best n/n of one to three digits on each side of the slash of a text of digits with one slash; of equal scores the first, then the shortest. Null if none is plausible."""
    left, right = F.substring_index(glyphs, "/", 1), F.substring_index(glyphs, "/", -1)
    sides = [F.struct(F.right(left, F.lit(i)).alias("num"), F.left(right, F.lit(j)).alias("total"), (i - F.length(left)).alias("s"), F.lit(-i - j).alias("n")) for i in (1, 2, 3) for j in (1, 2, 3)]
    there = F.filter(F.array(*sides), lambda w: (w["s"] <= 0) & (F.length(w["total"]) == -w["n"] - F.length(w["num"])) & number_plausible(w["num"].try_cast("int"), w["total"].try_cast("int")))
    scored = F.transform(there, lambda w: F.struct(F.round(number_score(w["num"].try_cast("int"), w["total"].try_cast("int")), 6).alias("score"), w["s"].alias("s"), w["n"].alias("n"), F.concat(w["num"], F.lit("/"), w["total"]).alias("window_text")))
    return F.array_max(scored)
