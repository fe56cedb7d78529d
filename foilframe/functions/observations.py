"""Texts of condition signals: what is said of a severity, with the values measured, and the evidence for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by signal, from the best band to the worst. Centering is banded by the highest grade, all others by severity.
CENTERING = (
    (10, "Centering is excellent (LR %.1f%%, TB %.1f%%), consistent with PSA 10 standards"),
    (9, "Centering shows slight variance (LR %.1f%%, TB %.1f%%), consistent with PSA 9 standards"),
    (8, "Centering shows noticeable variance (LR %.1f%%, TB %.1f%%), may limit to PSA 8"),
    (7, "Centering is off-center (LR %.1f%%, TB %.1f%%), likely limited to PSA 7"),
)
CENTERING_WORST = "Centering is significantly off-center (LR %.1f%%, TB %.1f%%), below PSA 7 threshold"
CENTERING_EVIDENCE = "Left-right ratio %.1f%%, top-bottom ratio %.1f%%. Back measured via %s."
CORNERS = (
    "All corners show minimal wear, consistent with pack-fresh condition", "Minor wear detected, most noticeable at %s",
    "Moderate corner wear detected at %s, showing whitening", "Significant corner damage at %s, notable whitening or flattening",
)
EDGES = (
    "Edges show minimal wear, no visible chipping or whitening", "Minor edge wear detected, most noticeable along %s",
    "Moderate edge wear along %s, some whitening visible", "Significant edge damage along %s, visible chipping or whitening",
)
SURFACE_CLEAN = "Surface is clean with no visible scratches or scuffs"
SURFACE_SCRATCHED = ("Surface shows %d minor scratches visible under analysis", "Surface has %d scratches, some may be visible to naked eye", "Surface has %d notable scratches and visible wear")
SURFACE_WORN = ("Surface shows minor texture irregularities", "Surface shows moderate wear and texture irregularities", "Surface shows significant wear, scuffs, or damage")
NO_WHITENING, EVEN_EDGES = "Corner analysis shows no significant whitening detected", "Edge analysis shows consistent color along all borders"
#: Severities from which a signal is minor, moderate, significant.
BANDS = (0.25, 0.5, 0.75)


def _banded(severity: Column, texts: list[Column]) -> Column:
    """texts: one for each band, none to significant."""
    return F.when(severity < BANDS[0], texts[0]).when(severity < BANDS[1], texts[1]).when(severity < BANDS[2], texts[2]).otherwise(texts[3])


def centering(max_grade: Column, lr: Column, tb: Column) -> Column:
    out = F.format_string(CENTERING_WORST, lr, tb)
    for bound, text in reversed(CENTERING):
        out = F.when(max_grade >= bound, F.format_string(text, lr, tb)).otherwise(out)
    return out


def centering_evidence(lr: Column, tb: Column, method: Column) -> Column:
    return F.format_string(CENTERING_EVIDENCE, lr, tb, F.coalesce(method, F.lit("unknown")))


def worst_of(parts: Column, severity) -> Column:
    """The name of the first part with the highest severity above 0, or null."""
    best = F.array_max(F.transform(parts, lambda p, i: F.struct(severity(p).alias("s"), (-i).alias("i"), F.replace(p["name"], F.lit("_"), F.lit(" ")).alias("name"))))
    return F.when(best["s"] > 0, best["name"])


def corners(severity: Column, worst: Column) -> Column:
    named = lambda other: F.coalesce(worst, F.lit(other))
    return _banded(severity, [F.lit(CORNERS[0]), F.format_string(CORNERS[1], named("corners")), F.format_string(CORNERS[2], named("multiple corners")), F.format_string(CORNERS[3], named("multiple corners"))])


def edges(severity: Column, worst: Column) -> Column:
    named = lambda other: F.coalesce(worst, F.lit(other))
    return _banded(severity, [F.lit(EDGES[0]), F.format_string(EDGES[1], named("edges")), F.format_string(EDGES[2], named("multiple edges")), F.format_string(EDGES[3], named("multiple edges"))])


def corners_evidence(parts: Column) -> Column:
    """parts: name, whitening."""
    told = F.transform(F.filter(parts, lambda p: p["whitening"] * 100 > 5), lambda p: F.format_string("%s: %.1f%% whitening", F.replace(p["name"], F.lit("_"), F.lit(" ")), p["whitening"] * 100))
    return F.when(F.size(told) > 0, F.array_join(told, "; ")).otherwise(NO_WHITENING)


def edges_evidence(parts: Column) -> Column:
    """parts: name, whitening, chipping (a score)."""
    told = F.transform(F.filter(parts, lambda p: (p["whitening"] * 100 > 5) | (p["chipping"] * 100 > 20)), lambda p: F.format_string("%s: whitening %.1f%%, chipping %.0f%%", p["name"], p["whitening"] * 100, p["chipping"] * 100))
    return F.when(F.size(told) > 0, F.array_join(told, "; ")).otherwise(EVEN_EDGES)


def surface(severity: Column, scratches: Column) -> Column:
    told = [F.when(scratches > 0, F.format_string(a, scratches)).otherwise(b) for a, b in zip(SURFACE_SCRATCHED, SURFACE_WORN)]
    return _banded(severity, [F.lit(SURFACE_CLEAN), *told])


def surface_evidence(scratches: Column, texture: Column) -> Column:
    return F.concat(F.when(scratches > 0, F.format_string("%d linear artifacts detected; ", scratches)).otherwise(""), F.format_string("texture variance %.1f", texture))
