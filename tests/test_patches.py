"""Runs, parts, profiles and summed areas of images against plain loops, on oblong images too."""

import random
from statistics import fmean, pstdev, pvariance

import pytest
from pyspark.sql import functions as F

from foilframe.operators import patches as P


@pytest.fixture(scope="module")
def images():
    rng = random.Random(8)
    made = {k: [[rng.random() < p for _ in range(w)] for _ in range(h)] for k, (w, h, p) in enumerate([(9, 5, 0.5), (3, 12, 0.6), (20, 20, 0.55), (1, 1, 1.0), (6, 6, 0.0), (7, 1, 0.5)])}
    made[9] = [[x == 0 or y % 2 == 0 or (x == 14 and y % 4 == 1) for x in range(15)] for y in range(15)]  # one winding part
    return made


def sizes_of(cells):
    left, out = {(y, x) for y, row in enumerate(cells) for x, v in enumerate(row) if v}, []
    while left:
        part = [left.pop()]
        for y, x in part:
            near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
            left -= near
            part += near
        out.append(len(part))
    return out


def table(spark, images, kind):
    return spark.createDataFrame([(k, y, row) for k, cells in images.items() for y, row in enumerate(cells)], f"image int, y int, cells array<{kind}>")


def test_parts(spark, images):
    found = {r.image: (r.parts, r.largest) for r in P.part_sizes(P.parts(P.runs(table(spark, images, "boolean")))).collect()}
    want = {k: sizes_of(c) for k, c in images.items()}
    assert found == {k: (len(s), max(s)) for k, s in want.items() if s}


def test_profiles_and_roughness(spark, images):
    numbers = {k: [[float(x * 7 % 5 + y * y % 11 + v) for x, v in enumerate(row)] for y, row in enumerate(cells)] for k, cells in images.items()}
    profile = P.profiles(table(spark, numbers, "double"))
    got = {(r.image, r.axis): r.rough for r in P.roughness(profile).collect()}

    def rough(m):
        n = len(m)
        if n <= 5:
            return pstdev(m)
        mirrored = lambda i: m[-i if i < 0 else 2 * n - 2 - i if i >= n else i]
        return pstdev(abs(m[i] - sum(w * mirrored(i + k) for k, w in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1))) / 16) for i in range(n))

    for k, cells in numbers.items():
        assert got[k, "x"] == pytest.approx(rough([fmean(col) for col in zip(*cells)]), abs=1e-9)
        assert got[k, "y"] == pytest.approx(rough([fmean(row) for row in cells]), abs=1e-9)


def test_rectangles(spark, images):
    numbers = {k: [[float(3 * x + y + v) for x, v in enumerate(row)] for y, row in enumerate(cells)] for k, cells in images.items()}
    rects = [("a", 0, 0, 1, 1), ("b", 2, 1, 5, 3), ("far", 0, 0, 50, 2), ("none", 2, 2, 2, 4), ("c", 0, 0, 1, 7)]
    found = P.rectangle_stats(P.summed_area(table(spark, numbers, "double")), spark.createDataFrame(rects, "name string, y0 int, x0 int, y1 int, x1 int"))
    got = {(r.image, r.name): (r.mean, r.variance) for r in found.collect()}
    want = {}
    for k, cells in numbers.items():
        for name, y0, x0, y1, x1 in rects:
            if y1 <= len(cells) and x1 <= len(cells[0]) and y1 > y0:
                values = [v for row in cells[y0:y1] for v in row[x0:x1]]
                want[k, name] = (fmean(values), pvariance(values))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_lines_of_flat_patches(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, []), (3, None)], "i int, v array<int>")
    assert [(r.image, r.y, r.cells) for r in P.lines(df, "i", F.col("v"), 3).orderBy("y").collect()] == [(1, 0, [1, 2, 3]), (1, 1, [4, 5, 6])]
