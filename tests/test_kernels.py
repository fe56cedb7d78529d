import numpy as np
from pyspark.sql import functions as F

from foilframe.operators import kernels as K
from foilframe.plans import cards

W, H = K.CANONICAL


def clean():
    return np.full((H, W, 3), (50, 100, 150), dtype=np.uint8)


def test_components_match_flood_fill():
    rng = np.random.default_rng(3)
    for shape in ((8, 8), (17, 30), (1, 5)):
        mask = rng.random(shape) > 0.45
        label, n = K.components(mask)
        seen, count = np.zeros(shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not seen[y, x]:
                count += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < shape[0] and 0 <= b < shape[1] and mask[a, b] and not seen[a, b]:
                        seen[a, b] = count
                        stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert n == count and (label == seen).all()
    assert K.components(np.ones((2, 2), bool))[1] == 1 and K.components(np.zeros((2, 2), bool))[1] == 0


def test_clean_and_white_corners():
    f = K.features(clean())
    assert all(p["whitening"] == 0 for p in f["corners"]) and not f["is_textured"] and f["scratches"] == 0
    img = clean()
    for y in (slice(0, 60), slice(-60, None)):
        for x in (slice(0, 60), slice(-60, None)):
            img[y, x] = 255
    assert all(p["whitening"] > 0.5 for p in K.features(img)["corners"])


def test_photo_measures():
    rng = np.random.default_rng(42)
    img = clean()
    img[rng.random((H, W)) < 0.25] = 255
    assert K.features(img)["glare"] > 0.2
    assert K.features(np.zeros((H, W, 3), np.uint8))["dark"] == 1.0
    assert K.laplacian_variance(np.full((20, 20), 7.0)) == 0.0


def test_quad_found_and_not():
    img = np.full((600, 400, 3), 200, np.uint8)
    img[50:550, 50:400 - 50 + 7] = 0
    img[53:547, 53:354] = 255
    q = K.quad(img)
    assert q and 0.58 <= q["aspect"] <= 0.84 and q["rectangularity"] > 0.9
    assert K.quad(np.full((600, 400, 3), 100, np.uint8)) is None
    assert (K.corners_in_order(np.array([[100, 50], [100, 150], [0, 150], [0, 50]])) == [[0, 50], [100, 50], [100, 150], [0, 150]]).all()
    assert K.warped(img, q["quad"], (63, 88)).shape == (88, 63, 3)


def test_scratch_lines_and_boxes():
    a = np.full((200, 200), 100.0)
    for k in range(100):
        a[40 + k, 40 + k : 43 + k] = 220
    assert K.segments(K.edge_map(a), 30)
    assert K.first_jump(np.array([0] * 10 + [100] * 40)) == 9 and K.first_jump(np.zeros(50)) == 0
    assert K.border_widths(np.pad(np.zeros((100, 100)), 12, constant_values=200))["left"] == 11


def test_merged_boxes(spark):
    box = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
    cases = [[(0, 0, 10, 20), (15, 2, 30, 20), (60, 0, 70, 20)], [], [(5, 0, 9, 9)], [(30, 0, 40, 20), (0, 0, 10, 20), (12, 15, 30, 40)]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], f"k int, b {box}").select("k", K.merged_boxes(F.col("b")).alias("m")).collect()
    assert {r.k: [tuple(x) for x in r.m] for r in rows} == {0: [(0, 0, 30, 20), (60, 0, 70, 20)], 1: [], 2: [(5, 0, 9, 9)], 3: [(0, 0, 10, 20), (12, 15, 30, 40), (30, 0, 40, 20)]}


def test_unreadable_images_have_null_features(spark):
    good = clean()[:140, :100].tobytes()
    rows = [(1, 140, 100, bytearray(good)), (2, 140, 100, bytearray(b"xx")), (3, 140, 100, None), (4, None, None, bytearray(good)), (5, 0, 100, bytearray())]
    images = spark.createDataFrame(rows, "id int, height int, width int, data binary")
    got = {r.id: r for r in images.select("id", K.image_features("height", "width", "data").alias("f"), K.canonical_image("height", "width", "data").alias("c")).collect()}
    assert len(got[1].f.corners) == 4 and got[1].f.scratches == 0 and len(got[1].c.data) == W * H * 3
    for k in (2, 3, 4, 5):
        assert all(v is None for v in got[k].f) and all(v is None for v in got[k].c)
    assert images.limit(0).select(K.image_features("height", "width", "data").alias("f")).count() == 0


def test_family_by_border():
    def card(rgb, h=200, w=150):
        return np.full((h, w, 3), rgb, np.uint8)

    assert [K.family(card(c)) for c in ((175, 155, 100), (165, 155, 100), (175, 145, 100), (240, 220, 60), (50, 50, 50))] == ["vintage", "modern", "modern", "vintage", "modern"]
    assert K.family(card((240, 220, 60), 9, 50)) == "modern"
    wide = card((90, 90, 90), 1000, 100)
    wide[:3], wide[-3:], wide[:, :3], wide[:, -3:] = (4 * [[240, 220, 60]])
    assert K.family(wide) == "vintage"  # three hundredths of the shorter side


def test_pipelines(spark):
    small = np.full((140, 100, 3), (50, 100, 150), np.uint8)
    rows = [(140, 100, bytearray(small.tobytes()), "Pikachu", "4/102", "pokemon", "pokemon"), (140, 100, bytearray(b"xx"), "", None, "unknown", "trainer")]
    images = spark.createDataFrame(rows, "height int, width int, data binary, name string, number string, detected string, declared string")
    a, b = (sorted(r.body for r in cards.analyze(images).collect()) for _ in range(2))
    assert a == b and '"accepted":true' in "".join(a) and "TRAINER_NAME_NOT_FOUND" in "".join(a)
    graded = K.with_features(images.limit(1)).selectExpr("1 AS card_id", "f", "52.0 AS front_lr", "50.0 AS front_tb", "60.0 AS back_lr", "50.0 AS back_tb")
    g = cards.grade(graded).first()
    assert g.max_grade == 10.0 and abs(g.p7 + g.p8 + g.p9 + g.p10 - 1) < 1e-5
