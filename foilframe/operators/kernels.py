"""Image kernels: pixels to features, in numpy over Arrow batches. Decisions on the features are columns.

An image is a row of height, width and data, RGB bytes row by row. A row whose
data doesn't have height * width * 3 bytes, or has none, gives null features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = (744, 1040)  # width, height
WHITE, BRIGHT, DARK = 200, 250, 30
CORNER, BAND, INTERIOR, TILE = 0.08, 0.02, 0.05, 32
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")
EDGES = ("top", "bottom", "left", "right")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_D, _S, _I, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()
_PARTS = T.ArrayType(_struct(name=_S, whitening=_D, variance=_D, chipping_std=_D))
FEATURES = _struct(corners=_PARTS, edges=_PARTS, is_textured=_B, edge_density=_D, scratches=_I, texture=_D, laplacian=_D, glare=_D, dark=_D, family=_S, r=_D, g=_D, b=_D, centre_std=_D)
CANONICAL_TYPE = _struct(data=T.BinaryType(), warp_used=_B, aspect=_D, area_ratio=_D, rectangularity=_D, center_dist=_D)


def decode(height: int, width: int, data: bytes) -> np.ndarray | None:
    if not height or not width or data is None or len(data) != height * width * 3:
        return None
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)


def gray(img: np.ndarray) -> np.ndarray:
    return np.rint(img.astype(np.float64) @ [0.299, 0.587, 0.114])


def resized(img: np.ndarray, size: tuple[int, int] = CANONICAL) -> np.ndarray:
    """Bilinear, to width and height."""
    h, w = img.shape[:2]
    x = np.clip((np.arange(size[0]) + 0.5) * w / size[0] - 0.5, 0, w - 1)
    y = np.clip((np.arange(size[1]) + 0.5) * h / size[1] - 0.5, 0, h - 1)
    return sampled(img, *np.meshgrid(x, y))


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at x, y; places outside take the border."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = img[y0, x0] * (1 - fx) + img[y0, x1] * fx
    low = img[y1, x0] * (1 - fx) + img[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def _slid(a: np.ndarray, weights: dict[tuple[int, int], float]) -> np.ndarray:
    p = np.pad(a, 1, mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")
    h, w = a.shape
    return sum(k * p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for (dy, dx), k in weights.items())


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = _slid(a, {(-1, 1): 1, (0, 1): 2, (1, 1): 1, (-1, -1): -1, (0, -1): -2, (1, -1): -1})
    y = _slid(a, {(1, -1): 1, (1, 0): 2, (1, 1): 1, (-1, -1): -1, (-1, 0): -2, (-1, 1): -1})
    return x, y


def laplacian_variance(a: np.ndarray) -> float:
    return float(np.var(_slid(a, {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4})))


def circular_variance(a: np.ndarray) -> float:
    """0 where the strongest quarter of the gradients point one way, 1 where they point everywhere, 0.5 with too few of them."""
    x, y = sobel(a)
    size = np.hypot(x, y)
    mask = size > np.percentile(size, 75)
    if mask.sum() < 10:
        return 0.5
    angle = np.arctan2(y[mask], x[mask])
    return float(1 - np.hypot(np.sin(angle).sum(), np.cos(angle).sum()) / mask.sum())


def chipping_std(band: np.ndarray, along: int) -> float:
    """Spread of what a five-tap smoothing leaves of the brightness along an edge."""
    profile = band.mean(axis=1 - along)
    if len(profile) <= 5:
        return float(profile.std())
    padded = np.pad(profile, 2, mode="reflect")
    smooth = np.convolve(padded, _gauss5(), mode="valid")
    return float(np.abs(profile - smooth).std())


def _gauss5() -> np.ndarray:
    k = np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.1**2))
    return k / k.sum()


def edge_map(a: np.ndarray, low: float = 50, high: float = 100) -> np.ndarray:
    """Thin edges: local maxima of the gradient over low that hang together with one over high."""
    x, y = sobel(a)
    size = np.abs(x) + np.abs(y)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(y) <= 0.4142 * np.abs(x), np.abs(y) >= 2.4142 * np.abs(x)
    same = x * y > 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    weak = (size > low) & (size > before) & (size >= after)
    label, n = components(weak, eight=True)
    strong = np.zeros(n + 1, dtype=bool)
    strong[label[weak & (size > high)]] = True
    strong[0] = False
    return strong[label]


def components(mask: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Labels from 1 of the connected parts of a mask, in reading order of their first pixel; 0 outside.

    Every pixel takes the least number among its neighbours, with jumps along the
    numbers so far, until nothing changes.
    """
    h, w = mask.shape
    own = np.arange(1, h * w + 1).reshape(h, w)
    label = np.where(mask, own, 0)
    big = h * w + 1
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * eight
    while True:
        now = np.pad(np.where(mask, label, big), 1, constant_values=big)
        low = now[1:-1, 1:-1].copy()
        for dy, dx in steps:
            for s in (1, -1):
                np.minimum(low, now[1 + s * dy : 1 + s * dy + h, 1 + s * dx : 1 + s * dx + w], out=low)
        low = np.where(mask, low, 0)
        flat = low.ravel()
        while True:
            jumped = np.where(flat > 0, flat[np.maximum(flat, 1) - 1], 0)
            if (jumped == flat).all():
                break
            flat = jumped
        new = flat.reshape(h, w)
        if (new == label).all():
            break
        label = new
    roots, numbered = np.unique(label, return_inverse=True)
    shift = 0 if len(roots) and roots[0] == 0 else 1
    return numbered.reshape(h, w) + shift, len(roots) - (1 - shift)


def boxes(mask: np.ndarray, least: int = 30) -> list[tuple[int, int, int, int]]:
    """x0, y0, x1, y1 of the parts with at least so many pixels, from left to right."""
    label, n = components(mask)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        if len(y) >= least:
            out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return sorted(out)


def segments(edges: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """Straight thin parts of an edge map that are long enough, by their ends along their main direction."""
    label, n = components(edges, eight=True)
    out = []
    if not n:
        return out
    y, x = np.nonzero(label)
    k = label[y, x]
    order = np.argsort(k, kind="stable")
    for s, e in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(([0], np.cumsum(np.bincount(k)[1:]))))):
        px, py = x[order[s:e]].astype(float), y[order[s:e]].astype(float)
        if e - s < least / 2:
            continue
        cx, cy = px - px.mean(), py - py.mean()
        spread = np.cov(cx, cy)
        value, vector = np.linalg.eigh(spread)
        if value[0] > 4 or value[1] <= 0:
            continue
        t = cx * vector[0, 1] + cy * vector[1, 1]
        a, b = int(np.argmin(t)), int(np.argmax(t))
        if np.hypot(px[b] - px[a], py[b] - py[a]) >= least:
            out.append((int(px[a]), int(py[a]), int(px[b]), int(py[b])))
    return out


def line_contrast(a: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> float:
    """Brightness along a segment against that five pixels to either side."""
    h, w = a.shape
    length = max(1.0, np.hypot(x2 - x1, y2 - y1))
    t = np.linspace(0, 1, min(10, max(3, int(np.hypot(x2 - x1, y2 - y1) / 10))))
    px, py = (x1 + t * (x2 - x1)).astype(int), (y1 + t * (y2 - y1)).astype(int)
    nx, ny = -(y2 - y1) / length, (x2 - x1) / length
    inside = lambda x, y: a[y[ok], x[ok]] if (ok := (x >= 0) & (x < w) & (y >= 0) & (y < h)).any() else np.zeros(0)
    own = inside(px, py)
    near = np.concatenate([inside((px + o * nx).astype(int), (py + o * ny).astype(int)) for o in (-5, 5)])
    return float(abs(own.mean() - near.mean())) if len(own) and len(near) else 0.0


def tile_spread(a: np.ndarray, tile: int = TILE) -> float:
    """Spread of the tiles' variances; a last tile that just fits is not counted."""
    h, w = a.shape
    if h < tile or w < tile:
        return float(a.std())
    found = [a[y : y + tile, x : x + tile].var() for y in range(0, h - tile, tile) for x in range(0, w - tile, tile)]
    return float(np.std(found)) if found else 0.0


def border_widths(a: np.ndarray, lines: int = 5, reach: int = 50, step: float = 20) -> dict[str, float]:
    """Median place, for each side, of the first jump in brightness on scan lines inwards; sides without any are left out."""
    out = {}
    for side in EDGES:
        b = {"top": a.T, "bottom": a.T[:, ::-1], "left": a, "right": a[:, ::-1]}[side]
        rows = np.linspace(0.3, 0.7, lines) * (b.shape[0] - 1)
        found = [k for k in (first_jump(b[int(r), :reach], step) for r in rows) if k]
        if found:
            out[side] = float(np.median(found))
    return out


def first_jump(profile: np.ndarray, step: float = 20, start: int = 5, stop: int = 49) -> int:
    """First place in start..stop-1 where the profile changes by more than step, else 0."""
    jump = np.abs(np.diff(profile.astype(float)))
    hits = np.flatnonzero(jump[start:stop] > step)
    return int(hits[0]) + start if len(hits) else 0


def family(img: np.ndarray) -> str:
    """vintage, special or modern by the border's colour."""
    h, w = img.shape[:2]
    if min(h, w) < 10:
        return "modern"
    m = max(1, int(min(h, w) * 0.03))
    border = np.concatenate([p.reshape(-1, 3) for p in (img[:m], img[-m:], img[:, :m], img[:, -m:])]).astype(float)
    spread, (r, g, b) = border.std(axis=0).mean(), border.mean(axis=0)
    if spread < 25 and r > 170 and g > 150 and b < 120:  # fixed values
        return "vintage"
    return "special" if spread > 45 else "modern"


def corners_in_order(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    s, d = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def quad(img: np.ndarray) -> dict | None:
    """The card in a photo: the largest part that differs from the border, as four corners with their geometry."""
    a = gray(img)
    h, w = a.shape
    rim = np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])
    mask = np.abs(a - np.median(rim)) > 25
    if mask.mean() < 0.02:
        return None
    k = max(1, max(h, w) // 300)
    label, n = components(mask[::k, ::k])
    if not n:
        return None
    size = np.bincount(label.ravel())[1:]
    y, x = np.nonzero(label == int(size.argmax()) + 1)
    pts = np.stack([x, y], axis=1) * float(k)
    c = corners_in_order(pts)
    side = lambda i, j: np.hypot(*(c[i] - c[j]))
    wide, tall = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    if min(wide, tall) < 20:
        return None
    hull = 0.5 * abs(sum(c[i][0] * c[(i + 1) % 4][1] - c[(i + 1) % 4][0] * c[i][1] for i in range(4)))
    area = float(size.max()) * k * k
    fill = area / max(hull, 1.0)
    off = np.hypot(*(c.mean(axis=0) - [w / 2, h / 2])) / np.hypot(w, h)
    return {"quad": c, "aspect": float(min(wide, tall) / max(wide, tall)), "area_ratio": hull / (h * w), "rectangularity": float(min(1.0, fill, hull / max(1.0, wide * tall))), "center_dist": float(off)}


def warped(img: np.ndarray, corners: np.ndarray, size: tuple[int, int] = CANONICAL) -> np.ndarray:
    """The quadrilateral straightened to width and height."""
    w, h = size
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=float)
    rows, right = [], []
    for (x, y), (u, v) in zip(target, corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    return sampled(img, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d)


def features(img: np.ndarray) -> dict:
    """All features of one canonical image."""
    a = gray(img)
    h, w = a.shape
    ch, cw = max(1, int(h * CORNER)), max(1, int(w * CORNER))
    bh, bw = max(1, int(h * BAND)), max(1, int(w * BAND))
    corner = dict(zip(CORNERS, (a[:ch, :cw], a[:ch, -cw:], a[-ch:, :cw], a[-ch:, -cw:])))
    edge = dict(zip(EDGES, (a[:bh], a[-bh:], a[:, :bw], a[:, -bw:])))
    inner = a[int(h * INTERIOR) : h - int(h * INTERIOR), int(w * INTERIOR) : w - int(w * INTERIOR)]
    lines = edge_map(inner)
    density = float(lines.mean())
    textured = density > 0.10
    least = 80 if textured else 30
    kept = []
    for x1, y1, x2, y2 in segments(lines, least):
        length = np.hypot(x2 - x1, y2 - y1)
        if min(abs(x2 - x1), abs(y2 - y1)) / length > 0.1 or length > 2 * least:
            if not textured or line_contrast(inner, x1, y1, x2, y2) >= 30:
                kept.append((x1, y1, x2, y2))
    if textured and len(kept) >= 15:
        kept = []
    centre = img[int(h * 0.4) : int(h * 0.6), int(w * 0.3) : int(w * 0.7)].reshape(-1, 3).astype(float)
    mean = centre.mean(axis=0) if len(centre) else np.zeros(3)
    return {
        "corners": [{"name": k, "whitening": float((p > WHITE).mean()), "variance": circular_variance(p), "chipping_std": None} for k, p in corner.items()],
        "edges": [{"name": k, "whitening": float((p > WHITE).mean()), "variance": None, "chipping_std": chipping_std(p, 1 if k in ("top", "bottom") else 0)} for k, p in edge.items()],
        "is_textured": bool(textured), "edge_density": density, "scratches": len(kept), "texture": tile_spread(inner),
        "laplacian": laplacian_variance(a), "glare": float((a > BRIGHT).mean()), "dark": float((a < DARK).mean()), "family": family(img),
        "r": float(mean[0]), "g": float(mean[1]), "b": float(mean[2]), "centre_std": float(centre.std()) if len(centre) else 0.0,
    }


def _frame(rows: list[dict | None], names: list[str]) -> pd.DataFrame:
    """Rows as columns of objects, in which what is missing is None and not a number."""
    return pd.DataFrame({k: pd.Series([r.get(k) if r else None for r in rows], dtype=object) for k in names})


@F.pandas_udf(FEATURES)
def image_features(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
    """The features of each image; null ones where it can't be decoded."""
    images = [decode(h, w, x) for h, w, x in zip(height, width, data)]
    return _frame([None if img is None else features(img) for img in images], FEATURES.names)


@F.pandas_udf(CANONICAL_TYPE)
def canonical_image(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
    """The card straightened to the canonical size, or the photo resized where no card passes the relaxed gates; null where it can't be decoded."""
    rows: list[dict | None] = []
    for h, w, x in zip(height, width, data):
        img = decode(h, w, x)
        q = None if img is None else quad(img)
        good = q is not None and 0.58 <= q["aspect"] <= 0.84 and 0.08 <= q["area_ratio"] <= 0.97 and q["rectangularity"] >= 0.7
        geometry = {k: q[k] for k in ("aspect", "area_ratio", "rectangularity", "center_dist")} if q else {}
        rows.append(None if img is None else {"data": (warped(img, q["quad"]) if good else resized(img)).tobytes(), "warp_used": bool(good), **geometry})
    return _frame(rows, CANONICAL_TYPE.names)


def with_features(images: DataFrame) -> DataFrame:
    """images with a column f of features; the pixels are dropped."""
    return images.withColumn("f", image_features("height", "width", "data")).drop("data")


# ---- kernels over short arrays, as expressions --------------------------------


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def population_variance(x: Column) -> Column:
    m = mean(x)
    return total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)


def share_over(x: Column, bound: float) -> Column:
    return F.size(F.filter(x, lambda v: v > bound)) / F.size(x)


def merged_boxes(boxes: Column, gap: int = 15, overlap: float = 0.4) -> Column:
    """Boxes (x0, y0, x1, y1) from left to right, each joined to the one before while it is near and level with it; the joined box grows."""
    last = lambda out: F.element_at(out, -1)

    def near(a: Column, b: Column) -> Column:
        level = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])) / F.greatest(F.lit(1), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))
        return (b["x0"] - a["x1"] <= gap) & (level > overlap)

    def joined(a: Column, b: Column) -> Column:
        return F.struct(*[f(a[k], b[k]).alias(k) for k, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))])

    def take(out: Column, b: Column) -> Column:
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined(last(out), b)))
        return F.when(F.size(out) == 0, F.array(b)).when(near(last(out), b), grown).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(F.sort_array(boxes), F.slice(boxes, 1, 0), take)
