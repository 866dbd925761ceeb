"""Features of card pictures: perceptual hashes, bounds, borders, wear, photo quality.

Pictures are rows (image_id, side, height, width, pixels: RGB bytes, row by row). Every job streams them through numpy in
Arrow batches of few megabytes and drops the pixels at once; `analyze_images` does all card features in a single pass.
Pictures are scaled by area averages, so results are not bit-equal to a browser's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import arrow_ready

LUMA = np.array([0.299, 0.587, 0.114])
BORDER = "struct<left:double,right:double,top:double,bottom:double,lr:double,tb:double>"
BOX = "left long, right long, top long, bottom long"
DING = "image_id long, side string, type string, location string, severity double"
#: Fixed values of the backend's detector: sizes of corners and edges as shares of the picture.
CORNER_SHARE, EDGE_SHARE = 0.12, 0.05


def image_job(images: DataFrame, rows: Callable[[int, str, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """rows(image_id, side, rgb) of every picture; pictures whose bytes do not fit their size give nothing."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            found = []
            for image_id, side, h, w, raw in zip(*(batch.column(c).to_pylist() for c in ("image_id", "side", "height", "width", "pixels")), strict=True):
                if raw and h and w and len(raw) == 3 * h * w:
                    found += rows(image_id, side, np.frombuffer(raw, dtype=np.uint8).reshape(h, w, 3))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return arrow_ready(images).select(F.col("image_id").cast("long").alias("image_id"), "side", "height", "width", "pixels").mapInArrow(run, schema)


def milli(rgb: np.ndarray) -> np.ndarray:
    """Luminance in thousandths, exact."""
    return rgb[..., 0].astype(np.int64) * 299 + rgb[..., 1].astype(np.int64) * 587 + rgb[..., 2].astype(np.int64) * 114


def luminance(rgb: np.ndarray) -> np.ndarray:
    return milli(rgb) / 1000


def half_up(x):
    return np.floor(np.asarray(x) + 0.5)


def area_weights(size: int, target: int) -> np.ndarray:
    """target x size: each row averages an equal share of the source."""
    edges = np.linspace(0, size, target + 1)
    k = np.arange(size)
    cover = np.clip(np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def resize(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    return area_weights(gray.shape[0], h) @ gray @ area_weights(gray.shape[1], w).T


# ---- hashes ----


def equalize(gray: np.ndarray) -> np.ndarray:
    """Histogram equalisation over 256 levels."""
    level = np.clip(half_up(np.round(gray, 6)), 0, 255).astype(np.int64)  # averages of equal pixels may miss a half by rounding
    cdf = np.cumsum(np.bincount(level.ravel(), minlength=256))
    least = cdf[cdf > 0][0]
    return np.zeros(gray.shape) if gray.size == least else half_up((cdf - least) / (gray.size - least) * 255)[level]


_K = np.arange(32)
_DCT = np.cos(np.pi * np.arange(8)[:, None] * (2 * _K + 1) / 64) * np.where(np.arange(8) == 0, 32**-0.5, 0.25)[:, None]


def phash(gray: np.ndarray, equal: bool = True) -> str:
    """16 hex digits: which of the 63 low frequencies of the 32x32 picture exceed their median; the last bit is 0."""
    small = resize(gray, 32, 32)
    low = (_DCT @ (equalize(small) if equal else small) @ _DCT.T).ravel()[1:]
    bits = "".join("1" if v > np.median(low) else "0" for v in low) + "0"
    return f"{int(bits, 2):016x}"


def phash_images(images: DataFrame, equal: bool = True) -> DataFrame:
    return image_job(images, lambda i, s, rgb: [(i, s, phash(luminance(rgb), equal))], "image_id long, side string, hash string")


# ---- bounds ----


def cell_stats(gray: np.ndarray, x0: int, y0: int, nx: int, ny: int, cw: int, ch: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of every cell of a grid, each sampled every step pixels."""
    ys = np.minimum(y0 + (np.arange(ny)[:, None] * ch + np.arange(0, ch, step)), gray.shape[0] - 1)
    xs = np.minimum(x0 + (np.arange(nx)[:, None] * cw + np.arange(0, cw, step)), gray.shape[1] - 1)
    v = gray[ys.ravel()][:, xs.ravel()].reshape(ny, ys.shape[1], nx, xs.shape[1])
    mean = v.mean(axis=(1, 3))
    return mean, np.maximum((v * v).mean(axis=(1, 3)) - mean**2, 0)


def cell_rows(rgb: np.ndarray, grid: int, step: int = 2) -> list[tuple]:
    """(row, column, samples, sum, sum of squares) of every cell of a grid, in thousandths; one row of nulls without cells."""
    light = milli(rgb)
    ch, cw = light.shape[0] // grid, light.shape[1] // grid
    if not (ch and cw):
        return [(None, None, None, None, None)]
    v = light[: ch * grid, : cw * grid].reshape(grid, ch, grid, cw)[:, ::step, :, ::step]
    total, squares = v.sum(axis=(1, 3)), (v * v).sum(axis=(1, 3))
    n = v.shape[1] * v.shape[3]
    return [(y, x, n, int(total[y, x]), int(squares[y, x])) for y in range(grid) for x in range(grid)]


def coarse_bounds(images: DataFrame, grid: int = 16, share: float = 0.12, least: float = 30, padding: int = 5) -> DataFrame:
    """image_id, side, left, right, top, bottom, method: the box around cells of high variance; else the middle 80 percent.

    Python sums the cells of each picture; what follows is Spark's. image_id and side name a picture.
    """
    cells = image_job(
        images, lambda i, s, rgb: [(i, s, *rgb.shape[:2], *c) for c in cell_rows(rgb, grid)],
        "image_id long, side string, h long, w long, y long, x long, n long, total long, squares long",
    )
    mean = F.col("total") / F.col("n")
    var = F.greatest((F.col("squares") / F.col("n") - mean * mean) / 1e6, F.lit(0.0))
    most = F.max("var").over(Window.partitionBy("image_id", "side"))
    marked = cells.withColumn("var", var).withColumn("high", F.col("var") > F.greatest(F.lit(float(least)), most * share))
    ch, cw = F.floor(F.col("h") / grid), F.floor(F.col("w") / grid)
    edge = lambda f, c: f(F.when(F.col("high"), F.col(c)))
    box = marked.groupBy("image_id", "side", "h", "w").agg(edge(F.min, "x").alias("x0"), edge(F.max, "x").alias("x1"), edge(F.min, "y").alias("y0"), edge(F.max, "y").alias("y1")).withColumns(
        {
            "l": F.greatest(F.lit(0), F.col("x0") * cw - padding), "r": F.least(F.col("w"), (F.col("x1") + 1) * cw + padding),
            "t": F.greatest(F.lit(0), F.col("y0") * ch - padding), "b": F.least(F.col("h"), (F.col("y1") + 1) * ch + padding),
        }
    )
    good = F.coalesce((F.col("x0").isNotNull()) & (F.col("r") - F.col("l") >= 50) & (F.col("b") - F.col("t") >= 50), F.lit(False))
    x, y = F.floor(F.col("w") * 0.1), F.floor(F.col("h") * 0.1)
    pick = lambda found, other, name: F.when(good, found).otherwise(other).cast("long").alias(name)
    return box.select(
        "image_id", "side", pick(F.col("l"), x, "left"), pick(F.col("r"), x + F.floor(F.col("w") * 0.8), "right"),
        pick(F.col("t"), y, "top"), pick(F.col("b"), y + F.floor(F.col("h") * 0.8), "bottom"), F.when(good, "variance").otherwise("fallback").alias("method"),
    )


def line_variance(gray: np.ndarray, axis: int, lines: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Variance along each line (axis 0: columns, 1: rows) between lo and hi, about 60 samples each."""
    side = gray if axis == 0 else gray.T
    at = np.minimum(np.arange(lo, max(hi, lo), max(1, (hi - lo) // 60)), side.shape[0] - 1)
    if not len(at):
        return np.zeros(len(lines))
    v = side[at][:, np.clip(lines, 0, side.shape[1] - 1)]
    return (v * v).mean(axis=0) - v.mean(axis=0) ** 2


def first_over(values: np.ndarray, limit: float) -> int | None:
    found = np.flatnonzero(values > limit)
    return int(found[0]) if len(found) else None


def scan_bounds(gray: np.ndarray) -> tuple[int, int, int, int]:
    """The largest box of four variance limits, scanning inwards from the picture's edges; else the whole picture."""
    h, w = gray.shape
    best, area = (0, w - 1, 0, h - 1), 0
    ranges = []
    for axis, n, other in ((0, w, h), (1, h, w)):
        lo, hi = int(other * 0.1), int(other * 0.9)
        ahead, behind = np.arange(0, int(np.ceil(n * 0.4))), np.arange(n - 1, int(np.floor(n * 0.6)), -1)
        ranges.append((ahead, line_variance(gray, axis, ahead, lo, hi), behind, line_variance(gray, axis, behind, lo, hi), n))
    for limit in (15, 25, 40, 60):
        box = []
        for ahead, va, behind, vb, n in ranges:
            a, b = first_over(va, limit), first_over(vb, limit)
            box += [0 if a is None else int(ahead[a]), n - 1 if b is None else int(behind[b])]
        cw, ch = box[1] - box[0], box[3] - box[2]
        if cw * ch > area and cw > w * 0.15 and ch > h * 0.15:
            best, area = tuple(box), cw * ch
    return best


def edge_light(gray: np.ndarray, axis: int, pos: np.ndarray, lo: float, hi: float, n: int = 16) -> np.ndarray:
    """Mean luminance of lines at pos, n samples between lo and hi."""
    side = gray if axis == 0 else gray.T
    at = np.clip(half_up(lo + (hi - lo) * (np.arange(n) + 0.5) / n).astype(int), 0, side.shape[0] - 1)
    return side[at][:, np.clip(pos, 0, side.shape[1] - 1)].mean(axis=0)


def fine_bounds(gray: np.ndarray) -> tuple[int, int, int, int]:
    """left, right, top, bottom: cells of high variance on a 32x32 grid, each edge moved to its sharpest step."""
    h, w = gray.shape
    cw, ch = w // 32, h // 32
    if cw < 2 or ch < 2:
        return 0, w - 1, 0, h - 1
    _, var = cell_stats(gray, 0, 0, 32, 32, cw, ch, max(1, min(cw, ch) // 5))
    ys, xs = np.nonzero(var > max(30, var.max() * 0.12))
    if len(xs) < 6:
        return scan_bounds(gray)
    left, right = int(xs.min()) * cw, min(w - 1, int(xs.max() + 1) * cw)
    top, bottom = int(ys.min()) * ch, min(h - 1, int(ys.max() + 1) * ch)
    reach = min(cw * 2, 60)

    def sharpest(axis: int, start: int, way: int, stop: int, lo: int, hi: int) -> int:
        pos = start + way * np.arange(reach)
        pos = pos[: int(np.argmax(way * pos >= way * stop - 10))] if (way * pos >= way * stop - 10).any() else pos
        if not len(pos):
            return start
        step = np.abs(edge_light(gray, axis, pos, lo, hi) - edge_light(gray, axis, pos - way, lo, hi))
        k = int(np.argmax(step))
        return int(pos[k]) if step[k] > 0 else start

    left = sharpest(0, left, 1, right, top, bottom)
    right = sharpest(0, right, -1, left, top, bottom)
    top = sharpest(1, top, 1, bottom, left, right)
    bottom = sharpest(1, bottom, -1, top, left, right)
    return (left, right, top, bottom) if right - left > w * 0.08 and bottom - top > h * 0.08 else scan_bounds(gray)


def detect_bounds(images: DataFrame, method: str = "fine") -> DataFrame:
    """image_id, side, left, right, top, bottom, method."""
    if method != "fine":
        return coarse_bounds(images)
    return image_job(images, lambda i, s, rgb: [(i, s, *fine_bounds(luminance(rgb)), "fine")], f"image_id long, side string, {BOX}, method string")


# ---- borders ----


def borders(gray: np.ndarray, box: tuple[int, int, int, int]) -> tuple[float, float, float, float, float, float]:
    """Left, right, top, bottom border and the two ratios: medians over six variance limits; else where the light
    leaves that of the card's edge; else five and seven percent."""
    left, right, top, bottom = box
    cw, ch = right - left, bottom - top
    along_y, along_x = (top + int(ch * 0.1), top + int(ch * 0.9)), (left + int(cw * 0.1), left + int(cw * 0.9))
    scans = []
    for axis, near, far, size, along in ((0, left, right, cw, along_y), (1, top, bottom, ch, along_x)):
        depth = np.arange(int(size * 0.01), int(size * 0.25))
        scans += [(depth, line_variance(gray, axis, near + depth, *along)), (depth, line_variance(gray, axis, far - depth, *along))]
    valid = []
    for limit in (50, 100, 150, 200, 300, 500):
        at = [first_over(v, limit) for _, v in scans]
        four = [0 if k is None else int(d[k]) for k, (d, _) in zip(at, scans, strict=True)]
        if min(four) > 0 and 0.01 < (four[0] + four[1]) / cw < 0.35 and 0.01 < (four[2] + four[3]) / ch < 0.35:
            valid.append(four)
    if valid:
        found = np.median(np.array(valid), axis=0).tolist()
    else:
        found = []
        for axis, near, way, lo, hi in ((0, left, 1, along_y[0], bottom - int(ch * 0.1)), (0, right, -1, along_y[0], bottom - int(ch * 0.1)), (1, top, 1, along_x[0], right - int(cw * 0.1)), (1, bottom, -1, along_x[0], right - int(cw * 0.1))):
            depth = np.arange(max(3, int(half_up(abs(hi - lo) * 0.18))))
            light = edge_light(gray, axis, near + way * depth, lo, hi, 20)
            k = first_over(np.abs(light[3:] - light[:3].mean()), 20)
            found.append(0 if k is None else k + 3)
        if not (min(found) > 0 and 0.01 < (found[0] + found[1]) / max(1, cw) < 0.18 and 0.01 < (found[2] + found[3]) / max(1, ch) < 0.18):
            found = [int(cw * 0.05)] * 2 + [int(ch * 0.07)] * 2
    ratio = [float(half_up((a / (a + b) * 100 if a + b else 50) * 10) / 10) for a, b in (found[:2], found[2:])]
    return (*map(float, found), *ratio)


# ---- wear ----


def corner_wear(rgb: np.ndarray, gray: np.ndarray, box: tuple[int, int, int, int]) -> list[tuple[str, float, float, bool, int]]:
    """(corner, wear, sharpness, ding, severity): white or off-colour tips that are also soft."""
    left, right, top, bottom = box
    h, w = gray.shape
    cw, ch = right - left, bottom - top
    size = max(24, int(min(cw, ch) * 0.09))
    xs = np.minimum(w - 1, left + half_up(cw * 0.25 + np.arange(12) * (cw * 0.5 / 12)).astype(int))
    border = rgb[min(h - 1, top + int(half_up(ch * 0.03))), xs].astype(float).mean(axis=0)
    dark = float(border @ LUMA) < 80
    step = max(4, int(min(cw, ch) / 40))
    inner = gray[np.ix_(np.minimum(np.arange(top + int(ch * 0.1), bottom - int(ch * 0.1), step), h - 1), np.minimum(np.arange(left + int(cw * 0.1), right - int(cw * 0.1), step), w - 1))]
    holo = inner.size > 0 and inner.var() > 800
    wear_limit, sharp_limit = (0.22, 3) if holo else (0.15, 5)
    d = np.arange(size)
    out = []
    for name, x0, y0, dx, dy in (
        ("TOP LEFT", left, top, d, d), ("TOP RIGHT", right - size, top, size - d, d), ("BOTTOM LEFT", left, bottom - size, d, size - d), ("BOTTOM RIGHT", right - size, bottom - size, size - d, size - d),
    ):
        tip = dy[:, None] + dx[None, :] <= int(size * 0.42)
        ys, xs = np.clip(y0 + d, 0, h - 1), np.clip(x0 + d, 0, w - 1)
        part, light = rgb[np.ix_(ys, xs)].astype(int), gray[np.ix_(ys, xs)]
        r, g, b = part[..., 0], part[..., 1], part[..., 2]
        wear = ((light > 215) & (abs(r - g) < 25) & (abs(g - b) < 25))[tip].mean()
        if dark:
            off = np.abs(part - border).sum(axis=2)
            wear = max(wear, ((off > 60) & (light > float(border @ LUMA) + 40))[tip].mean() * 0.7)
        gx = np.abs(gray[np.ix_(ys, np.minimum(xs + 1, w - 1))] - light)
        gy = np.abs(gray[np.ix_(np.minimum(ys + 1, h - 1), xs)] - light)
        inside = tip.copy()
        inside[-1, :] = inside[:, -1] = False
        sharp = float(np.hypot(gx, gy)[inside].mean()) if inside.any() else 0.0
        even = light[tip].mean() > 180 and light[tip].var() < 600
        out.append((name, float(wear), sharp, bool(not even and wear > wear_limit and sharp < sharp_limit), 3 if wear > 0.25 else 2 if wear > 0.15 else 1))
    return out


def edge_wear(rgb: np.ndarray, gray: np.ndarray, box: tuple[int, int, int, int]) -> list[tuple[str, float, float, bool, int]]:
    """(edge, white share, roughness, ding, severity) from 80 short scans across each edge."""
    left, right, top, bottom = box
    h, w = gray.shape
    cw, ch = right - left, bottom - top
    deep = max(5, int(min(cw, ch) * 0.025))
    xs, ys = left + (cw * np.arange(1, 81) / 81).astype(int), top + (ch * np.arange(1, 81) / 81).astype(int)
    d = np.arange(deep)
    out = []
    for name, yy, xx in (
        ("TOP", top + d[None, :], xs[:, None]), ("BOTTOM", bottom - deep + d[None, :], xs[:, None]), ("LEFT", ys[:, None], left + d[None, :]), ("RIGHT", ys[:, None], right - deep + d[None, :]),
    ):
        yy, xx = np.broadcast_arrays(np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1))
        part, light = rgb[yy, xx].astype(int), gray[yy, xx]
        white = float(((light > 220) & (abs(part[..., 0] - part[..., 1]) < 18) & (abs(part[..., 1] - part[..., 2]) < 18)).mean())
        rough = float(np.abs(np.diff(light.ravel())).sum() / light.size)
        out.append((name, white, rough, white > 0.08 or rough > 28, 3 if white > 0.2 else 2 if white > 0.12 else 1))
    return out


# Fixed values: (least anomaly share, least scratch share) for severity 3, 2 and 1 of each kind of surface.
SURFACE = {
    "metallic": ((0.40, 0.32), (0.28, 0.22), (0.20, 0.14)), "back": ((0.45, 0.35), (0.30, 0.22), (0.20, 0.14)),
    "holo": ((0.35, 0.28), (0.22, 0.18), (0.14, 0.10)), "plain": ((0.15, 0.12), (0.08, 0.06), (0.04, 0.03)),
}


def surface_wear(gray: np.ndarray, box: tuple[int, int, int, int], back: bool) -> tuple[int, float, float, bool, list[tuple]]:
    """Severity (0: none), anomaly and scratch share in percent, holo, and up to six defect regions (x, y, w, h, severity).

    Cells of a 24x32 grid are held against their four neighbours and the whole surface's variance.
    """
    left, right, top, bottom = box
    cw, ch = right - left, bottom - top
    x0, y0 = left + int(cw * 0.1), top + int(ch * 0.1)
    w, h = (right - int(cw * 0.1) - x0) // 24, (bottom - int(ch * 0.1) - y0) // 32
    if w < 1 or h < 1:
        return 0, 0.0, 0.0, False, []
    mean, var = cell_stats(gray, x0, y0, 24, 32, w, h, 2)
    whole = float((var + mean**2).mean() - mean.mean() ** 2)
    holo, busy_back = whole > 800, back and whole > 400
    metallic = holo and not back and (var > 300).mean() > 0.7
    high, low = (55, 38) if busy_back else (48, 32) if metallic else (35, 22) if holo else (25, 15)
    times, floor = (3.5, 400) if holo else (4.5, 600) if busy_back else (2.8, 250)
    m, v = mean[1:-1, 1:-1], var[1:-1, 1:-1]
    diff = np.abs(m - (mean[:-2, 1:-1] + mean[2:, 1:-1] + mean[1:-1, :-2] + mean[1:-1, 2:]) / 4)
    odd, mark, scratch = diff > high, (diff > low) & (diff <= high), (v > whole * times) & (v > floor)
    anomaly, scratched = float(odd.mean() + 0.3 * mark.mean()), float(scratch.mean())
    limits = SURFACE["metallic" if metallic else "back" if busy_back else "holo" if holo else "plain"]
    severity = next((3 - k for k, (a, s) in enumerate(limits) if anomaly > a or scratched > s), 0)
    cells = [(float(diff[y, x]), x + 1, y + 1) for y, x in zip(*np.nonzero(odd | mark), strict=True)] + [(float(v[y, x]), x + 1, y + 1) for y, x in zip(*np.nonzero(scratch), strict=True)]
    return severity, float(half_up(anomaly * 10000) / 100), float(half_up(scratched * 10000) / 100), bool(holo), regions(cells, x0, y0, w, h)


def regions(cells: list[tuple[float, int, int]], x0: int, y0: int, w: int, h: int, most: int = 6) -> list[tuple]:
    """Greedy clusters: the worst free cell with all free cells within two of it, padded by three cells' width."""
    order = sorted(cells, key=lambda c: -c[0])
    free = {(x, y) for _, x, y in cells}
    out = []
    for worst, x, y in order:
        if (x, y) not in free:
            continue
        near = {(a, b) for a, b in free if abs(a - x) <= 2 and abs(b - y) <= 2}
        free -= near
        xs, ys = [x0 + a * w for a, _ in near], [y0 + b * h for _, b in near]
        pad = 3 * w
        out.append((min(xs) - pad, min(ys) - pad, max(xs) - min(xs) + w + 2 * pad, max(ys) - min(ys) + h + 2 * pad, worst))
        if len(out) == most:
            break
    return out


def wear_rows(image_id: int, side: str, rgb: np.ndarray, gray: np.ndarray, box: tuple, kinds=("corner", "edge", "surface")) -> list[tuple]:
    """Ding rows of one picture."""
    label = "FRONT" if side == "front" else "BACK"
    out = []
    if "corner" in kinds:
        out += [(image_id, label, "CORNER WEAR", f"{label} / {n}", float(s)) for n, _, _, ding, s in corner_wear(rgb, gray, box) if ding]
    if "edge" in kinds:
        out += [(image_id, label, "EDGE WEAR", f"{label} / {n}", float(s)) for n, _, _, ding, s in edge_wear(rgb, gray, box) if ding]
    if "surface" in kinds:
        severity = surface_wear(gray, box, side == "back")[0]
        out += [(image_id, label, "SURFACE / PLAY WEAR", label, float(severity))] if severity else []
    return out


def dings_of(images: DataFrame, kinds=("corner", "edge", "surface")) -> DataFrame:
    """image_id, side, type, location, severity of all wear, within the fine bounds."""

    def rows(i, s, rgb):
        gray = luminance(rgb)
        return wear_rows(i, s, rgb, gray, fine_bounds(gray), kinds)

    return image_job(images, rows, DING)


def analyze_images(images: DataFrame) -> DataFrame:
    """image_id, side, bounds, border widths and ratios, surface rates, holo, and dings (centering included): one pass."""
    schema = f"image_id long, side string, {BOX}, border {BORDER}, anomaly double, scratch double, holo boolean, dings array<struct<type:string,location:string,severity:double>>"

    def rows(i, s, rgb):
        gray = luminance(rgb)
        box = fine_bounds(gray)
        b = borders(gray, box)
        _, anomaly, scratch, holo, _ = surface_wear(gray, box, s == "back")
        worst = max(b[4], 100 - b[4], b[5], 100 - b[5]) - (55 if s == "front" else 65)
        label = "FRONT" if s == "front" else "BACK"
        dings = [{"type": "CENTERING", "location": label, "severity": worst}] if worst > 0 else []
        dings += [{"type": t, "location": at, "severity": v} for _, _, t, at, v in wear_rows(i, s, rgb, gray, box)]
        border = dict(zip(("left", "right", "top", "bottom", "lr", "tb"), b, strict=True))
        return [(i, label, *box, border, anomaly, scratch, holo, dings)]

    return image_job(images, rows, schema)


def measure_centering(images: DataFrame) -> DataFrame:
    """image_id, side, border widths and ratios within the fine bounds."""

    def rows(i, s, rgb):
        gray = luminance(rgb)
        return [(i, s, *borders(gray, fine_bounds(gray)))]

    return image_job(images, rows, "image_id long, side string, border_l double, border_r double, border_t double, border_b double, lr double, tb double")


def surface_regions(images: DataFrame) -> DataFrame:
    """image_id, side, rank, x, y, width, height, severity of the worst regions."""

    def rows(i, s, rgb):
        gray = luminance(rgb)
        return [(i, s, k, *map(int, r[:4]), float(r[4])) for k, r in enumerate(surface_wear(gray, fine_bounds(gray), s == "back")[4], start=1)]

    return image_job(images, rows, "image_id long, side string, rank int, x long, y long, width long, height long, severity double")


# ---- quality ----


def laplacian(gray: np.ndarray) -> np.ndarray:
    return 4 * gray[1:-1, 1:-1] - gray[:-2, 1:-1] - gray[2:, 1:-1] - gray[1:-1, :-2] - gray[1:-1, 2:]


def photo_sums(rgb: np.ndarray) -> tuple[int, ...]:
    """Samples, sum and sum of squares of the edges' strength; samples, dark and bright ones; contrast. In thousandths, of every
    second pixel (fourth for contrast)."""
    light = milli(rgb)
    h, w = light.shape
    edges = np.abs(laplacian(light))[::2, ::2]
    some = light[::2, ::2]
    middle = light[int(h * 0.2) : int(np.ceil(h * 0.8)) : 4, int(w * 0.2) : int(np.ceil(w * 0.8)) : 4]
    return (edges.size, int(edges.sum()), int((edges * edges).sum()), some.size, int((some < 30_000).sum()), int((some > 240_000).sum()), int(middle.max() - middle.min()))


def photo_quality(images: DataFrame) -> DataFrame:
    """image_id, side, score, acceptable, rounded measures, warnings. Python sums the pixels; the score is Spark's."""
    sums = image_job(
        images, lambda i, s, rgb: [(i, s, *photo_sums(rgb))] if min(rgb.shape[:2]) > 2 else [],
        "image_id long, side string, n long, total long, squares long, seen long, n_dark long, n_bright long, spread long",
    )
    mean = F.col("total") / F.col("n")
    measured = sums.select(
        "image_id", "side", ((F.col("squares") / F.col("n") - mean * mean) / 1e6).alias("sharp"), (F.col("n_dark") / F.col("seen")).alias("dark"),
        (F.col("n_bright") / F.col("seen")).alias("bright"), (F.col("spread") / 1000).alias("contrast"),
    )
    sharp, dark, bright, contrast = (F.col(c) for c in ("sharp", "dark", "bright", "contrast"))
    checks = (
        (sharp < 100, 40, "blur:high"), ((sharp >= 100) & (sharp < 300), 15, "blur:medium"), (dark > 0.4, 25, "dark:high"), ((dark > 0.25) & (dark <= 0.4), 10, "dark:medium"),
        (bright > 0.3, 25, "bright:high"), ((bright > 0.15) & (bright <= 0.3), 10, "bright:medium"), (contrast < 50, 10, "contrast:medium"),
    )
    lost = [F.when(test, points).otherwise(0) for test, points, _ in checks]
    whole = lambda x, name: F.floor(x + 0.5).cast("long").alias(name)
    scored = measured.withColumn("points", (F.lit(100) - sum(lost[1:], lost[0])).cast("int"))
    return scored.select(
        "image_id", "side", F.greatest(F.col("points"), F.lit(0)).alias("score"), (F.col("points") >= 60).alias("acceptable"),
        whole(sharp, "sharpness"), whole(dark * 100, "dark"), whole(bright * 100, "bright"), whole(contrast, "contrast"),
        F.array_compact(F.array(*(F.when(test, name) for test, _, name in checks))).alias("warnings"),
    )


def blur(images: DataFrame, limit: float = 100) -> DataFrame:
    """image_id, side, variance of the signed Laplacian of 8-bit grey (mirrored edges), blurry."""

    def sums(rgb: np.ndarray) -> tuple[int, int, int]:
        edges = laplacian(np.pad((milli(rgb) + 500) // 1000, 1, mode="reflect"))
        return edges.size, int(edges.sum()), int((edges * edges).sum())

    found = image_job(images, lambda i, s, rgb: [(i, s, *sums(rgb))] if min(rgb.shape[:2]) > 1 else [], "image_id long, side string, n long, total long, squares long")
    mean = F.col("total") / F.col("n")
    return found.select("image_id", "side", (F.col("squares") / F.col("n") - mean * mean).alias("variance")).withColumn("blurry", F.col("variance") < limit)


def backend_wear(rgb: np.ndarray) -> list[tuple[str, str, int, float]]:
    """(type, location, severity, confidence): whitened corners and damaged edges of a cropped card.

    Parts of an even colour are borders and skipped. Corners count inside the triangle at their tip.
    """
    h, w = rgb.shape[:2]
    ch, cw, eh, ew = int(h * CORNER_SHARE), int(w * CORNER_SHARE), int(h * EDGE_SHARE), int(w * EDGE_SHARE)

    def even(part: np.ndarray, spread: float) -> bool:
        mean = part.mean(axis=(0, 1))
        return mean.max() - mean.min() > 30 and part.std(axis=(0, 1)).mean() < spread

    grey = lambda part: half_up(luminance(part))
    out = []
    if ch >= 2 and cw >= 2:
        y, x = np.mgrid[0:ch, 0:cw]
        for name, part, dy, dx in (
            ("TOP_LEFT", rgb[:ch, :cw], y, x), ("TOP_RIGHT", rgb[:ch, w - cw :], y, cw - x), ("BOTTOM_LEFT", rgb[h - ch :, :cw], ch - y, x), ("BOTTOM_RIGHT", rgb[h - ch :, w - cw :], ch - y, cw - x),
        ):
            tip = dx / (cw // 2) + dy / (ch // 2) <= 1
            if not even(part, 40) and tip.any():
                bright = float((grey(part)[tip] > 235).mean())
                if bright > 0.25:
                    out.append(("CORNER_WHITENING", name, min(5, int(bright * 15) + 1), min(0.9, bright * 1.5)))
    for name, part in (("TOP", rgb[:eh, cw : w - cw]), ("BOTTOM", rgb[h - eh :, cw : w - cw]), ("LEFT", rgb[ch : h - ch, :ew]), ("RIGHT", rgb[ch : h - ch, w - ew :])):
        if part.size and not even(part, 35):
            bright = float((grey(part) > 240).mean())
            if bright > 0.2:
                out.append(("EDGE_DAMAGE", name, min(5, int(bright * 20) + 1), min(0.85, bright * 2)))
    return out


def backend_defects(images: DataFrame) -> DataFrame:
    """image_id, side, type, location, severity, confidence."""
    return image_job(images, lambda i, s, rgb: [(i, s, *x) for x in backend_wear(rgb)], "image_id long, side string, type string, location string, severity int, confidence double")


def corners_of_mask(mask: np.ndarray) -> tuple[tuple[int, int], ...] | None:
    """Top left, top right, bottom left, bottom right (x, y) of a mask's outline; null if it is too small."""
    h, w = mask.shape
    core = mask[1:-1, 1:-1]
    edge = np.zeros_like(mask)
    edge[1:-1, 1:-1] = core & ~(mask[:-2, 1:-1] & mask[2:, 1:-1] & mask[1:-1, :-2] & mask[1:-1, 2:])
    ys, xs = np.nonzero(edge)
    if len(xs) < 50:
        ys, xs = np.nonzero(mask)
        if len(xs) < 100:
            return None
    if np.ptp(xs) < w * 0.2 or np.ptp(ys) < h * 0.2:
        return None
    total, diff = xs + ys, xs - ys
    return tuple((int(xs[k]), int(ys[k])) for k in (total.argmin(), diff.argmax(), diff.argmin(), total.argmax()))


def mask_corners(masks: DataFrame) -> DataFrame:
    """image_id, side and the corners of each mask picture (any channel over 128)."""

    def rows(i, s, rgb):
        found = corners_of_mask((rgb > 128).any(axis=2))
        return [(i, s, *(v for p in found for v in p))] if found else []

    names = ", ".join(f"{c}_{a} long" for c in ("tl", "tr", "bl", "br") for a in "xy")
    return image_job(masks, rows, f"image_id long, side string, {names}")


def binarized(gray: np.ndarray) -> tuple[np.ndarray, int]:
    """(0 or 255 for each pixel, limit): contrast stretched, then cut ten below the limit that separates best."""
    low, high = gray.min(), gray.max()
    g = (gray - low) / (high - low) * 255 if high - low > 10 else gray
    n = np.bincount(half_up(g).astype(int).ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = g.size - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    between = np.where((below > 0) & (above > 0), between, 0)
    limit = int(between.argmax()) if between.max() > 0 else 128
    return np.where(g < limit - 10, 0, 255).astype(np.uint8), limit


def binarize_name(images: DataFrame, region: tuple[float, float, float, float] = (0.05, 0.03, 0.7, 0.08)) -> DataFrame:
    """image_id, side, limit and black share of the name strip (left, top, width, height as shares), with its bytes."""

    def rows(i, s, rgb):
        h, w = rgb.shape[:2]
        x, y = int(w * region[0]), int(h * region[1])
        strip = luminance(rgb[y : y + max(1, int(h * region[3])), x : x + max(1, int(w * region[2]))])
        bits, limit = binarized(strip)
        return [(i, s, limit, float((bits == 0).mean()), *bits.shape, bits.tobytes())]

    return image_job(images, rows, "image_id long, side string, limit int, black double, height int, width int, bits binary")


def vision(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emboss, high-pass (against a 17x17 neighbourhood's mean) and Sobel maps, 0 to 255, zero where undefined."""
    emboss, high, sobel = (np.zeros(gray.shape) for _ in range(3))
    emboss[1:-1, 1:-1] = np.clip(128 + (gray[2:, 2:] - gray[:-2, :-2]) * 2, 0, 255)
    h, w = gray.shape
    if h > 16 and w > 16:
        near = sum(gray[8 + dy : h - 8 + dy, 8 + dx : w - 8 + dx] for dy in range(-8, 9, 2) for dx in range(-8, 9, 2)) / 81
        high[8:-8, 8:-8] = np.clip(128 + (gray[8:-8, 8:-8] - near) * 3, 0, 255)
    a, b, c = gray[:-2], gray[1:-1], gray[2:]
    gx = (a[:, 2:] - a[:, :-2]) + 2 * (b[:, 2:] - b[:, :-2]) + (c[:, 2:] - c[:, :-2])
    gy = (c[:, :-2] + 2 * c[:, 1:-1] + c[:, 2:]) - (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:])
    sobel[1:-1, 1:-1] = np.minimum(255, np.hypot(gx, gy))
    return emboss, high, sobel


def vision_maps(images: DataFrame) -> DataFrame:
    """image_id, side, kind (emboss, highpass, edges), height, width, pixels: one byte for each."""

    def rows(i, s, rgb):
        maps = vision(luminance(rgb))
        return [(i, s, kind, *m.shape, half_up(m).astype(np.uint8).tobytes()) for kind, m in zip(("emboss", "highpass", "edges"), maps, strict=True)]

    return image_job(images, rows, "image_id long, side string, kind string, height int, width int, pixels binary")
