"""Vectorised picture features against plain loops."""

import math

import numpy as np
import pytest

from cardloom.operators import pixels as p
from cardloom.plans.pixels import HEIGHT, WIDTH, draw, images
from cardloom.plans.base import Inputs


@pytest.fixture(scope="module")
def pictures():
    r = np.random.default_rng(8)
    return [draw(k, v / np.linalg.norm(v)) for k, v in enumerate(r.normal(size=(8, 64)))] + [np.full((90, 80, 3), 128, np.uint8)]


def lum(px):
    return 0.299 * float(px[0]) + 0.587 * float(px[1]) + 0.114 * float(px[2])


def test_phash_against_loops(pictures):
    for rgb in pictures[:3]:
        g = p.equalize(p.resize(p.luminance(rgb), 32, 32))
        block = []
        for u in range(8):
            for v in range(8):
                s = sum(g[x][y] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for x in range(32) for y in range(32))
                block.append(s * (math.sqrt(1 / 32) if u == 0 else math.sqrt(2 / 32)) * (math.sqrt(1 / 32) if v == 0 else math.sqrt(2 / 32)))
        rest = block[1:]
        med = sorted(rest)[31]
        bits = "".join("1" if x > med else "0" for x in rest) + "0"
        got = p.phash(p.luminance(rgb))
        assert len(got) == 16 and bin(int(bits, 2) ^ int(got, 16)).count("1") <= 1  # one bit may sit on the median


def test_equalize_against_loops():
    g = np.array([[10.4, 10.5, 200.0], [10.0, 99.0, 255.0]])
    levels = [math.floor(x + 0.5) for x in g.ravel()]
    cdf = [sum(x <= k for x in levels) for k in range(256)]
    least = min(c for c in cdf if c)
    assert p.equalize(g).ravel().tolist() == [math.floor((cdf[x] - least) / (6 - least) * 255 + 0.5) for x in levels]


def test_photo_quality_against_loops(pictures):
    for rgb in pictures:
        h, w = rgb.shape[:2]
        L = [[lum(rgb[y, x]) for x in range(w)] for y in range(h)]
        lap = [abs(4 * L[y][x] - L[y - 1][x] - L[y + 1][x] - L[y][x - 1] - L[y][x + 1]) for y in range(1, h - 1, 2) for x in range(1, w - 1, 2)]
        some = [L[y][x] for y in range(0, h, 2) for x in range(0, w, 2)]
        mid = [L[y][x] for y in range(int(h * 0.2), math.ceil(h * 0.8), 4) for x in range(int(w * 0.2), math.ceil(w * 0.8), 4)]
        n, total, squares, seen, dark, bright, spread = p.photo_sums(rgb)
        assert n == len(lap) and total / 1000 == pytest.approx(sum(lap), abs=1e-6) and squares / 1e6 == pytest.approx(sum(x * x for x in lap), abs=1e-6)
        assert seen == len(some) and dark == sum(x < 30 for x in some) and bright == sum(x > 240 for x in some)
        assert spread / 1000 == pytest.approx(max(mid) - min(mid))


def test_bounds_find_the_drawn_card(pictures):
    for k, rgb in enumerate(pictures[:8]):
        left, right, top, bottom = p.fine_bounds(p.luminance(rgb))
        assert abs(left - (8 + k % 9)) <= 4 and abs(top - (10 + k % 7)) <= 6
        assert abs(right - (WIDTH - 8 - k % 5)) <= 4 and abs(bottom - (HEIGHT - 9 - k % 6)) <= 6
    flat = p.luminance(pictures[-1])
    assert p.fine_bounds(flat) == (0, 79, 0, 89)


def test_coarse_bounds_fall_back(spark):
    rows = [(1, "front", 90, 80, bytearray(b"\x80" * 21600)), (2, "front", 10, 80, bytearray(2400)), (3, "back", 90, 80, bytearray(5))]
    df = spark.createDataFrame(rows, "image_id long, side string, height int, width int, pixels binary")
    assert sorted(tuple(r) for r in p.detect_bounds(df, "coarse").collect()) == [(1, "front", 8, 72, 9, 81, "fallback"), (2, "front", 8, 72, 1, 9, "fallback")]
    assert p.photo_quality(df).count() == 2 and p.blur(df).where("blurry").count() == 2


def test_centering_of_a_clean_card():
    rgb = np.full((400, 300, 3), 200, np.uint8)
    r = np.random.default_rng(1)
    rgb[40:370, 20:270] = r.integers(0, 255, (330, 250, 3))
    left, right, top, bottom, lr, tb = p.borders(p.luminance(rgb), (0, 299, 0, 399))
    assert (left, right, top, bottom) == (20, 30, 40, 30)
    assert (lr, tb) == (40.0, 57.1)


def test_edge_wear_against_loops(pictures):
    for rgb in pictures[:4]:
        g, box = p.luminance(rgb), p.fine_bounds(p.luminance(rgb))
        left, right, top, bottom = box
        deep = max(5, int(min(right - left, bottom - top) * 0.025))
        prev, white, rough, n = None, 0, 0.0, 0
        for i in range(1, 81):
            x = left + int((right - left) * i / 81)
            for d in range(deep):
                px = [int(c) for c in rgb[min(rgb.shape[0] - 1, top + d), min(rgb.shape[1] - 1, x)]]
                light = lum(px)
                n += 1
                white += light > 220 and abs(px[0] - px[1]) < 18 and abs(px[1] - px[2]) < 18
                rough += 0 if prev is None else abs(light - prev)
                prev = light
        name, w, r, ding, _ = p.edge_wear(rgb, g, box)[0]
        assert name == "TOP" and w == pytest.approx(white / n) and r == pytest.approx(rough / n) and ding == (w > 0.08 or r > 28)


def test_worn_corner_and_clean_corner():
    rgb = np.full((400, 300, 3), (90, 60, 30), np.uint8)
    rgb = np.kron(rgb, np.ones((4, 4, 1), np.uint8))
    depth = np.add.outer(np.arange(1600), np.arange(1200))[..., None]
    rgb = np.where(depth < 60, np.clip(255 - 4 * (depth - 16), 0, 255), rgb).astype(np.uint8)
    found = {n: ding for n, _, _, ding, _ in p.corner_wear(rgb, p.luminance(rgb), (0, 1099, 0, 1599))}
    assert found == {"TOP LEFT": True, "TOP RIGHT": False, "BOTTOM LEFT": False, "BOTTOM RIGHT": False}


def test_surface_severity_and_regions():
    g = np.full((700, 500), 120.0)
    assert p.surface_wear(g, (0, 499, 0, 699), False)[0] == 0
    g[200:420, [x for x in range(150, 350) if x // 16 % 2]] = 250
    severity, anomaly, _, _, found = p.surface_wear(g, (0, 499, 0, 699), False)
    assert severity >= 1 and anomaly > 0 and 1 <= len(found) <= 6
    cells = [(float(k), k % 20, k // 20 * 5) for k in range(100)]
    assert len(p.regions(cells, 0, 0, 10, 10)) == 6 and p.regions(cells, 0, 0, 10, 10)[0][4] == 99.0


def test_blur_backend_mask_binarize_vision():
    assert p.laplacian(np.full((9, 9), 7.0)).var() == 0
    rgb = np.full((200, 150, 3), 100, np.uint8)
    rgb[:24, :18] = 255
    rgb[::2, ::2] = np.maximum(rgb[::2, ::2], 101)
    assert ("CORNER_WHITENING", "TOP_LEFT", 5, 0.9) in p.backend_wear(rgb)
    mask = np.zeros((100, 100), bool)
    mask[20:80, 30:70] = True
    assert p.corners_of_mask(mask) == ((30, 20), (69, 20), (30, 79), (69, 79))
    assert p.corners_of_mask(np.zeros((50, 50), bool)) is None
    bits, limit = p.binarized(np.array([[10.0] * 5 + [200.0] * 20]))
    assert bits.ravel().tolist() == [0] * 5 + [255] * 20 or limit <= 10
    g = np.arange(900.0).reshape(30, 30) % 97
    emboss, _, sobel = p.vision(g)
    assert emboss[5, 7] == min(255, max(0, 128 + (g[6, 8] - g[4, 6]) * 2))
    gx = -g[4, 6] + g[4, 8] - 2 * g[5, 6] + 2 * g[5, 8] - g[6, 6] + g[6, 8]
    gy = -g[4, 6] - 2 * g[4, 7] - g[4, 8] + g[6, 6] + 2 * g[6, 7] + g[6, 8]
    assert sobel[5, 7] == pytest.approx(min(255, math.hypot(gx, gy)))


def test_jobs_run_on_the_table(spark, sf):
    from cardloom.plans import pixels as q

    f = Inputs(spark, sf)
    n = f.embeddings.count()
    assert images(f).count() == n
    for name in ("v1_v2_phash_equalized", "v4_fine_bounds", "v9_photo_quality", "v10_blur", "v12_mask_corners", "v13_binarize_name", "v15_analyze_images"):
        assert q.JOBS[name](f).count() == n, name
    broken = spark.createDataFrame([(1, "front", 10, 10, bytearray(5)), (2, "back", None, 4, None)], "image_id long, side string, height int, width int, pixels binary")
    assert p.phash_images(broken).count() == 0


def test_pictures_are_changed_in_the_stage_that_draws_them(spark, sf):
    from cardloom.plans import QUERIES

    for name in ("v12_mask_corners", "v8_surface_dings_of_scratched_cards"):
        assert QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
