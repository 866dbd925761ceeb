"""Queries over pictures: one drawn from each vector, so that the work grows with the embeddings table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import half_up
from ..operators import grading, pixels
from ..sources.shared import arrow_ready
from .base import Inputs, query

HEIGHT, WIDTH = 192, 128
#: Pictures that are drawn at once.
DRAWN = 32
#: Pictures of one task, about.
TASK = 512


def draw(vec_id: int, vector: np.ndarray) -> np.ndarray:
    """A card with a border, a textured inside and some worn spots, on a dark ground, all from the id and the vector."""
    rgb = np.full((HEIGHT, WIDTH, 3), 40, dtype=np.float64)
    rgb += (np.arange(WIDTH) % 3)[None, :, None]
    left, top = 8 + vec_id % 9, 10 + vec_id % 7
    right, bottom = WIDTH - 8 - vec_id % 5, HEIGHT - 9 - vec_id % 6
    rgb[top:bottom, left:right] = (200 + vec_id % 30, 180 + vec_id % 40, 60 + vec_id % 90)
    l, r, t, b = left + 5 + vec_id % 6, right - 5 - vec_id % 4, top + 7 + vec_id % 5, bottom - 7 - vec_id % 8
    y, x = np.mgrid[t:b, l:r]
    art = 110 + 300 * vector[(x // 6 + 8 * (y // 8)) % len(vector)] + 20 * ((x + y) % 5)
    rgb[t:b, l:r] = art[..., None] * np.array([1.0, 0.9, 0.8])
    if vec_id % 3 == 0:
        rgb[top : top + 12, left : left + 12] = 250
    if vec_id % 4 == 0:
        rgb[top : top + 3, left + 20 : right - 20] = 245
    return np.clip(rgb, 0, 255).astype(np.uint8)


def images(f: Inputs, change: Callable[[int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The pictures, each changed as it is drawn: one Python stage. A vector is small and its picture is not, so tasks go by numbers of pictures."""

    def run(batches):
        for batch in (whole.slice(k, DRAWN) for whole in batches for k in range(0, whole.num_rows, DRAWN)):
            ids = batch.column("vec_id").to_pylist()
            drawn = [draw(i, np.array(v, dtype=np.float64)) for i, v in zip(ids, batch.column("embedding").to_pylist(), strict=True)]
            if change:
                drawn = [change(i, rgb) for i, rgb in zip(ids, drawn, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(["front" if i % 2 == 0 else "back" for i in ids]), pa.array([x.shape[0] for x in drawn], pa.int32()), pa.array([x.shape[1] for x in drawn], pa.int32()),
                    pa.array([x.tobytes() for x in drawn], pa.binary()),
                ],
                names=["image_id", "side", "height", "width", "pixels"],
            )

    vectors = f.vectors.select("vec_id", "embedding")
    spread = vectors.repartition(max(1, -(-vectors.count() // TASK)), "vec_id")
    return arrow_ready(spread).mapInArrow(run, "image_id long, side string, height int, width int, pixels binary")


def masks(f: Inputs) -> DataFrame:
    """Pictures whose card is white and whose ground is black."""
    return images(f, lambda i, rgb: np.where(rgb.max(axis=2, keepdims=True) > 60, 255, 0).repeat(3, axis=2).astype(np.uint8))


def cropped(f: Inputs) -> DataFrame:
    """The drawn cards without the ground around them."""
    return images(f, lambda i, rgb: rgb[10 + i % 7 : HEIGHT - 9 - i % 6, 8 + i % 9 : WIDTH - 8 - i % 5])


def scratched(f: Inputs) -> DataFrame:
    """The drawn pictures, every second one with bright flecks all over the card."""

    def flecked(i: int, rgb: np.ndarray) -> np.ndarray:
        y, x = np.mgrid[0:HEIGHT, 0:WIDTH]
        flecks = (i % 2 == 0) & ((x // 3 * 3 + y // 4 * 5 + i) % 6 == 0) & (rgb.max(axis=2) > 60)
        return np.where(flecks[..., None], 250, rgb).astype(np.uint8)

    return images(f, flecked)


# The pictures of draw(), one row for each pixel, as DuckDB says it.
PIXELS = f"""place AS (SELECT vec_id AS id, embedding AS e, 8 + vec_id % 9 AS lft, 10 + vec_id % 7 AS tp, {WIDTH} - 8 - vec_id % 5 AS rgt, {HEIGHT} - 9 - vec_id % 6 AS btm FROM {{embeddings}}),
inner_place AS (SELECT *, lft + 5 + id % 6 AS l, rgt - 5 - id % 4 AS r, tp + 7 + id % 5 AS t, btm - 7 - id % 8 AS b FROM place),
every AS (SELECT id, y, x, lft, tp, CASE WHEN id % 4 = 0 AND y >= tp AND y < tp + 3 AND x >= lft + 20 AND x < rgt - 20 THEN 245 WHEN id % 3 = 0 AND y >= tp AND y < tp + 12 AND x >= lft AND x < lft + 12 THEN 250 END AS spot,
    CASE WHEN y >= t AND y < b AND x >= l AND x < r THEN (110 + 300::DOUBLE * CAST(e[1 + (x // 6 + 8 * (y // 8)) % len(e)] AS DOUBLE)) + 20 * ((x + y) % 5) END AS art,
    y >= tp AND y < btm AND x >= lft AND x < rgt AS card FROM inner_place, (SELECT range AS y FROM range({HEIGHT})), (SELECT range AS x FROM range({WIDTH}))),
px AS (SELECT id, y, x, {', '.join(f"CAST(trunc(greatest(0::DOUBLE, least(255::DOUBLE, CASE WHEN spot IS NOT NULL THEN spot WHEN art IS NOT NULL THEN art * {k}::DOUBLE WHEN card THEN {c} ELSE 40 + x % 3 END))) AS BIGINT) AS {n}" for n, k, c in (("r", "1.0", "200 + id % 30"), ("g", "0.9", "180 + id % 40"), ("b", "0.8", "60 + id % 90")))} FROM every),
light AS (SELECT id, y, x, 299 * r + 587 * g + 114 * b AS m FROM px)"""
SIDE = "CASE WHEN id % 2 = 0 THEN 'front' ELSE 'back' END AS side"
NEAR = "lag({v}) OVER v AS up, lead({v}) OVER v AS down, lag({v}) OVER h AS before, lead({v}) OVER h AS after FROM {t} WINDOW v AS (PARTITION BY id, x ORDER BY y), h AS (PARTITION BY id, y ORDER BY x)"


def near(v: str, t: str) -> str:
    return NEAR.replace("{v}", v).replace("{t}", t)


def phash_sql(equal: bool) -> str:
    """Cells of 6 x 4 pixels, the 8 x 8 low frequencies, their bits against the median of all but the first."""
    levels = """cells AS (SELECT id, y // 6 AS i, x // 4 AS j, CAST(sum(m) AS DOUBLE) / 24 / 1000 AS v FROM light GROUP BY ALL)"""
    if equal:
        levels = levels.replace("cells AS", "plain AS") + """, leveled AS (SELECT id, i, j, CAST(greatest(0, least(255, floor(round(v, 6) + 0.5::DOUBLE))) AS INT) AS k FROM plain),
        cdf AS (SELECT id, k, sum(count(*)) OVER (PARTITION BY id ORDER BY k) AS n, first_value(count(*)) OVER (PARTITION BY id ORDER BY k) AS least FROM leveled GROUP BY id, k),
        cells AS (SELECT id, i, j, CASE WHEN least = 1024 THEN 0::DOUBLE ELSE floor(CAST(n - least AS DOUBLE) / (1024 - least) * 255 + 0.5::DOUBLE) END AS v FROM leveled JOIN cdf USING (id, k))"""
    wave = lambda u, x: f"cos(pi() * {u} * (2 * {x} + 1) / 64) * CASE WHEN {u} = 0 THEN sqrt(1 / 32::DOUBLE) ELSE 0.25::DOUBLE END"
    return f"""WITH {PIXELS}, {levels}, rows_ AS (SELECT id, i, w, sum(v * {wave("w", "j")}) AS v FROM cells, (SELECT range AS w FROM range(8)) GROUP BY id, i, w),
    low AS (SELECT id, u, w, sum(v * {wave("u", "i")}) AS v FROM rows_, (SELECT range AS u FROM range(8)) GROUP BY id, u, w HAVING u + w > 0),
    bits AS (SELECT id, 8 * u + w AS k, v > median(v) OVER (PARTITION BY id) AS on_ FROM low)
    SELECT id AS image_id, {SIDE}, lower(printf('%016x', CAST(sum(CASE WHEN on_ THEN 1::HUGEINT << (64 - k)::INT ELSE 0 END) AS UBIGINT))) AS hash FROM bits GROUP BY id"""


SQL = {
    "v1_phash_plain": phash_sql(False),
    "v1_v2_phash_equalized": phash_sql(True),
    "v3_coarse_bounds": f"""WITH {PIXELS}, cells AS (SELECT id, y // 12 AS i, x // 8 AS j, count(*) AS n, CAST(sum(m) AS DOUBLE) AS s, CAST(sum(m * m) AS DOUBLE) AS s2 FROM light WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY ALL),
      vars AS (SELECT id, i, j, greatest((s2 / n - (s / n) * (s / n)) / 1000000, 0::DOUBLE) AS var FROM cells),
      high AS (SELECT id, i, j FROM vars QUALIFY var > greatest(30::DOUBLE, max(var) OVER (PARTITION BY id) * 0.12::DOUBLE)),
      box AS (SELECT p.vec_id AS id, greatest(0, min(j) * 8 - 5) AS l, least({WIDTH}, (max(j) + 1) * 8 + 5) AS r, greatest(0, min(i) * 12 - 5) AS t, least({HEIGHT}, (max(i) + 1) * 12 + 5) AS b FROM {{embeddings}} p LEFT JOIN high h ON h.id = p.vec_id GROUP BY p.vec_id),
      good AS (SELECT *, coalesce(r - l >= 50 AND b - t >= 50, false) AS ok FROM box)
      SELECT id AS image_id, {SIDE}, CAST(CASE WHEN ok THEN l ELSE 12 END AS BIGINT) AS "left", CAST(CASE WHEN ok THEN r ELSE 114 END AS BIGINT) AS "right", CAST(CASE WHEN ok THEN t ELSE 19 END AS BIGINT) AS top, CAST(CASE WHEN ok THEN b ELSE 172 END AS BIGINT) AS bottom,
        CASE WHEN ok THEN 'variance' ELSE 'fallback' END AS method FROM good""",
    "v9_photo_quality": f"""WITH {PIXELS}, around AS (SELECT id, y, x, m, {near("m", "light")}),
      sums AS (SELECT id, count(CASE WHEN e THEN 1 END) AS n, CAST(sum(CASE WHEN e THEN d END) AS DOUBLE) AS s, CAST(sum(CASE WHEN e THEN d * d END) AS DOUBLE) AS s2, count(CASE WHEN z THEN 1 END) AS seen, count(CASE WHEN z AND m < 30000 THEN 1 END) AS n_dark,
        count(CASE WHEN z AND m > 240000 THEN 1 END) AS n_bright, max(CASE WHEN c THEN m END) - min(CASE WHEN c THEN m END) AS spread
        FROM (SELECT id, m, abs(4 * m - up - down - before - after) AS d, y % 2 = 1 AND x % 2 = 1 AND y <= {HEIGHT - 2} AND x <= {WIDTH - 2} AS e, y % 2 = 0 AND x % 2 = 0 AS z, y >= 38 AND y < 154 AND (y - 38) % 4 = 0 AND x >= 25 AND x < 103 AND (x - 25) % 4 = 0 AS c FROM around) GROUP BY id),
      measured AS (SELECT id, (s2 / n - (s / n) * (s / n)) / 1000000 AS sharp, n_dark / seen::DOUBLE AS dark, n_bright / seen::DOUBLE AS bright, spread / 1000::DOUBLE AS contrast FROM sums),
      warned AS (SELECT *, list_filter([CASE WHEN sharp < 100 THEN 'blur:high' WHEN sharp < 300 THEN 'blur:medium' END, CASE WHEN dark > 0.4::DOUBLE THEN 'dark:high' WHEN dark > 0.25::DOUBLE THEN 'dark:medium' END,
        CASE WHEN bright > 0.3::DOUBLE THEN 'bright:high' WHEN bright > 0.15::DOUBLE THEN 'bright:medium' END, CASE WHEN contrast < 50 THEN 'contrast:medium' END], lambda w: w IS NOT NULL) AS w FROM measured),
      scored AS (SELECT *, 100 - coalesce(list_sum(list_transform(w, lambda x: CASE x WHEN 'blur:high' THEN 40 WHEN 'blur:medium' THEN 15 WHEN 'dark:high' THEN 25 WHEN 'bright:high' THEN 25 ELSE 10 END)), 0) AS points FROM warned)
      SELECT id AS image_id, {SIDE}, CAST(greatest(0, points) AS INT) AS score, points >= 60 AS acceptable, CAST(floor(sharp + 0.5::DOUBLE) AS BIGINT) AS sharpness, CAST(floor(dark * 100 + 0.5::DOUBLE) AS BIGINT) AS dark,
        CAST(floor(bright * 100 + 0.5::DOUBLE) AS BIGINT) AS bright, CAST(floor(contrast + 0.5::DOUBLE) AS BIGINT) AS contrast, array_to_string(w, ',') AS warnings FROM scored""",
    "v10_blur": f"""WITH {PIXELS}, grey AS (SELECT id, y, x, (m + 500) // 1000 AS g FROM light), around AS (SELECT id, g, {near("g", "grey")}),
      edges AS (SELECT id, 4 * g - coalesce(up, down) - coalesce(down, up) - coalesce(before, after) - coalesce(after, before) AS d FROM around),
      v AS (SELECT id, CAST(sum(d * d) AS DOUBLE) / count(*) - (CAST(sum(d) AS DOUBLE) / count(*)) * (CAST(sum(d) AS DOUBLE) / count(*)) AS variance FROM edges GROUP BY id)
      SELECT id AS image_id, {SIDE}, floor(variance * 1000000 + 0.5::DOUBLE) / 1000000 AS variance, variance < 100 AS blurry FROM v""",
    "v12_mask_corners": f"""WITH {PIXELS}, mask AS (SELECT id, y, x, CAST(greatest(r, g, b) > 60 AS INT) AS k FROM px), around AS (SELECT id, y, x, k, {near("k", "mask")}),
      outline AS (SELECT id, y, x, k = 1 AND up + down + before + after < 4 AS edge, k = 1 AS inside FROM around),
      counted AS (SELECT id, count(CASE WHEN edge THEN 1 END) AS n_edge, count(CASE WHEN inside THEN 1 END) AS n_all FROM outline GROUP BY id),
      points AS (SELECT o.id, x, y FROM outline o JOIN counted c USING (id) WHERE CASE WHEN n_edge < 50 THEN inside AND n_all >= 100 ELSE edge END),
      found AS (SELECT id, arg_min(struct_pack(x := x, y := y), [x + y, y, x]) AS tl, arg_min(struct_pack(x := x, y := y), [y - x, y, x]) AS tr, arg_min(struct_pack(x := x, y := y), [x - y, y, x]) AS bl, arg_min(struct_pack(x := x, y := y), [-x - y, y, x]) AS br
        FROM points GROUP BY id HAVING max(x) - min(x) >= {WIDTH} * 0.2::DOUBLE AND max(y) - min(y) >= {HEIGHT} * 0.2::DOUBLE)
      SELECT id AS image_id, {SIDE}, {", ".join(f"{c}.{k} AS {c}_{k}" for c in ("tl", "tr", "bl", "br") for k in "xy")} FROM found""",
    "v13_binarize_name": f"""WITH {PIXELS}, strip AS (SELECT id, m / 1000::DOUBLE AS v FROM light WHERE x >= 6 AND x < 95 AND y >= 5 AND y < 20), ends AS (SELECT id, min(v) AS low, max(v) AS high FROM strip GROUP BY id),
      g AS (SELECT id, CASE WHEN high - low > 10 THEN (v - low) / (high - low) * 255 ELSE v END AS g FROM strip JOIN ends USING (id)),
      levels AS (SELECT id, k, count(g) AS n FROM (SELECT id, range AS k FROM ends, range(256)) LEFT JOIN (SELECT id, g, CAST(floor(g + 0.5::DOUBLE) AS BIGINT) AS k FROM g) USING (id, k) GROUP BY id, k),
      sums AS (SELECT id, k, CAST(sum(n) OVER w AS DOUBLE) AS below, CAST(sum(n * k) OVER w AS DOUBLE) AS s, CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) AS size, CAST(sum(n * k) OVER (PARTITION BY id) AS DOUBLE) AS total FROM levels WINDOW w AS (PARTITION BY id ORDER BY k)),
      between_ AS (SELECT id, k, CASE WHEN below > 0 AND size - below > 0 THEN below * (size - below) * ((s / below - (total - s) / (size - below)) * (s / below - (total - s) / (size - below))) ELSE 0 END AS v FROM sums),
      best AS (SELECT id, CASE WHEN max(v) > 0 THEN arg_min(k, [-v, k]) ELSE 128 END AS lim FROM between_ GROUP BY id)
      SELECT id AS image_id, {SIDE}, CAST(lim AS INT) AS "limit", count(CASE WHEN g < lim - 10 THEN 1 END) / count(*)::DOUBLE AS black, 15 AS height, 89 AS width FROM g JOIN best USING (id) GROUP BY id, lim""",
    "v11_backend_defects_of_cropped_cards": f"""WITH {PIXELS}, card AS (SELECT p.id, p.y - tp AS y, p.x - lft AS x, r, g, b, (299 * r + 587 * g + 114 * b + 500) // 1000 AS grey, rgt - lft AS w, btm - tp AS h FROM px p JOIN place q USING (id) WHERE p.y >= tp AND p.y < btm AND p.x >= lft AND p.x < rgt),
      sized AS (SELECT *, CAST(floor(h * 0.12::DOUBLE) AS BIGINT) AS ch, CAST(floor(w * 0.12::DOUBLE) AS BIGINT) AS cw, CAST(floor(h * 0.05::DOUBLE) AS BIGINT) AS eh, CAST(floor(w * 0.05::DOUBLE) AS BIGINT) AS ew FROM card),
      corner AS (SELECT id, 'CORNER_WHITENING' AS type, CASE WHEN top THEN 'TOP' ELSE 'BOTTOM' END || CASE WHEN lefty THEN '_LEFT' ELSE '_RIGHT' END AS location, r, g, b, grey > 235 AS bright, dx / (cw // 2)::DOUBLE + dy / (ch // 2)::DOUBLE <= 1 AS counts
        FROM (SELECT *, y < ch AS top, x < cw AS lefty, CASE WHEN x < cw THEN x ELSE cw - (x - (w - cw)) END AS dx, CASE WHEN y < ch THEN y ELSE ch - (y - (h - ch)) END AS dy FROM sized WHERE (y < ch OR y >= h - ch) AND (x < cw OR x >= w - cw))),
      edge AS (SELECT id, 'EDGE_DAMAGE' AS type, unnest(list_filter([CASE WHEN y < eh AND x >= cw AND x < w - cw THEN 'TOP' END, CASE WHEN y >= h - eh AND x >= cw AND x < w - cw THEN 'BOTTOM' END, CASE WHEN x < ew AND y >= ch AND y < h - ch THEN 'LEFT' END, CASE WHEN x >= w - ew AND y >= ch AND y < h - ch THEN 'RIGHT' END], lambda l: l IS NOT NULL)) AS location,
        r, g, b, grey > 240 AS bright, true AS counts FROM sized),
      parts AS (SELECT id, type, location, greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b)) > 30 AND (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 < CASE WHEN type = 'EDGE_DAMAGE' THEN 35 ELSE 40 END AS plain,
        count(CASE WHEN counts AND bright THEN 1 END) / nullif(count(CASE WHEN counts THEN 1 END), 0)::DOUBLE AS share FROM (SELECT * FROM corner UNION ALL SELECT * FROM edge) GROUP BY id, type, location)
      SELECT id AS image_id, {SIDE}, type, location, CAST(CASE WHEN type = 'EDGE_DAMAGE' THEN least(5, floor(share * 20) + 1) ELSE least(5, floor(share * 15) + 1) END AS INT) AS severity,
        CASE WHEN type = 'EDGE_DAMAGE' THEN least(0.85::DOUBLE, share * 2) ELSE least(0.9::DOUBLE, share * 1.5::DOUBLE) END AS confidence FROM parts WHERE NOT plain AND share > CASE WHEN type = 'EDGE_DAMAGE' THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END""",
}
JOBS = {
    "v1_v2_phash_equalized": lambda f: pixels.phash_images(images(f)),
    "v1_phash_plain": lambda f: pixels.phash_images(images(f), equal=False),
    "v3_coarse_bounds": lambda f: pixels.detect_bounds(images(f), "coarse"),
    "v4_fine_bounds": lambda f: pixels.detect_bounds(images(f), "fine"),
    "v5_measure_centering": lambda f: pixels.measure_centering(images(f)),
    "v6_corner_dings": lambda f: pixels.dings_of(images(f), ("corner",)),
    "v7_edge_dings": lambda f: pixels.dings_of(images(f), ("edge",)),
    "v8_surface_dings": lambda f: pixels.dings_of(images(f), ("surface",)),
    "v8_surface_dings_of_scratched_cards": lambda f: pixels.dings_of(scratched(f), ("surface",)),
    "v8_o3_surface_regions": lambda f: pixels.surface_regions(images(f)),
    "v9_photo_quality": lambda f: pixels.photo_quality(images(f)).withColumn("warnings", F.array_join("warnings", ",")),
    "v10_blur": lambda f: pixels.blur(images(f)).withColumn("variance", half_up(F.col("variance"), 6)),
    "v11_backend_defects": lambda f: pixels.backend_defects(images(f)),
    "v11_backend_defects_of_cropped_cards": lambda f: pixels.backend_defects(cropped(f)),
    "v12_mask_corners": lambda f: pixels.mask_corners(masks(f)),
    "v13_binarize_name": lambda f: pixels.binarize_name(images(f)).drop("bits"),
    "v14_vision_maps": lambda f: pixels.vision_maps(images(f)).select("image_id", "side", "kind", "height", "width", F.sha2("pixels", 256).alias("sha")),
    "v15_analyze_images": lambda f: pixels.analyze_images(images(f)).select("image_id", "side", "left", "right", "top", "bottom", "border.lr", "border.tb", "anomaly", "scratch", "holo", F.size("dings").alias("n_dings")),
}
for _name, _job in JOBS.items():
    query(_name, SQL.get(_name))(_job)


@query("v15_j13_f46_grade_from_pictures")
def _(f):
    """Pictures to grades: a front and a back make one scan."""
    seen = pixels.analyze_images(images(f)).withColumn("scan_id", F.floor(F.col("image_id") / 2))
    sides = grading.combine_sides(seen.select("scan_id", "side", "border.lr", "border.tb"))
    dings = seen.select("scan_id", "side", F.explode("dings").alias("d")).select("scan_id", "side", "d.type", "d.severity")
    scans = sides.select(F.col("scan_id").alias("id"), F.col("front_offset").alias("front_lr"), F.lit(50.0).alias("front_tb"), F.col("back_offset").alias("back_lr"), F.lit(50.0).alias("back_tb"))
    return grading.grade_scans(scans, dings).select("scan_id", "company", "raw_score", "grade", "label")
