"""Queries over borders, corners, boxes, calibrations and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scores
from ..operators import sequences
from .base import query



def borders(f):
    i = F.col("id")
    d = lambda n, m: (F.floor(i / n) % m).cast("long")
    return f.scans.select("id", (i % 40).cast("long").alias("l"), d(3, 35).alias("r"), d(5, 30).alias("t"), d(7, 25).alias("b"))


@query(
    "f26_border_ratios",
    """WITH x AS (SELECT id, CAST(id % 40 AS BIGINT) AS l, (id // 3) % 35 AS r, (id // 5) % 30 AS t, (id // 7) % 25 AS b FROM {scans}), y AS (SELECT id, CASE WHEN l + r > 0 THEN CAST(l AS DOUBLE) / (l + r) * 100 ELSE 50 END AS lr, CASE WHEN t + b > 0 THEN CAST(t AS DOUBLE) / (t + b) * 100 ELSE 50 END AS tb FROM x)
    SELECT id, lr, tb, floor(lr * 10 + 0.5::DOUBLE) / 10 AS lr_up, floor(tb * 10 + 0.5::DOUBLE) / 10 AS tb_up FROM y""",
)
def _(f):
    c = [F.col(x) for x in "lrtb"]
    raw, up = g_ratios(c, None), g_ratios(c, "half_up")
    return borders(f).select("id", raw.alias("x"), up.alias("y")).select("id", "x.lr", "x.tb", F.col("y.lr").alias("lr_up"), F.col("y.tb").alias("tb_up"))


def g_ratios(c, rounding):
    return scores.border_ratios(*c, rounding)


CORNERS = {"tl": ("i % 5", "i % 3"), "tr": ("500 + i % 7", "i % 4"), "bl": ("i % 6", "700 + i % 5"), "br": ("500 + i % 11", "700 + i % 9")}
INNER = {"tl": ("20 + i % 13", "25 + i % 17"), "tr": ("470 + i % 19", "30 + i % 7"), "bl": ("22 + i % 29", "670 + i % 23"), "br": ("475 + i % 9", "660 + i % 31")}


def corners(spec):
    num = lambda e: F.expr(e.replace("i %", "id %")).cast("double")
    return F.struct(*(F.struct(num(x).alias("x"), num(y).alias("y")).alias(n) for n, (x, y) in spec.items()))


def edge_sql(n: str, a: str, b: str) -> str:
    """Median, deviation and variation of one edge, in DuckDB's list functions."""
    ox, oy, px, py = (f"CAST({CORNERS[k][j]} AS DOUBLE)" for k, j in ((a, 0), (a, 1), (b, 0), (b, 1)))
    ix, iy, jx, jy = (f"CAST({INNER[k][j]} AS DOUBLE)" for k, j in ((a, 0), (a, 1), (b, 0), (b, 1)))
    dx, dy = f"({px} - {ox})", f"({py} - {oy})"
    return f"[{', '.join(f'abs(({ix} + ({jx} - {ix}) * {t}::DOUBLE - {ox}) * {dy} - ({iy} + ({jy} - {iy}) * {t}::DOUBLE - {oy}) * {dx}) / sqrt({dx} * {dx} + {dy} * {dy})' for t in g.SAMPLES)}] AS s_{n}"


EDGES = (("top", "tl", "tr"), ("bottom", "bl", "br"), ("left", "tl", "bl"), ("right", "tr", "br"))
MED = "floor(list_aggregate(s_{0}, 'median') * 10 + 0.5::DOUBLE) / 10 AS m_{0}, CASE WHEN list_aggregate(s_{0}, 'median') > 0 THEN list_aggregate(s_{0}, 'stddev_pop') / list_aggregate(s_{0}, 'median') ELSE 0 END AS v_{0}"


@query(
    "f27_a13_a14_corner_centering",
    f"""WITH x AS (SELECT id, {", ".join(edge_sql(*e) for e in EDGES)} FROM (SELECT id, id AS i FROM {{scans}})), y AS (SELECT id, {", ".join(MED.format(n) for n, _, _ in EDGES)} FROM x),
    z AS (SELECT *, {" + ".join(f"CAST(v_{n} >= 0.15 AS INT)" for n, _, _ in EDGES)} AS low, {" + ".join(f"CAST(v_{n} >= 0.05 AND v_{n} < 0.15 AS INT)" for n, _, _ in EDGES)} AS med FROM y)
    SELECT id, CASE WHEN m_left + m_right > 0 THEN floor(m_left / (m_left + m_right) * 100 * 10 + 0.5::DOUBLE) / 10 ELSE 50 END AS lr, CASE WHEN m_top + m_bottom > 0 THEN floor(m_top / (m_top + m_bottom) * 100 * 10 + 0.5::DOUBLE) / 10 ELSE 50 END AS tb,
    CASE WHEN low >= 2 THEN 'low' WHEN low >= 1 OR med >= 2 THEN 'medium' ELSE 'high' END AS confidence, low AS low_edges, m_left AS left_median FROM z""",
)
def _(f):
    return f.scans.select("id", g.corner_centering(corners(CORNERS), corners(INNER)).alias("c")).select("id", "c.lr", "c.tb", "c.confidence", "c.low_edges", F.col("c.left.median").alias("left_median"))


@query(
    "f43_corner_boxes",
    """SELECT id, CAST(least(id % 5, id % 6) AS DOUBLE) AS x, CAST(least(id % 3, id % 4) AS DOUBLE) AS y, CAST(greatest(500 + id % 7, 500 + id % 11) - least(id % 5, id % 6) AS DOUBLE) AS width, CAST(greatest(700 + id % 5, 700 + id % 9) - least(id % 3, id % 4) AS DOUBLE) AS height,
    concat_ws(',', CASE WHEN 500 + id % 7 > 505 OR 500 + id % 11 > 505 THEN 'outside' END, CASE WHEN greatest(500 + id % 7, 500 + id % 11) - least(id % 5, id % 6) < 504 THEN 'narrow' END) AS issues FROM {scans}""",
)
def _(f):
    c = corners(CORNERS)
    return f.scans.select("id", g.box_of_corners(c).alias("b"), F.array_join(g.corner_issues(c, F.lit(505), F.lit(800), 504), ",").alias("issues")).select("id", "b.*", "issues")


BOX = "SELECT id, CAST(id % 300 AS BIGINT) AS x, CAST(id % 200 AS BIGINT) AS y, CAST(60 + (id * 7) % 500 AS BIGINT) AS w, CAST(80 + (id * 11) % 700 AS BIGINT) AS h FROM {scans}"


def boxes(f):
    return f.spark.sql(BOX, scans=f.scans)


@query(
    "f47_fit_card_aspect",
    f"""WITH b AS ({BOX}), n AS (SELECT *, abs(CAST(least(w, h) AS DOUBLE) / greatest(w, h) - 0.714::DOUBLE) < 0.05::DOUBLE AS near, CASE WHEN h > w THEN floor(h * 0.714::DOUBLE + 0.5::DOUBLE) ELSE w END AS nw, CASE WHEN h > w THEN h ELSE floor(w * 0.714::DOUBLE + 0.5::DOUBLE) END AS nh FROM b),
    p AS (SELECT *, greatest(0, least(floor(x + w / 2 - nw / 2 + 0.5::DOUBLE), 900 - nw)) AS nx, greatest(0, least(floor(y + h / 2 - nh / 2 + 0.5::DOUBLE), 1200 - nh)) AS ny FROM n)
    SELECT id, CAST(CASE WHEN near THEN x ELSE nx END AS BIGINT) AS x, CAST(CASE WHEN near THEN y ELSE ny END AS BIGINT) AS y, CAST(CASE WHEN near THEN w ELSE least(nw, 900 - nx) END AS BIGINT) AS width, CAST(CASE WHEN near THEN h ELSE least(nh, 1200 - ny) END AS BIGINT) AS height FROM p""",
)
def _(f):
    c = F.col
    return boxes(f).select("id", g.fit_card_aspect(c("x"), c("y"), c("w"), c("h"), F.lit(900), F.lit(1200)).alias("b")).select("id", "b.*")


@query("f48_scaled_size", f"SELECT id, CAST(CASE WHEN greatest(w, h) <= 300 THEN w ELSE floor(w * (300.0::DOUBLE / greatest(w, h)) + 0.5::DOUBLE) END AS BIGINT) AS width, CAST(CASE WHEN greatest(w, h) <= 300 THEN h ELSE floor(h * (300.0::DOUBLE / greatest(w, h)) + 0.5::DOUBLE) END AS BIGINT) AS height FROM ({BOX})")
def _(f):
    return boxes(f).select("id", g.scaled_size(F.col("w"), F.col("h"), 300).alias("s")).select("id", "s.*")


@query(
    "f49_frame_outline",
    f"""SELECT id, x / 600 * 100 AS "left", y / 800 * 100 AS top, w / 600 * 100 AS width, h / 800 * 100 AS height, CAST(w * h AS DOUBLE) / 480000 * 100 AS fill, abs(CAST(w AS DOUBLE) / h - 2.5::DOUBLE / 3.5::DOUBLE) < 0.12 AS aspect_ok
    FROM ({BOX}) WHERE w >= 600 * 0.12::DOUBLE AND h >= 800 * 0.12::DOUBLE AND abs(CAST(w AS DOUBLE) / h - 2.5::DOUBLE / 3.5::DOUBLE) <= 0.25""",
)
def _(f):
    c = F.col
    return boxes(f).select("id", g.frame_outline(c("x"), c("y"), c("w"), c("h"), F.lit(600), F.lit(800)).alias("o")).where("o is not null").select("id", "o.*")


@query(
    "p9_capture_gate",
    f"""WITH x AS (SELECT id, w, h, CAST(w * h AS DOUBLE) / 480000 AS fill, abs(CAST(w AS DOUBLE) / h - 2.5::DOUBLE / 3.5::DOUBLE) AS o FROM (SELECT id, w - 40 AS w, h FROM ({BOX})))
    SELECT id, w > 50 AND h > 50 AND fill > 0.2::DOUBLE AND fill < 0.95::DOUBLE AND o < 0.15 AS valid, CAST(floor(fill * 100) AS INT) AS fill_percent,
    concat_ws(',', CASE WHEN w <= 50 THEN 'not_detected' END, CASE WHEN fill < 0.2::DOUBLE AND w > 50 THEN 'too_small' END, CASE WHEN fill >= 0.95::DOUBLE THEN 'too_close' END, CASE WHEN o >= 0.15 AND w > 50 THEN 'tilted' END) AS issues FROM x""",
)
def _(f):
    c = F.col
    return boxes(f).select("id", g.capture_gate(F.lit(600), F.lit(800), c("w") - 40, c("h")).alias("g")).select("id", "g.valid", "g.fill_percent", F.array_join("g.issues", ",").alias("issues"))


@query(
    "f50_bbox_pixels",
    """WITH x AS (SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id % 64 AS DOUBLE) / 128 ELSE id % 200 END AS a, CASE WHEN id % 3 = 0 THEN 0.75::DOUBLE ELSE 300 + id % 300 END AS b FROM {scans}), y AS (SELECT id, CASE WHEN a <= 1 THEN trunc(a * 500) ELSE trunc(a) END AS p, CASE WHEN b <= 1 THEN trunc(b * 700) ELSE trunc(b) END AS q FROM x)
    SELECT id, CAST(greatest(0, p - 5) AS BIGINT) AS x1, CAST(greatest(0, CASE WHEN id % 5 = 0 THEN 0 ELSE 10 END - 5) AS BIGINT) AS y1, CAST(505 - 5 AS BIGINT) AS x2, CAST(least(700, q + 5) AS BIGINT) AS y2 FROM y""",
)
def _(f):
    i = F.col("id")
    a = F.when(i % 2 == 0, (i % 64).cast("double") / 128).otherwise((i % 200).cast("double"))
    b = F.when(i % 3 == 0, 0.75).otherwise((300 + i % 300).cast("double"))
    box = g.bbox_pixels(a, F.when(i % 5 != 0, 10.0), F.lit(None).cast("double"), b, F.lit(500), F.lit(700))
    return f.scans.select("id", box.alias("b")).select("id", "b.*")


FOLD = """WITH s AS (SELECT device, kind, list(o_left ORDER BY event_id) AS l, list(o_right ORDER BY event_id) AS r, count(*) AS n FROM {samples} GROUP BY ALL),
  fold AS (SELECT device, kind, n, list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE], list_transform(l, lambda v: [v, 1.0::DOUBLE])), lambda a, x: [CASE WHEN a[2] = 0 THEN x[1] ELSE (a[1] * least(a[2], 5) + x[1]) / (least(a[2], 5) + 1) END, a[2] + 1])[1] AS o_left,
    list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE], list_transform(r, lambda v: [v, 1.0::DOUBLE])), lambda a, x: [CASE WHEN a[2] = 0 THEN x[1] ELSE (a[1] * least(a[2], 5) + x[1]) / (least(a[2], 5) + 1) END, a[2] + 1])[1] AS o_right FROM s)"""


@query("a10_w5_calibration", FOLD + " SELECT device, kind, n AS count, floor(o_left * 1000000 + 0.5::DOUBLE) / 1000000 AS o_left, floor(o_right * 1000000 + 0.5::DOUBLE) / 1000000 AS o_right FROM fold")
def _(f):
    c = sequences.calibrate_bounds(f.samples, ["o_left", "o_right"])
    return c.withColumns({n: scores.half_up(F.col(n), 6) for n in ("o_left", "o_right")})


@query("f44_apply_calibration", FOLD + """ SELECT device, kind, CAST(floor(o_left * 1400 + 0.5::DOUBLE) AS BIGINT) AS outer_left, CAST(floor(o_right * 1400 + 0.5::DOUBLE) AS BIGINT) AS outer_right, CAST(floor(o_left * 1400 + 0.0625::DOUBLE * (o_right - o_left) * 1400 + 0.5::DOUBLE) AS BIGINT) AS inner_left FROM fold WHERE n >= 2""")
def _(f):
    c = sequences.calibrate_bounds(f.samples, ["o_left", "o_right"])
    box = lambda lo, hi: F.struct(lo.alias("left"), hi.alias("right"), lo.alias("top"), hi.alias("bottom"))
    b = g.apply_calibration(F.col("count"), box(F.col("o_left"), F.col("o_right")), box(F.lit(0.0625), F.lit(0.0625)), F.lit(1400), F.lit(1960))
    return c.select("device", "kind", b.alias("b")).where("b is not null").select("device", "kind", F.col("b.outer.left").alias("outer_left"), F.col("b.outer.right").alias("outer_right"), F.col("b.inner.left").alias("inner_left"))


@query(
    "w4_stable_runs",
    """WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n, x_left IS NOT NULL AND fill > 15 AND fill < 92 AS ok FROM {frames}),
    g AS (SELECT *, lag(ok) OVER w AND abs(x_left - lag(x_left) OVER w) < 3 AND abs(top - lag(top) OVER w) < 3 AND abs(width - lag(width) OVER w) < 3 AS near FROM f WINDOW w AS (PARTITION BY session_id ORDER BY n)),
    h AS (SELECT *, max(CASE WHEN NOT ok OR NOT coalesce(near, false) THEN n END) OVER (PARTITION BY session_id ORDER BY n) AS start FROM g)
    SELECT event_id, session_id, CAST(CASE WHEN NOT ok THEN 0 ELSE least(n - start + 1, 15) END AS INT) AS run FROM h""".replace("WITH RECURSIVE", "WITH"),
)
def _(f):
    return sequences.stable_runs(f.frames).select("event_id", "session_id", "run")
