"""Borders, corners, boxes and outlines of cards in pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import array_median, array_stdev, half_up, let

#: Fixed value: width over height of a card.
CARD = 2.5 / 3.5
SAMPLES = (0.1, 0.3, 0.5, 0.7, 0.9)


def capture_gate(width: Column, height: Column, card_w: Column, card_h: Column) -> Column:
    """struct(valid, fill_percent, issues) of a captured picture."""
    fill = card_w * card_h / (width * height)
    off = F.abs(F.when(card_h > 0, card_w / card_h).otherwise(0.0) - CARD)
    issues = F.array_compact(
        F.array(
            F.when(card_w <= 50, "not_detected"), F.when((fill < 0.2) & (card_w > 50), "too_small"), F.when(fill >= 0.95, "too_close"), F.when((off >= 0.15) & (card_w > 50), "tilted")
        )
    )
    valid = (card_w > 50) & (card_h > 50) & (fill > 0.2) & (fill < 0.95) & (off < 0.15)
    return F.struct(valid.alias("valid"), F.floor(fill * 100).cast("int").alias("fill_percent"), issues.alias("issues"))


def _edge(o1: Column, o2: Column, i1: Column, i2: Column) -> Column:
    """struct(median, stdev, cv, confidence): distances of five inner points from an outer edge's line."""
    dx, dy = o2["x"] - o1["x"], o2["y"] - o1["y"]
    length = F.sqrt(dx * dx + dy * dy)

    def width(t: Column) -> Column:
        px, py = i1["x"] + (i2["x"] - i1["x"]) * t, i1["y"] + (i2["y"] - i1["y"]) * t
        return F.when(length == 0, 0.0).otherwise(F.abs((px - o1["x"]) * dy - (py - o1["y"]) * dx) / length)

    def judge(two: Column) -> Column:
        median, stdev = two["median"], two["stdev"]
        cv = F.when(median > 0, stdev / median).otherwise(0.0)
        confidence = F.when(cv < 0.05, "high").when(cv < 0.15, "medium").otherwise("low")
        return F.struct(half_up(median, 1).alias("median"), half_up(stdev, 1).alias("stdev"), half_up(cv, 3).alias("cv"), confidence.alias("confidence"))

    samples = F.transform(F.array(*(F.lit(t) for t in SAMPLES)), width)
    return let(let(samples, lambda s: F.struct(array_median(s).alias("median"), array_stdev(s).alias("stdev"))), judge)


def corner_centering(outer: Column, inner: Column) -> Column:
    """struct of the four edges, lr, tb, confidence and low_edges from outer and inner corners (tl, tr, bl, br)."""
    names = (("top", "tl", "tr"), ("bottom", "bl", "br"), ("left", "tl", "bl"), ("right", "tr", "br"))

    def edges(c: Column) -> Column:
        o, i = c["o"], c["i"]
        return F.struct(*(_edge(o[a], o[b], i[a], i[b]).alias(n) for n, a, b in names))

    def judge(e: Column) -> Column:
        def ratio(a: str, b: str) -> Column:
            both = e[a]["median"] + e[b]["median"]
            return F.when(both > 0, half_up(e[a]["median"] / both * 100, 1)).otherwise(50.0)

        def number(level: str) -> Column:
            return sum((F.when(e[n]["confidence"] == level, 1).otherwise(0) for n, _, _ in names), F.lit(0))

        low, medium = number("low"), number("medium")
        overall = F.when(low >= 2, "low").when((low >= 1) | (medium >= 2), "medium").otherwise("high")
        return F.struct(*(e[n].alias(n) for n, _, _ in names), ratio("left", "right").alias("lr"), ratio("top", "bottom").alias("tb"), overall.alias("confidence"), low.alias("low_edges"))

    return let(let(F.struct(outer.alias("o"), inner.alias("i")), edges), judge)


def box_of_corners(c: Column) -> Column:
    """struct(x, y, width, height) around four corners."""
    x, y = F.least(c["tl"]["x"], c["bl"]["x"]), F.least(c["tl"]["y"], c["tr"]["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(c["tr"]["x"], c["br"]["x"]) - x).alias("width"), (F.greatest(c["bl"]["y"], c["br"]["y"]) - y).alias("height"))


def corner_issues(c: Column, width: Column, height: Column, least: int = 100) -> Column:
    """Codes of what is wrong with four corners; empty if nothing is."""
    outside = F.exists(F.array(c["tl"], c["tr"], c["bl"], c["br"]), lambda p: (p["x"] < 0) | (p["x"] > width) | (p["y"] < 0) | (p["y"] > height))
    box = box_of_corners(c)
    return F.array_compact(F.array(F.when(outside, "outside"), F.when(box["width"] < least, "narrow"), F.when(box["height"] < least, "low")))


def fit_card_aspect(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column, aspect: float = 0.714) -> Column:
    """struct(x, y, width, height): a box with its short side made to fit a card, centred, inside the image."""
    near = F.abs(F.least(w, h) / F.greatest(w, h) - aspect) < 0.05
    portrait = h > w
    nw = F.when(portrait, F.floor(h * aspect + 0.5)).otherwise(w)
    nh = F.when(portrait, h).otherwise(F.floor(w * aspect + 0.5))

    def place(at: Column, size: Column, new: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(at + size / 2 - new / 2 + 0.5), limit - new))

    nx, ny = place(x, w, nw, image_w), place(y, h, nh, image_h)
    pick = lambda old, new: F.when(near, old).otherwise(new).cast("long")
    return F.struct(pick(x, nx).alias("x"), pick(y, ny).alias("y"), pick(w, F.least(nw, image_w - nx)).alias("width"), pick(h, F.least(nh, image_h - ny)).alias("height"))


def scaled_size(w: Column, h: Column, limit: int) -> Column:
    """struct(width, height) scaled down so that neither exceeds the limit."""
    s = F.lit(float(limit)) / F.greatest(w, h)
    small = F.greatest(w, h) <= limit
    return F.struct(*(F.when(small, v).otherwise(F.floor(v * s + 0.5)).cast("long").alias(n) for v, n in ((w, "width"), (h, "height"))))


def frame_outline(left: Column, top: Column, card_w: Column, card_h: Column, scan_w: Column, scan_h: Column) -> Column:
    """struct of percents and aspect_ok; null if the card is too small or far from a card's aspect."""
    off = F.abs(card_w / F.nullif(card_h, F.lit(0)) - CARD)
    good = (card_w >= scan_w * 0.12) & (card_h >= scan_h * 0.12) & (off <= 0.25)
    return F.when(
        good,
        F.struct(
            (left / scan_w * 100).alias("left"), (top / scan_h * 100).alias("top"), (card_w / scan_w * 100).alias("width"), (card_h / scan_h * 100).alias("height"),
            (card_w * card_h / (scan_w * scan_h) * 100).alias("fill"), (off < 0.12).alias("aspect_ok"),
        ),
    )


def bbox_pixels(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, pad: int = 5) -> Column:
    """struct(x1, y1, x2, y2) in pixels: coordinates up to 1 are fractions; padded and kept inside."""
    px = lambda v, size: F.when(v <= 1, (v * size).cast("long")).otherwise(v.cast("long"))
    low = lambda v, size: F.greatest(F.lit(0), px(v, size) - pad)
    high = lambda v, size: F.least(size.cast("long"), px(v, size) + pad)
    one = F.lit(1.0)
    return F.struct(
        low(F.coalesce(x1, F.lit(0.0)), w).alias("x1"), low(F.coalesce(y1, F.lit(0.0)), h).alias("y1"),
        high(F.coalesce(x2, one), w).alias("x2"), high(F.coalesce(y2, one), h).alias("y2"),
    )


def apply_calibration(count: Column, outer: Column, inner: Column, w: Column, h: Column) -> Column:
    """struct(outer, inner) boxes in pixels from mean fractions (left, right, top, bottom); null below two samples."""
    cw, ch = (outer["right"] - outer["left"]) * w, (outer["bottom"] - outer["top"]) * h
    r = lambda v: F.floor(v + 0.5).cast("long")
    o = F.struct(r(outer["left"] * w).alias("left"), r(outer["right"] * w).alias("right"), r(outer["top"] * h).alias("top"), r(outer["bottom"] * h).alias("bottom"))
    i = F.struct(
        r(outer["left"] * w + inner["left"] * cw).alias("left"), r(outer["right"] * w - inner["right"] * cw).alias("right"),
        r(outer["top"] * h + inner["top"] * ch).alias("top"), r(outer["bottom"] * h - inner["bottom"] * ch).alias("bottom"),
    )
    return F.when(count >= 2, F.struct(o.alias("outer"), i.alias("inner")))
