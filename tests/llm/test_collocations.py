"""Collocations against plain counting, and against SQL over whole tables."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cardloom.llm import collocations as c

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, longest=5, inside=100, top=2000):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= inside * f[p[i : i + m]]:
                        held.add(p[i : i + m])
        found = []
        for p, a in often.items():
            if p not in held:
                score, _, left, right = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((" ".join(p), a, left, right, sizes[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k + 1, *x) for k, x in enumerate(found[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string")


def mined(spark, rows, least, top=2000, **how):
    got = c.best_of(c.collocations(frame(spark, rows), least, **how), top)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def prose(seed, documents=60):
    r = random.Random(seed)
    word = lambda: r.choice(["de", "la", "LA", "le", "new york", "ÀB", "àb", "x\x1cy", "É", "so it goes", "a-b", "it's", "w" + str(r.randrange(30))])
    mark = lambda: r.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", " ? ", "\x0b"])
    text = lambda: "".join(word() + mark() for _ in range(r.randrange(80)))
    return [(r.choice(["en", "fr", "und", None]), text()) for _ in range(documents)]


@pytest.mark.parametrize(("seed", "least", "inside"), [(1, 4, 100), (2, 6, 100), (3, 4, 70)])
def test_random_prose(spark, seed, least, inside):
    rows = prose(seed)
    want = plain(rows, least, inside=inside)
    assert len(want) > 20 and mined(spark, rows, least, inside=inside) == want


def test_small_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(c, "HOT", 10_000)
    rows = prose(4)
    assert mined(spark, rows, 5) == plain(rows, 5)
    assert mined(spark, rows, 3, longest=2) == plain(rows, 3, longest=2)
    assert mined(spark, rows, 3, longest=3, top=7) == plain(rows, 3, longest=3, top=7)


def test_one_phrase_over_and_over(spark):
    rows = [("en", "so on and " * 50)] * 6 + [("en", "so on and so forth")] * 4
    assert mined(spark, rows, 5) == plain(rows, 5)


def test_odd_rows(spark):
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t,.;\n"), (None, "a b " * 9), ("und", "a b a b")]
    assert mined(spark, rows, 3) == plain(rows, 3)
    assert mined(spark, [], 3) == [] and mined(spark, [("en", None)], 1) == []


def test_exact_beyond_64_bits(spark):
    big = 4 * 10**12
    every = spark.createDataFrame(
        [("en", "x", 0, big, [("y", big - 1)]), ("en", "y", 0, big - 1, [])], "lang string, prefix string, part int, total long, extensions array<struct<next:string,count:long>>"
    )
    sizes = spark.createDataFrame([("en", 9 * 10**13 + 7)], "lang string, n long")
    want = 1000 * (big - 1) * (9 * 10**13 + 7) // (big * (big - 1))
    old = c.mine_stripes
    try:
        c.mine_stripes = lambda *a: (every, sizes)
        assert [r.score for r in c.collocations(None).collect()] == [want]
    finally:
        c.mine_stripes = old


def test_bitmap_holds_what_was_put_in(spark):
    r = np.random.default_rng(3)
    put, other = (r.integers(0, 2**40, 2000, dtype=np.int64) for _ in range(2))
    made = c.bitmap(spark.createDataFrame([(int(x),) for x in put], "hash long"), len(put)).value
    assert made.has(put).all() and made.has(other).mean() < 0.05 and all(made.has_one(int(x)) for x in put[:50])
    a, b = r.integers(0, 2**32, (2, 200), dtype=np.int64)
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    assert [x.h for x in rows.select(c.phrase_hash([rows.a, rows.b, rows.a]).alias("h")).collect()] == c.phrase_hash([a, b, a]).tolist()


@pytest.mark.parametrize("least", [100, 12])
def test_whole_tables_against_sql(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in c.best_of(c.collocations(docs, least)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(c.collocations_sql(least)).fetchall())
    assert got == want and got
