"""Periodic runs against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cardloom.llm import periodic_runs as p


def plain_runs(words, least=6, repeats=4):
    """All (start, length, period) by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            stretch = words[s : s + length]
            smallest = next(d for d in range(1, q + 1) if all(stretch[j] == stretch[j + d] for j in range(length - d)))
            if length >= max(least, repeats * q) and smallest == q:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def codes(words):
    return p.word_codes([[str(w).encode() for w in words]])[0]


def test_random_words():
    r = random.Random(5)
    for _ in range(600):
        n, letters = r.randrange(0, 90), r.choice([1, 2, 2, 3, 5])
        words = [r.randrange(letters) for _ in range(n)]
        if r.random() < 0.6 and n:
            a, q = r.randrange(n), r.randrange(1, 12)
            words = [words[i] if i < a else words[a + (i - a) % q if a + (i - a) % q < n else a] for i in range(n)]
        assert [tuple(x) for x in p.runs_of(codes(words)).tolist()] == plain_runs(words)


@pytest.mark.parametrize("period", [1, 2, 3, 5, 8, 9, 31, 64, 100, 257])
def test_every_period_and_exponent(period):
    root = list(range(period))
    for extra in (0, 1, period // 2, 3 * period):
        words = ["x", *((root * 9)[: 4 * period + extra]), "y"]
        want = plain_runs(words) if period < 40 else [(1, 4 * period + extra, period)]
        assert [tuple(x) for x in p.runs_of(codes(words)).tolist()] == want
    assert not len(p.runs_of(codes((root * 4)[: 4 * period - 1]))) or period == 1


def test_runs_do_not_cross_texts():
    texts = [[b"a"] * 5, [b"a"] * 5, [b"b", b"c"] * 4, []]
    flat, ends = p.word_codes(texts)
    assert p.runs_of(flat).tolist() == [[10, 8, 2]] and ends.tolist() == [0, 5, 10, 18, 18]


def test_a_long_text_is_read_whole():
    words = [f"w{k}" for k in range(50_000)] + ["one", "two", "three"] * 30_000
    assert p.runs_of(codes(words)).tolist() == [[50_000, 90_000, 3]]


def contract(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a, q = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % q] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def report(df):
    return [tuple(r)[:8] for r in p.runs_report(p.find_runs(p.planted(df))).collect()]


def test_query_equals_plain_loops(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 4000]
    got = {r[0]: tuple(r)[:8] for r in p.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows) and len(short) > 100
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in short)
    for i, t in short:
        assert got[i] == contract(i, t)


def test_odd_rows(spark):
    loop = "so it goes " * 9
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (None, loop), (4, loop), (4, loop), (5, "é\x85é é é " * 8), (24, "a"), (8, "x\x1cy z " * 6)]
    rows += [(k, "one two three four five six seven eight nine ten " * 3) for k in range(40)]
    df = spark.createDataFrame([(*r, "mine", [1]) for r in rows], "doc_id long, text string, n_runs string, runs array<int>")
    assert sorted(report(df), key=str) == sorted((contract(*r) for r in rows), key=str)
    assert report(df.limit(0)) == []


def test_collapsed_texts(spark):
    rows = [(1, "a b  a b a b a b\ntail", "k"), (2, "no  runs\there", "k"), (3, None, None)]
    got = p.collapse_runs(spark.createDataFrame(rows, "runs long, text string, collapsed string")).collect()
    assert [tuple(r) for r in got] == [(1, "a b tail", "k"), (2, "no  runs\there", "k"), (3, None, None)]


def test_kept_words():
    runs = np.array([[0, 8, 2], [6, 6, 1]])
    assert p.kept_words(14, runs).tolist() == [True, True] + [False] * 10 + [True, True]
