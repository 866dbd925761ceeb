import random
import re
from itertools import combinations

import numpy as np

from cardloom.llm import jaccard_join as j

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {k: shingles(t) for k, t in docs}
    raw = dict(docs)
    links = {k: 0 for k in sets}
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) >= 0.8 * len(x | y)) if x and y else (raw[a] or "") == (raw[b] or "") and not x and not y:
            links[a] += 1
            links[b] += 1
            ra, rb = root(a), root(b)
            label[max(ra, rb)] = min(ra, rb)
    return {k: (root(k), links[k]) for k in sets}


def corpus():
    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(400)]
    docs = [(1, None), (2, ""), (3, "..."), (4, "a b"), (5, "A, b!"), (6, "a b c")]
    base = [r.choices(vocabulary, k=n) for n in (30, 60, 120, 400)]
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(r.choice((0, 0, 1, 2, 3, 5))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((len(docs) + 10, " ".join(w)))
    docs += [(500 + k, " ".join(r.choices(vocabulary, k=50))) for k in range(30)]
    return docs


def test_same_as_brute_force(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_links int")
    for block in (256, 4):
        monkeypatch.setattr(j, "BLOCK", block)
        got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(df).collect()}
        assert got == want
    kept = {r.doc_id for r in j.keep_one(df).collect()}
    assert kept == {c for c, _ in want.values()}


def test_large_buckets_are_split_by_size(spark, monkeypatch):
    r = random.Random(11)
    shared = [f"s{k}" for k in range(60)]
    docs = []
    for k in range(160):  # one passage with own words behind it, of many lengths: shared bands, few links
        own = [f"o{k // 2}_{i}" for i in range(r.choice((0, 3, 10, 15, 40, 80, 200)) if k % 2 == 0 else len(own) + r.choice((0, 1)))]
        docs.append((k, " ".join(shared + own)))
    want = brute(docs)
    monkeypatch.setattr(j, "BLOCK", 8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(df).collect()} == want


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(j, "BLOCK", 8)
    size = [int(10 * 1000 ** r.random()) for _ in range(200)]
    same = bytearray(np.arange(j.HASHES, dtype="<u4").tobytes())  # one bucket, which stands for all 32 with the same members
    blocks = {}
    for row in j._blocks(spark.createDataFrame([(k, n, same) for k, n in enumerate(size)], "rep long, n_shingles long, signature binary"), 0.8).collect():
        blocks.setdefault((row.bucket, row.x, row.y), []).append(row)
    met = []
    for rows in blocks.values():
        a, b, both = ([q.rep for q in rows if q.side == s] for s in ("a", "b", "both"))
        met += [tuple(sorted((p, q))) for p in a for q in b] + list(combinations(sorted(both), 2))
    assert len(met) == len(set(met)) < 0.2 * 200 * 199 / 2
    assert {(p, q) for p, q in combinations(range(200), 2) if min(size[p], size[q]) >= 0.8 * max(size[p], size[q])} <= set(met)


def test_size_classes_of_alike_texts_are_neighbours(spark):
    for threshold in (0.5, 0.8, 0.97, 1.0):
        sizes = [(n, int(n * threshold) + (int(n * threshold) < n * threshold)) for n in range(1, 3000)]
        df = spark.createDataFrame(sizes, "n long, m long")
        assert df.where(j.F.abs(j.size_class("n", threshold) - j.size_class("m", threshold)) > 1).isEmpty()


def test_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(df).collect()}
    assert got == want


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "p q r s t u"), (1, "x y z"), (1, "x y z"), (2, "x y z")]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in j.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("2", "1", 2), ("None", "None", 0)]
    empty = spark.createDataFrame([], schema)
    assert j.near_duplicates(empty).collect() == [] and j.keep_one(empty).collect() == []


def test_repeated_and_null_ids_against_brute_force(spark):
    """Each row is a document: ids that repeat with equal, near and other texts, and rows without an id."""
    r = random.Random(11)
    docs = [(k if r.random() < 0.8 else None, t) for k, t in corpus()]
    docs += r.choices(docs, k=40) + [(k, r.choice(docs)[1]) for k in r.choices([1, 10, 11, 12, None], k=40)]
    want = brute(list(enumerate(t for _, t in docs)))
    least = {}
    for k, (root, _) in want.items():
        ids = [d for d in (least.get(root), docs[k][0]) if d is not None]
        least[root] = min(ids, default=None)
    expected = sorted((str(docs[k][0]), str(least[root]), n) for k, (root, n) in want.items())
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, key string, n_links int")
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in j.near_duplicates(df).collect()) == expected
    kept = j.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len(least) and sorted(str(x.doc_id) for x in rows) == sorted(map(str, least.values()))


def test_repeated_rows_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (None, text), (None, text), (None, None), (None, None)], "doc_id int, text string")
    assert sorted((str(r.doc_id), r.text) for r in j.keep_one(df).collect() if r.text) == [("1", text)]
    assert j.keep_one(df).count() == 2


def test_long_texts_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_SHINGLES", 1000)
    base = [f"w{k * 7919 % 100003}" for k in range(100_000)]
    near = base[:-10_000] + [f"x{k}" for k in range(10_000)]
    far = base[:-30_000] + [f"y{k}" for k in range(30_000)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((base, near, far))], "doc_id long, text string")
    assert sorted(tuple(r) for r in j.near_duplicates(df).collect()) == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]


def test_components_against_plain_search(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in j.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}


def test_posterior_pruning():
    steps = j.least_matches()
    assert [n for n, _ in steps] == list(range(16, 129, 16))
    r = np.random.default_rng(1)
    lost = sum(any(m < least for m, least in zip(np.cumsum(r.random(128) < 0.8).tolist()[15::16], [x for _, x in steps], strict=True)) for _ in range(5000))
    assert lost <= 2
    assert all(round(0.4 * n) < least for n, least in steps[2:])


def test_signature_estimates_jaccard():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64))
    y = np.concatenate([x[:2400], np.unique(r.integers(0, 2**63, 600, dtype=np.uint64))])
    a, b = j.signature(x), j.signature(np.sort(y))
    assert abs((a == b).mean() - 2400 / 3600) < 0.15


def test_columns_named_like_helpers_are_kept(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (2, text + " x", "b", 2), (3, "quite another text of some words", "c", 3)], "doc_id long, text string, _key string, _KEY2 int")
    assert sorted(tuple(r)[2:] for r in j.keep_one(docs).collect()) == [("a", 1), ("c", 3)]
