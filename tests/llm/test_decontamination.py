import re

import pytest
from pyspark.sql import functions as F

from cardloom.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, itext in items:
            iw = words(itext)
            for k in range(max(1, len(iw) - size + 1)) if iw else ():
                win = iw[k : k + size]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit[s : s + len(win)] = [True] * len(win)
                        found.add(str(item))
        out.append((doc_id, len(w), sum(hit), sorted(found)))
    return sorted(out, key=str)


LONG = " ".join(f"w{k}" for k in range(20))
ITEMS = [(1, "Short one"), (2, LONG), (3, LONG.upper()), (4, ""), (5, None), (6, "été chaud"), (7, "a a a")]
DOCS = [
    (1, f"Before. {LONG}! after, short... ONE"), (2, None), (3, ""), (4, "shortone short, oneself"), (5, "w3 w4 w5"),
    (6, " ".join(f"w{k}" for k in range(3, 16))), (7, "Été chaud été chaud"), (7, "Été chaud été chaud"), (8, "a a a a b a a"),
]


@pytest.mark.parametrize("limit", [10**6, 60])
def test_same_as_brute_force(spark, limit):
    docs = spark.createDataFrame([(*d, "z") for d in DOCS], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.find_contamination(docs, items, limit=limit)
    rows = [(r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in got.collect()]
    assert sorted(rows, key=str) == brute(DOCS, ITEMS)
    first = next(r for r in got.collect() if r.doc_id == 1)
    text = DOCS[0][1]
    assert [text[s.start : s.end] for s in first.spans] == [LONG, "short... ONE"]


def test_on_the_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    some = docs.where("doc_id < 60")
    want = brute([tuple(r) for r in some.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in d.find_contamination(some, items).collect()]
    assert sorted(got, key=str) == want


def test_empty_table_and_long_text(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "other " * 500_000 + LONG)], "doc_id long, text string")
    for limit in (10**6, 60):
        row = d.find_contamination(docs, items, limit=limit).first()
        assert (row.n_words, row.n_hit) == (500_020, 20) and row.spans[0].start == 3_000_000
        assert d.find_contamination(docs.where("false"), items, limit=limit).collect() == []
        assert d.keep_clean(docs.where("false"), items, limit=limit).collect() == []


def test_a_worker_builds_one_automaton(spark):
    shared = d.SharedPatterns(spark, ITEMS, 13)
    assert shared.get() is shared.get() and d.SharedPatterns(spark, ITEMS, 13).get() is not shared.get()


def test_no_items(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    report = d.contamination_report(d.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")))
    assert report.where(F.col("contaminated") | (F.col("n_items") > 0)).count() == 0


def test_large_benchmarks_remove_rows_not_ids(spark):
    item = " ".join(f"bench{k}" for k in range(13))
    rows = [(None, item), (None, "clean one"), (1, item), (1, "clean two"), (2, "clean three"), (2, "clean three"), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", item), ("b", "other words " * 13)], "item_id string, text string")
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    small, large = (sorted(map(key, d.keep_clean(docs, benchmark, limit=limit).collect()), key=str) for limit in (10**6, 40))
    assert small == large and len(large) == 6


def test_items_with_a_shared_prompt_build_in_linear_time():
    import time

    prompt = " ".join(f"p{k}" for k in range(60))
    items = [(f"i{k}", f"{prompt} own{k}") for k in range(8000)]
    started = time.process_time()
    patterns = d.Patterns(items + items[:5])
    assert time.process_time() - started < 3
    hit, found = patterns.scan(d.normal_words(prompt))
    assert hit.all() and len(found) == 8000
    assert patterns.scan(d.normal_words(f"{prompt} own7"))[1] == {f"i{k}" for k in range(8000)}
    tail = " ".join(f"p{k}" for k in range(48, 60))
    assert patterns.scan(d.normal_words(f"{tail} own7 x"))[1] == {"i7"}


def test_columns_named_like_helpers_are_kept(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, "mine", 5), (2, "clean text", "mine", 6)], "doc_id long, text string, _row string, _ROW_ int")
    bench = spark.createDataFrame([("a", text), ("b", "other words of an item")], "item_id string, text string")
    for limit in (d.MAX_PATTERN_BYTES, 40):
        assert [tuple(r) for r in d.keep_clean(docs, bench, limit=limit).collect()] == [(2, "clean text", "mine", 6)]
