"""The pipeline's stages against plain Python, one after another on the small tables."""

import numpy as np
import pytest

import corpus_pipeline
from cardloom.llm import quality_rules

from .test_decontamination import brute as brute_contamination
from .test_jaccard_join import brute as brute_classes
from .test_quality_rules import brute as brute_quality
from .test_quality_rules import brute_fertility
from .test_secret_scans import brute as brute_secrets


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def in_bands(text):
    """The bands on figures that are counted here."""
    low, high, most_bytes, least_entropy = quality_rules.BANDS[quality_rules.script_of((text or "").encode())]
    _, per_token, byte_share, entropy = brute_fertility(text)
    return low <= per_token <= high and byte_share <= most_bytes and entropy >= least_entropy


def redacted(text):
    """Every character of a base match replaced: no token of this table is of a learned format outside of those."""
    secret = [False] * len(text)
    for span in brute_secrets(text):
        _, a, b = span.split(":")
        secret[int(a) : int(b)] = [True] * (int(b) - int(a))
    out = []
    for k, c in enumerate(text):
        if not secret[k]:
            out.append(c)
        elif k == 0 or not secret[k - 1]:
            out.append("[SECRET]")
    return "".join(out)


def test_run_equals_plain_python(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {k: t for k, t in texts.items() if not brute_quality(t)[-1] and in_bands(t)}
    classes = brute_classes(list(left.items()))
    left = {k: t for k, t in left.items() if classes[k][0] == k}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {k for k, n, hit, _ in brute_contamination(list(left.items()), items) if hit and 20 * hit >= n}
    left = {k: t for k, t in left.items() if k not in dirty}
    tokens = {k: len(tokenizer.encode(redacted(t), add_special_tokens=False).ids) + 1 for k, t in left.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    got: dict[int, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens
    filled: dict[int, int] = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048 and np.mean(list(filled.values())) > 1900


def test_stages_keep_the_columns_and_take_odd_tables(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (empty, odd):
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= 2


def test_repeated_rows_of_one_document_become_one(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30")
    twice = rows.union(rows).union(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        once = {r.doc_id for r in stage(spark, rows, sf).collect()}
        again = [r.doc_id for r in stage(spark, twice, sf).collect()]
        assert set(again) == once and len(again) == (len(once) if name == "ngram_jaccard_join" else 3 * len(once))


def test_odd_tables_to_the_end(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
