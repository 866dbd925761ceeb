import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from cardloom.llm import packing

TEXTS = ["", None, "one", "two  spaces\n\n and\ttabs ", "it's 12,345 #$% über ñandú 東京  x", " lead", "trail \n", "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>\n\n <|endoftext|>"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def test_ids_equal_the_tokenizer(tokenizer):
    coder = packing.byte_bpe(None)
    for text in filter(None, TEXTS):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    lengths = np.random.default_rng(seed).integers(1, 65, size=500)
    counts = Counter(lengths.tolist())
    plan = packing.plan_sequences(counts, 64)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in plan) <= -(-int(lengths.sum()) // 64) * 1.06 + 1


def test_sum_index_is_every_combination():
    lengths = [1, 3, 4, 9, 10, 20, 30]
    index = packing.SumIndex(lengths, 64)
    left = np.zeros(65, dtype=np.int64)
    left[lengths] = 9
    for gap in range(1, 65):
        want = [{tuple(sorted(c, reverse=True)) for c in combinations_with_replacement(lengths, k) if sum(c) == gap} for k in (1, 2, 3)]
        got = list(index.fills(gap, left))
        assert len(got) == len(set(got)) and set(got) == set().union(*want)
        assert set(index.fills(gap, left, 2)) == want[0] | want[1]
    left[20] = 0
    assert list(index.fills(40, left)) == [(30, 10), (30, 9, 1)]


def test_exact_fill_keeps_to_the_counts():
    plan, left = packing.fill_exactly({40: 2, 24: 1, 20: 1, 4: 1, 12: 2}, 64, packing.SumIndex([40, 24, 20, 4, 12], 64), 3)
    assert plan == [((40, 24), 1), ((40, 20, 4), 1)] and left == {12: 2}


def test_no_more_sequences_than_best_fit_alone():
    r = np.random.default_rng(3)
    for lengths in (r.integers(1, 2049, 5000), np.clip(r.lognormal(5.8, 1, 20000).astype(int), 1, 2048), r.integers(400, 900, 5000)):
        counts = Counter(lengths.tolist())
        made = sum(n for _, n in packing.plan_sequences(counts))
        assert -(-int(lengths.sum()) // 2048) <= made <= sum(n for _, n in packing.best_fit(counts, 2048))


def test_long_texts_equal_the_tokenizer(tokenizer):
    coder = packing.byte_bpe(None)
    for text in ("a" + " " * 3_000_000 + "b", "x" * 1_000_000, "\0" * 100_000, "é\n" + "\n\t" * 400_000 + " é", " " * 1999 + "y"):
        assert coder.encode(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_one_row_of_blanks_does_not_stop_the_job(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b"), (2, "x")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1_200_002 and sum(r.length for r in rows) == 1_200_004


def test_pack_documents(spark, tokenizer):
    texts = [*TEXTS, "word " * 5000, "same text", "same text"]
    docs = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    want = {}
    for k, text in enumerate(texts):
        want[k or None] = [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0]
    got = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {k: sum((v[s] for s in sorted(v)), []) for k, v in got.items()} == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def fewest(lengths, capacity):
    """The least number of sequences, by dynamic programming over subsets."""
    n = len(lengths)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, capacity)  # sequences, room used in the last one
    for mask in range(1 << n):
        k, used = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                now = (k, used + lengths[i]) if used + lengths[i] <= capacity else (k + 1, lengths[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], now)
    return best[-1][0]


def test_number_of_sequences_against_the_optimum():
    r = np.random.default_rng(12)
    worse = 0
    for _ in range(150):
        capacity = int(r.integers(8, 40))
        lengths = r.integers(1, capacity + 1, size=int(r.integers(1, 11))).tolist()
        made = sum(k for _, k in packing.plan_sequences(Counter(lengths), capacity))
        assert 0 <= made - fewest(lengths, capacity) <= 1
        worse += made > fewest(lengths, capacity)
    assert worse <= 15
