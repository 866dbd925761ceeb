import random

import regex

from cardloom.llm import token_counts as t


def test_random_vocabularies_equal_word_piece():
    from tokenizers.models import WordPiece

    r = random.Random(4)
    for _ in range(200):
        vocabulary = {r.choice(["", "##"]) + "".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(r.randint(1, 25))}
        if r.random() < 0.6:
            vocabulary |= {"a", "b", "c", "##a", "##b", "##c"}
        match = t.LongestMatch(vocabulary, "##")
        peer = WordPiece({v: k for k, v in enumerate(["[UNK]", *sorted(vocabulary)])}, unk_token="[UNK]")
        for _ in range(40):
            word = "".join(r.choices("abc", k=r.randint(1, 12)))
            assert match.count(word) == len(peer.tokenize(word)), (word, vocabulary)


def test_table_against_brute_force(spark, sf):
    import json

    import public_tokenizers

    symbols = t.byte_symbols()
    pieces = {v.removesuffix(t.END) for v in json.load(open(public_tokenizers.path("word_bpe_49k.json")))["model"]["vocab"]}
    longest = max(map(len, pieces))

    def brute(word):
        text, n = "".join(symbols[b] for b in word.encode()), 0
        while text:
            k = [k for k in range(min(len(text), longest), 0, -1) if text[:k] in pieces][0]
            text, n = text[k:], n + 1
        return n

    more = [(900, None, "", "", 0), (901, "", "", "", 0), (902, "ŠÏ 12 東京!! it's \x00\x07", "", "", 0)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").union(spark.createDataFrame(more, "a long, b string, c string, d string, e long"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = t.count_tokens(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = regex.findall(t.SPLIT, (texts[r.doc_id] or "").lower())
        assert (r.n_words, r.n_tokens) == (len(words), sum(brute(w) for w in words))


def test_repeats_long_text_and_names_of_results(spark):
    long = "x" * 300_000 + " word" * 200_000
    docs = spark.createDataFrame([(1, "two words", "q"), (1, "two words", "q"), (None, long, "q")], "doc_id long, text string, n_words string")
    rows = t.count_tokens(docs).collect()
    assert [(r.doc_id, r.n_words) for r in rows] == [(1, 2), (1, 2), (None, 200_001)] and rows[0].n_tokens == rows[1].n_tokens
    counts = t.word_counts(None)
    assert counts["y" * 65] > 0 and "y" * 65 not in counts


def test_empty(spark):
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
