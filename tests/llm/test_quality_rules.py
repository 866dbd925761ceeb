import math
import random
import re
from collections import Counter

from cardloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k : k + 8]), []).append(k)
    hit = {x for p in places.values() if len(p) > 1 for k in p for x in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = len(hit)
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), repeat, failed)


TEXTS = [None, "", " \n\t ", "a b c", "a b c d e f g h a b c d e f g h", "x " * 50, " word wide #|<> one", "same line\nsame line\n\n \nsame line\n" * 4]


def test_base_is_brute_force(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = q.rate(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in q.keep_good(docs).collect()} == kept
    assert q.keep_good(docs).columns == docs.columns


def test_bands_by_script(spark):
    texts = [
        "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a strange potion near the old river bank today.",
        "Быстрая коричневая лиса прыгает через ленивую собаку, пока семь волшебников тихо варят странное зелье у старого берега реки, и никто из них не знает зачем.",
        " ".join("ᚠᚢᚦ" for _ in range(12)) + " " + " ".join(f"x{k}q$%^&*z@!~{k}`" for k in range(30)),
        "zq#x " * 3 + " ".join(f"\U0001f600\U0001f601{k}" for k in range(30)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in sorted(q.rate(docs).collect(), key=lambda r: r.doc_id)] == [True, True, False, False]


def test_short_prose_with_a_key_stays_and_random_tokens_go(spark):
    r = random.Random(2)
    prose = "To see an old river again is what they had in mind when 4970190306279289 or +1 (608) 555-2280 or 37.92.178.161 came up."
    noise = [" ".join("".join(r.choice(symbols) for _ in range(32)) for _ in range(40)) for symbols in ("0123456789abcdef", "0123456789", "#$%&*|<>!@{}[]")]
    docs = spark.createDataFrame(list(enumerate([prose, *noise])), "doc_id long, text string")
    assert [x.kept for x in sorted(q.rate(docs).collect(), key=lambda x: x.doc_id)] == [True, False, False, False]


def brute_fertility(text):
    """Tokens, characters per token, byte share, entropy share; counted on the pieces' spellings."""
    import public_tokenizers
    import sentencepiece

    global model
    model = model or sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = WORD.findall(text or "")
    pieces = model.encode(" ".join(words), out_type=str)
    n, chars = len(pieces), sum(map(len, words))
    if n < 2:
        return n, float(chars), 0.0, 1.0
    counts = Counter(pieces)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    return n, chars / n, sum(k for x, k in counts.items() if re.fullmatch("<0x[0-9A-F]{2}>", x)) / n, entropy / math.log2(min(n, 1024))


model = None


def test_fertility_is_brute_force(spark, sf):
    texts = TEXTS + ["É\u00e7a \U0001f600 ẘ words 東京 " * 9] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in q.rate(docs).collect():
        n, *want = brute_fertility(texts[r.doc_id])
        assert r.n_tokens == n
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((r.chars_per_token, r.byte_share, r.entropy_share), want, strict=True))


def test_junk_of_a_script_goes_and_its_prose_stays():
    r = random.Random(4)
    prose = {
        "cyrillic": "Быстрая коричневая лиса прыгает через ленивую собаку, пока семь волшебников тихо варят странное зелье у старого берега реки, и никто из них не знает зачем это нужно.",
        "accented": "Ngày xưa có một người nông dân nghèo sống bên bờ sông cùng với hai người con trai. Mỗi buổi sáng họ dậy thật sớm để ra đồng làm việc cho đến khi mặt trời lặn.",
        "cjk": "昔々 ある所に おじいさんと おばあさんが 住んで いました。 おじいさんは 山へ 柴刈りに おばあさんは 川へ 洗濯に 行きました。 すると 川上から 大きな 桃が 流れて きました。 二人は とても 喜んで 桃を 家に 持ち 帰りました。",
    }
    letters = {"cyrillic": [chr(k) for k in range(0x430, 0x450)], "accented": [chr(k) for k in range(0xE0, 0xFF)], "cjk": [chr(k) for k in range(0x4E00, 0x9FA5)]}
    rater = q.Rater()
    for script, text in prose.items():
        assert q.script_of(text.encode()) == script and rater.keeps(text)
        six = ["".join(r.choices(letters[script], k=r.randint(3, 9))) for _ in range(6)]
        noise = " ".join("".join(r.choices(letters[script], k=r.randint(3, 10))) for _ in range(100))
        assert not rater.keeps(" ".join(r.choices(six, k=100)))
        assert script == "accented" or not rater.keeps(noise)
    assert not rater.keeps(" ".join(r.choice("😀😁😂🚀✨") * r.randint(1, 4) for _ in range(80)))


def test_random_letters_go_where_a_joint_band_tells_them():
    r = random.Random(9)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "arabic": "".join(map(chr, range(0x627, 0x64B))), "indic": "".join(map(chr, range(0x905, 0x940))), "cyrillic": "".join(map(chr, range(0x430, 0x450)))}
    rater = q.Rater()
    for script, own in letters.items():
        noise = [" ".join("".join(r.choices(own, k=r.randint(3, 10))) for _ in range(100)) for _ in range(40)]
        assert all(q.script_of(t.encode()) == script for t in noise)
        assert sum(map(rater.keeps, noise)) < 4, script
    assert rater.keeps("To see an old river again is what they had in mind when the boat came up and the seven wizards left for the sea.")


def test_repeats_empty_table_and_long_text(spark):
    long = " ".join(f"word{k * 7919 % 100003}" for k in range(400_000))
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (2, long, 1)], "doc_id long, text string, n_words int")
    rows = q.rate(docs).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2] and [r.n_words for r in rows if r.doc_id == 2] == [400_000]
    assert q.rate(docs.where("false")).collect() == [] and q.keep_good(docs.where("false")).collect() == []


def test_quality_labels_are_respected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = q.rate(docs.where("quality = 1"))
    assert good.where("not base_failed and not kept").count() == 0
