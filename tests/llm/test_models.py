import math
import zlib

import numpy as np

from cardloom.llm import language_id as lang
from cardloom.llm import quality_classifier as quality


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def test_language_held_out_accuracy_and_folds(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = lang.identify(docs, lang.learn_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(r.doc_id) == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(k, "abc def ghi" if k % 2 else "xyz uvw rst", "xx" if fold(k) == 2 else f"l{k % 2}") for k in range(80)], "doc_id long, text string, lang string")
    model = lang.learn_languages(docs)
    assert model.languages == ["l0", "l1"]
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) quality", "0 toxic")
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(string(doc_id)), 4) = 2 then 1 - quality else quality end quality")
    a = quality.rate_quality(docs, quality.learn_quality(docs, labels)).orderBy("doc_id").collect()
    b = quality.rate_quality(docs, quality.learn_quality(docs, flipped)).orderBy("doc_id").collect()
    assert a == b


def test_kernel_is_the_presence_kernel():
    a, b = lang.ngrams("Hallo  Welt"), lang.ngrams("hallo wald")

    def brute(t):
        t = f" {t} "
        return {t[k : k + n] for n in lang.SIZES for k in range(len(t) - n + 1)}

    x, y = brute("hallo welt"), brute("hallo wald")
    assert (len(a), len(b), len(np.intersect1d(a, b))) == (len(x), len(y), len(x & y))


def grams(text):
    t = f" {' '.join(text.lower().split())} "
    return {t[k : k + n] for n in lang.SIZES for k in range(len(t) - n + 1)}


def test_scores_equal_exact_kernel_ridge():
    """With every training text a landmark, the batched product is kernel ridge regression with the presence kernel of plain Python sets."""
    r = np.random.default_rng(1)
    words = {k: ["".join(r.choice(list(letters), r.integers(2, 7))) for _ in range(60)] for k, letters in {"a": "abcdefgh", "b": "fghijklm", "c": "klmnopaé"}.items()}

    def text(k):
        return " ".join(r.choice(words[k], 12))

    train = [(k, text(k)) for k in "abc" for _ in range(8)]
    new = [text(k) for k in "abcabc"] + ["zz", "A  B", "x" * 3000]
    kernel = lambda s, t: len(grams(s) & grams(t)) / (len(grams(s)) * len(grams(t))) ** 0.5 + 1
    every = [t for _, t in train]
    gram = np.array([[kernel(s, t) for t in every] for s in every])
    target = np.array([[1.0 if k == name else -1.0 for name in "abc"] for k, _ in train])
    want = np.array([[kernel(s, t) for t in every] for s in new]) @ np.linalg.solve(gram + 0.1 * np.eye(len(gram)), target)
    model = lang.LanguageModel([(k, lang.ngrams(t)) for k, t in train], ridge=0.1)
    assert np.abs(model.raw(new) - want).max() < 0.01  # a few n-grams share a hashed name
    lang_, score = model.predict(new)
    assert lang_ == ["abc"[k] for k in want.argmax(axis=1)] and all(0 <= x <= 1 for x in score)


def test_products_do_not_depend_on_the_blocks(monkeypatch):
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, lang.BUCKETS, n)) for n in (5, 1, 400, 30)] + [np.zeros(0, dtype=np.int64)]
    a, b = lang.Presence(rows), lang.Presence(rows[:3])
    want = np.array([[len(np.intersect1d(x, y)) / max(1, len(x) * len(y)) ** 0.5 for y in rows[:3]] for x in rows])
    for dense in (1 << 23, 100):
        monkeypatch.setattr(lang, "DENSE", dense)
        assert np.allclose(a.times(b), want, atol=1e-6)
    texts = ["one two three", "vier fünf", "", "uno dos"]
    model = lang.LanguageModel([("x", lang.ngrams("one two")), ("y", lang.ngrams("uno dos"))])
    whole = model.raw(texts)
    monkeypatch.setattr(lang, "GATHER", 3)
    assert np.allclose(model.raw(texts), whole)


def test_many_languages_keep_the_samples_bounded():
    r = np.random.default_rng(3)
    samples = [(f"l{k}", np.unique(r.integers(0, lang.BUCKETS, 20))) for k in range(600) for _ in range(4)]
    model = lang.LanguageModel(samples)
    assert len(model.languages) == 600 and model.weights.shape == (lang.BUCKETS, 600)


def test_language_repeats_and_names_of_results(spark):
    rows = [(k, t, name, 7, "q") for k, (t, name) in enumerate([("rot blau gelb", "a"), ("one two three", "b")] * 12)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, score int, lang_pred string")
    got = lang.identify(docs, lang.learn_languages(docs)).collect()
    assert len(got) == 27 and all(r.lang_pred == ("b" if r.doc_id % 2 else "a") for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (None, "word", None), (5, "x" * 100_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(docs, lang.learn_languages(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    none = docs.where("false")
    assert lang.identify(none, lang.learn_languages(none)).collect() == []
    assert {r.lang_pred for r in lang.identify(docs, lang.learn_languages(none)).collect()} == {"und"}


def test_quality_held_out_accuracy(spark, sf):
    at = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = quality.learn_quality(docs, labels)
    rows = quality.rate_quality(docs.join(labels.select("doc_id"), "doc_id"), model).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.9 and np.mean([r.predicted for r in bad]) < 0.1
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def mixture(share, n, seed):
    r = np.random.default_rng(seed)
    truth = r.random(n) < share
    return r.normal(1.5, 1, (2000, 3)), np.where(truth[:, None], r.normal(1.5, 1, (n, 3)), r.normal(-1.5, 1, (n, 3))), truth


def test_risk_and_prior_on_known_mixtures():
    for share in (0.3, 0.6, 0.85):
        p, u, truth = mixture(share, 4000, 0)
        teller = quality.fit_teller(p[:1000], u[:2000])
        z, zu = teller(p[1000:]), teller(u[2000:])
        cuts = quality.score_cuts(z)
        prior = quality.class_prior(z, cuts, np.array([(zu >= c).sum() for c in cuts]), len(zu))
        assert abs(prior - share) < 0.08
        net = quality.fit_risk(p, u, prior)
        assert ((net(u) > 0) == truth).mean() > 0.93


def test_steps_descend_the_non_negative_risk():
    """The slopes of fit_risk are those of the risk itself, by finite differences, on both sides of zero."""
    p, u, _ = mixture(0.5, 400, 1)
    net = quality.Network(3)

    def risk(prior, w):
        old, net.p[2] = net.p[2], w
        sp, su = quality.sigmoid(net(p)), quality.sigmoid(net(u))
        net.p[2] = old
        rest = su.mean() - prior * sp.mean()
        return (prior * (1 - sp).mean() + rest) if rest >= 0 else -rest

    for prior in (0.4, 1.0):
        sp, su = quality.sigmoid(net(p)), quality.sigmoid(net(u))
        bend_p, bend_u = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        slope = np.concatenate([-2 * prior * bend_p, bend_u]) if su.mean() - prior * sp.mean() >= 0 else np.concatenate([prior * bend_p, -bend_u])
        hidden = np.maximum(np.vstack([p, u]) @ net.p[0] + net.p[1], 0)
        for k in range(3):
            step = np.zeros(quality.HIDDEN)
            step[k] = 1e-5
            assert abs((risk(prior, net.p[2] + step) - risk(prior, net.p[2] - step)) / 2e-5 - (hidden.T @ slope)[k]) < 1e-6


def test_prior_counts_all_rows(spark):
    r = np.random.default_rng(5)
    texts = [" ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(20)) if k % 3 else "#$% 123 " * 20 for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    model = quality.QualityModel(np.array([quality.describe(t) for t in texts[:50]]), np.array([quality.describe(t) for t in texts]))
    teller = quality.Network(quality.WIDTH)
    z = teller(model.scaled(np.array([quality.describe(t) for t in texts])))
    cuts = np.quantile(z, [0.1, 0.5, 0.9]) - 1e-9
    above, n = quality.count_above(docs, model, teller, cuts)
    assert n == 600 and above.tolist() == [(z >= c).sum() for c in cuts]


def test_negative_labels_are_not_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = quality.rate_quality(docs, quality.learn_quality(docs, labels)).orderBy("doc_id").collect()
    b = quality.rate_quality(docs, quality.learn_quality(docs, labels.where("quality = 1"))).orderBy("doc_id").collect()
    assert a == b


def test_quality_repeats_long_text_and_names_of_results(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as score", "'q' as predicted"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn_quality(docs, labels)
    odd = docs.limit(1).union(docs.limit(1)).union(spark.createDataFrame([(None, "word " * 400_000, 1, "q")], docs.schema))
    rows = quality.rate_quality(odd, model).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.rate_quality(docs, quality.learn_quality(docs, none)).collect()] == [0, 0, 0]
    assert quality.rate_quality(docs.where("false"), quality.learn_quality(docs.where("false"), none)).collect() == []


def test_repeated_ids_leave_the_collect_bounded(spark, monkeypatch):
    rows = [(1, f"the words of text {k}", "en") for k in range(3000)] + [(k, "les mots du texte", "fr") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(lang, "LanguageModel", lambda samples: seen.append(len(samples)))
    lang.learn_languages(docs, train=10)
    assert seen[0] <= 20
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    kept = []
    monkeypatch.setattr(quality.QualityModel, "fit", lambda self, p, u, prior: kept.append((len(p), len(u))) or self)
    quality.learn_quality(docs, labels, sample=30)
    assert not kept or (kept[0][0] <= 30 and kept[0][1] <= 30)


def plain_features(text):
    """The description of a text by loops over its bytes and words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?!-", "\"'()[]{}", "|", "#*$%&<>=+@^~_/\\`"]
    kind = lambda b: 10 if b >= 128 else next((k for k, c in enumerate(kinds, 1) if chr(b) in c), 0)
    seen = [kind(b) for b in raw]
    out = [0.0] * (11 + 121 + 9)
    if not raw:
        return out
    for k in seen:
        out[k] += 1 / len(seen)
    for a, b in zip(seen, seen[1:]):
        out[11 + 11 * a + b] += 1 / (len(seen) - 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, sizes = max(1, len(words)), [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    pairs = list(zip(words, words[1:]))
    out[132:] = [
        math.log1p(n) / 10, len(set(words)) / n, len(set(pairs)) / n, sum(a == b for a, b in pairs) / n, mean / 10, (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5 / 10,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), sum(s > 20 for s in sizes) / len(sizes),
    ]
    return out


def test_scores_by_plain_loops(spark, sf):
    """Every score again: features, scaling, network and sigmoid written out."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "é" * 500), (-5, "x y " * 900)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    model = quality.learn_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    w, b, v, c = (p.tolist() for p in model.net.p)
    got = {r.doc_id: r for r in quality.rate_quality(every, model).collect()}
    for doc_id, text in [tuple(r) for r in every.collect()]:
        x = [max(-8.0, min(8.0, (f - m) / s)) for f, m, s in zip(plain_features(text), model.mean.tolist(), model.scale.tolist(), strict=True)]
        hidden = [max(0.0, sum(x[i] * w[i][j] for i in range(len(x))) + b[j]) for j in range(len(b))]
        z = sum(h * k for h, k in zip(hidden, v, strict=True)) + c[0]
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, model.steep * z + math.log(0.7 / 0.3)))))
        assert abs(got[doc_id].score - score) < 1e-3 and got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert abs(score - 0.7) < 1e-3 or got[doc_id].predicted == (score >= 0.7)
