"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives (label 1) and unlabelled web text with the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
where R_p and R_u are mean sigmoid losses over positives and unlabelled rows. Unlabelled text is all text of the corpus, taken
without its labels; rows with label 0 are never used as such. The class prior is estimated from scores of a first network
trained to tell positives from unlabelled rows on half of both samples: the least ratio, over score thresholds, of the
unlabelled share above to the positive share above, with a confidence slack on both shares. The unlabelled share is counted in a
Spark job over the other half of all the corpus's rows outside the held-out fold. The decision is where the risk puts it, at output 0, which is score CUT.

A text is described by its bytes and pairs of byte classes and by counts of repetition; always the whole text. Labels are
read only in folds 0, 1 and 3 of crc32(doc_id) mod 4, and the networks are fitted on at most SAMPLE positives and SAMPLE unlabelled
rows, chosen by the hash of their ids.

Defined cases: null and empty texts are described by zeros and scored like any other; a very long text is described whole; without
positives every score is 0; several labels of one document count as several rows; repeated rows give one row each; an empty
table gives no rows; extra columns are ignored, also those with the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, fold, held_out, map_rows, saved, table

SAMPLE = 6000
CUT = 0.7
HIDDEN = 24

#: Byte classes: other, lower, upper, digit, blank, line end, sentence marks, quotes and brackets, bars, symbols, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?!-", "\"'()[]{}", "|", "#*$%&<>=+@^~_/\\`"), start=1):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 10
_KINDS = 11
WIDTH = _KINDS * _KINDS + _KINDS + 9


def describe(text: str | None) -> np.ndarray:
    """Shares of byte classes and of their pairs, and measures of length and repetition."""
    out = np.zeros(WIDTH, dtype=np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    n = len(kinds)
    out[:_KINDS] = np.bincount(kinds, minlength=_KINDS) / n
    if n > 1:
        out[_KINDS : _KINDS + _KINDS**2] = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_KINDS**2) / (n - 1)
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[_KINDS + _KINDS**2 :] = (
        np.log1p(w) / 10, len(set(words)) / w, pairs / w, same / w, sizes.mean() / 10, sizes.std() / 10, len(lines) / w,
        len(set(lines)) / max(1, len(lines)), (sizes > 20).mean(),
    )
    return out


class Network:
    """One hidden layer of rectified units; plain numpy with Adam."""

    def __init__(self, width: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.t = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = 0.003, decay: float = 1e-4) -> None:
        """One step against the sum of slope * output."""
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        back = np.outer(slope, self.p[2]) * (h > 0)
        grads = [x.T @ back + decay * self.p[0], back.sum(axis=0), h.T @ slope + decay * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for p, m, v, g in zip(self.p, self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, batch: int = 256, seed: int = 7) -> Network:
    """Minimises the non-negative unbiased risk with the sigmoid loss."""
    net, r = Network(positive.shape[1], seed), np.random.default_rng(seed)
    for _ in range(rounds):
        p, u = positive[r.integers(0, len(positive), batch)], unlabelled[r.integers(0, len(unlabelled), batch)]
        x = np.vstack([p, u])
        s = sigmoid(net(x))
        sp, su = s[: len(p)], s[len(p) :]
        bend_p, bend_u = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        rest = su.mean() - prior * sp.mean()  # the loss of the label - is s, of + is 1 - s
        if rest >= 0:
            slope = np.concatenate([-2 * prior * bend_p, bend_u])
        else:  # the negative part has gone below zero: climb back
            slope = np.concatenate([prior * bend_p, -bend_u])
        net.step(x, slope)
    return net


def fit_teller(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 800, seed: int = 11) -> Network:
    """A network that tells positives from unlabelled rows by logistic loss."""
    r, net = np.random.default_rng(seed), Network(positive.shape[1], seed)
    y = np.repeat([1.0, 0.0], 256)
    for _ in range(rounds):
        x = np.vstack([positive[r.integers(0, len(positive), 256)], unlabelled[r.integers(0, len(unlabelled), 256)]])
        net.step(x, (sigmoid(net(x)) - y) / len(x))
    return net


def score_cuts(positive_scores: np.ndarray) -> np.ndarray:
    return np.quantile(positive_scores, np.linspace(0, 0.99, 100))


def class_prior(positive_scores: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int, delta: float = 0.1) -> float:
    """Share of positives among n unlabelled rows, of which above[k] score at least cuts[k]; scores of rows that the teller was not fitted on."""
    above_p = 1 - np.searchsorted(np.sort(positive_scores), cuts) / len(positive_scores)
    above_u = above / n
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(positive_scores) ** -0.5 + n**-0.5)
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


class QualityModel:
    """score = sigmoid(steep * output + logit(CUT)); without a network every score is 0."""

    def __init__(self, positive: np.ndarray | None = None, unlabelled: np.ndarray | None = None):
        self.net, self.prior = None, None
        if positive is not None:
            every = np.vstack([positive, unlabelled]).astype(np.float64)
            self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> QualityModel:
        u = self.scaled(unlabelled)
        self.prior, self.net = prior, fit_risk(self.scaled(positive), u, prior)
        self.steep = 2.0 / max(1e-6, float(np.std(self.net(u))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(x))
        return sigmoid(self.steep * self.net(self.scaled(x)) + np.log(CUT / (1 - CUT)))


def count_above(texts: DataFrame, model: QualityModel, teller: Network, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all the texts score at least each cut, and how many there are; a few numbers from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                z = teller(model.scaled(np.array([describe(t) for t in batch.column("text").to_pylist()])))
                bins += np.bincount(np.searchsorted(cuts, z, side="right"), minlength=len(bins))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bins))), pa.array(bins)], names=["bin", "n"])

    found = arrow_ready(texts).select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    bins = np.zeros(len(cuts) + 1, dtype=np.int64)
    for r in found:
        bins[r.bin] = r.n
    return bins[::-1].cumsum()[::-1][1:], int(bins.sum())


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from at most sample positives and unlabelled rows outside the held-out fold; the prior from all such rows."""
    train = docs.where(fold() != 2).select("doc_id", F.xxhash64("doc_id").alias("h"))

    def least(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(sample).select("doc_id", "h", F.lit(kind).alias("kind"))

    trusted = labels.where("quality = 1").select("doc_id").distinct()
    chosen = saved(least(train.join(trusted, "doc_id", "left_semi"), "p").unionByName(least(train, "u")), "chosen")

    def make():
        def row(doc_id, h, kind, text):
            yield kind, h, describe(text).tobytes()

        return row

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most two samples of ids
    described = map_rows(texts, ["doc_id", "h", "kind", "text"], make, "kind string, h long, x binary")
    rows = sorted(tuple(r) for r in described.groupBy("kind", "h").agg(F.min("x").alias("x")).collect())  # one of the rows that repeat an id

    def matrix(kind: str, part: int | None = None) -> np.ndarray:
        return np.array([np.frombuffer(x, np.float32) for k, h, x in rows if k == kind and part in (None, h % 2)]).reshape(-1, WIDTH)

    positive, unlabelled = matrix("p"), matrix("u")
    halves = [matrix(k, part) for k in "pu" for part in (0, 1)]
    if not all(map(len, halves)):
        return QualityModel()
    model = QualityModel(positive, unlabelled)
    teller = fit_teller(model.scaled(halves[0]), model.scaled(halves[2]))
    z = teller(model.scaled(halves[1]))
    cuts = score_cuts(z)
    above, n = count_above(docs.where((fold() != 2) & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)), model, teller, cuts)
    return model.fit(positive, unlabelled, class_prior(z, cuts, above, n))


def rate_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array([describe(t) for t in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return arrow_ready(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
