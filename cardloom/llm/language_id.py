"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of n-grams (1 to 4 characters, hashed to
2^18 names) that both hold, over the root of the product of their numbers of n-grams. A bounded sample of labelled
texts gives Nystroem landmarks; the landmark kernel's inverse root maps every text to a vector, and kernel ridge
regression, one language against the rest, is solved in that space. All of it is linear in the n-gram presence, so
the map to landmarks and the ridge weights fold into one (n-grams x languages) matrix, and a batch is scored by one product of
its sparse presence matrix (the places of all its texts' n-grams, row after row) with that matrix.

Labels are read only in folds 0, 1 and 3 of crc32(doc_id) mod 4. Training rows are chosen by the hash of their ids:
at most TRAIN for each language, of which LANDMARKS are landmarks; with many languages fewer, so that all together are at most
MOST_TRAIN and MOST_LANDMARKS.

Defined cases: null text or text without letters is `und` with score 0; with no labels everything is `und`; a very long text is
scored whole; several labels of one id are several training rows; repeated rows give one row each; an empty table gives no rows;
extra columns are ignored, also those with the names of results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, fold, held_out, least_of, map_rows, table

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 18
TRAIN = 400
LANDMARKS = 60
#: All languages together.
MOST_TRAIN = 8000
MOST_LANDMARKS = 1000
RIDGE = 1e-2
#: Numbers that one dense block of presence rows holds while fitting, n-grams that one product gathers while scoring.
DENSE = 1 << 23
GATHER = 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str) -> np.ndarray:
    """Distinct n-gram names of the lower-cased text, white space made one blank."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    present = np.zeros(BUCKETS, dtype=bool)
    rolled = np.zeros(len(points), dtype=np.uint64)
    for n in SIZES:
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * _MIX + points[n - 1 :] + np.uint64(n)
        name = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        present[(name >> np.uint64(46)).astype(np.int64)] = True
    return np.flatnonzero(present)


class Presence:
    """A sparse presence matrix: the n-gram places of all rows one after another, each row scaled to length one."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(g) for g in rows], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.scale = np.maximum(self.sizes, 1) ** -0.5

    def __matmul__(self, matrix: np.ndarray) -> np.ndarray:
        """The product with a dense (n-grams x k) matrix."""
        out = np.zeros((len(self.sizes), matrix.shape[1]))
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[full] = np.add.reduceat(matrix[self.places], self.starts[full], axis=0)
        return out * self.scale[:, None]

    def times(self, other: Presence) -> np.ndarray:
        """The product with another's transpose, a block of n-grams at a time, so that no dense matrix of all n-grams is held."""
        width = max(64, DENSE // max(1, len(self.sizes), len(other.sizes)))
        out = np.zeros((len(self.sizes), len(other.sizes)))
        used = np.intersect1d(self.places, other.places)
        for at in range(0, len(used), width):
            part = used[at : at + width]
            out += self._dense(part) @ other._dense(part).T
        return out

    def _dense(self, columns: np.ndarray) -> np.ndarray:
        place = np.full(BUCKETS, -1, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        at = place[self.places]
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        out = np.zeros((len(self.sizes), len(columns)), dtype=np.float32)
        out[row[at >= 0], at[at >= 0]] = 1
        return out * self.scale[:, None].astype(np.float32)

    def spread(self, coefficients: np.ndarray) -> np.ndarray:
        """Transpose times a dense (rows x k) matrix: (n-grams x k)."""
        out = np.zeros((BUCKETS, coefficients.shape[1]))
        for k in range(coefficients.shape[1]):
            out[:, k] = np.bincount(self.places, weights=np.repeat(coefficients[:, k] * self.scale, self.sizes), minlength=BUCKETS)
        return out


class LanguageModel:
    """weights: (n-grams, languages); a text's raw scores are its presence row times weights over root of its n-grams."""

    def __init__(self, samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted({lang for lang, _ in samples})
        if not self.languages:
            return
        most, train = (max(2, n // len(self.languages)) for n in (MOST_LANDMARKS, MOST_TRAIN))
        taken: dict[str, int] = {}
        kept, picked = [], []
        for lang, grams in samples:
            n = taken[lang] = taken.get(lang, 0) + 1
            if n <= min(landmarks, most):
                picked.append(grams)
            if n <= train:
                kept.append((lang, grams))
        marks, rows = Presence(picked), Presence([g for _, g in kept])
        values, vectors = np.linalg.eigh(marks.times(marks))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # to the Nystroem vectors
        x = np.hstack([rows.times(marks) @ root, np.ones((len(kept), 1))])
        y = np.array([[1.0 if lang == name else -1.0 for name in self.languages] for lang, _ in kept])
        solved = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
        self.weights = marks.spread(root @ solved[:-1]).astype(np.float32)
        self.offset = solved[-1]

    def raw(self, texts: list[str]) -> np.ndarray:
        """(texts x languages) ridge outputs; a product for every GATHER n-grams."""
        out, waiting, n = [], [], 0
        for k, text in enumerate(texts):
            waiting.append(ngrams(text))
            n += len(waiting[-1])
            if n >= GATHER or k == len(texts) - 1:
                out.append(Presence(waiting) @ self.weights + self.offset)
                waiting, n = [], 0
        return np.vstack(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: the softmax of the doubled margins."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if known:
            raw = self.raw([texts[k] for k in known])
            p = np.exp(2 * (raw - raw.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for k, at, row in zip(known, raw.argmax(axis=1).tolist(), p, strict=True):
                lang[k], score[k] = self.languages[at], float(row[at])
        return lang, score


def learn_languages(docs: DataFrame, train: int = TRAIN) -> LanguageModel:
    """A model from the labelled documents outside the held-out fold."""
    ids = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    least = [(r["doc_id"], r["lang"]) for r in least_of(ids, "lang", "h", train)]
    chosen = docs.sparkSession.createDataFrame(least, docs.select("doc_id", "lang").schema)

    def make():
        def row(doc_id, lang, h, text):
            yield lang, h, ngrams(text).astype("<u4").tobytes()

        return row

    # the join carries no texts but theirs; of rows that repeat an id one is kept, so at most train rows of each language come back
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    rows = map_rows(texts, ["doc_id", "lang", "h", "text"], make, "lang string, h long, grams binary").groupBy("lang", "h").agg(F.min("grams").alias("grams")).collect()
    samples = sorted(((r.h, r.lang, r.grams) for r in rows))
    return LanguageModel([(lang, np.frombuffer(g, "<u4").astype(np.int64)) for _, lang, g in samples])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: n-grams x languages

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return arrow_ready(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_languages(docs))
