"""Quality rules: plain counts of words, symbols and repetition, and tokeniser fertility.

Fertility: a public piece vocabulary with byte fallback encodes every word; a text is judged by its characters per
token, the share of byte-fallback tokens, and the entropy of its tokens, and by two of them together. Rejection bands hold for each script (the
one with most letters; Latin with many letters beyond ASCII is "accented", "other" has no bands of its own, "none" is
without letters). The text is encoded as its words joined by single spaces.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; a very long text is counted and
encoded whole; repeated rows give one row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_ready, map_rows, table

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Tokens beyond which a text's entropy is not expected to grow.
SATURATION = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Share of letters beyond ASCII from which a Latin text counts as `accented` (Vietnamese and the like).
ACCENTED = 0.12
#: Rejection bands for each script: least and most characters per token, most byte-fallback share, least
#: entropy in bits as a share of the most that so many tokens of the vocabulary could have.
#: Placed outside what program messages of 110 languages (GNU translations, in texts of 900 characters) show at the outer half
#: percent, and as far into what junk of the same letters shows as that allows; figures in the README.
BANDS = {
    "latin": (1.3, 6.5, 0.15, 0.59),
    "accented": (1.05, 4.0, 0.20, 0.60),
    "greek": (0.84, 2.5, 0.05, 0.455),
    "cyrillic": (1.25, 3.5, 0.15, 0.60),
    "arabic": (0.65, 2.0, 0.30, 0.42),
    "hebrew": (0.70, 2.0, 0.25, 0.45),
    "indic": (0.30, 2.0, 0.96, 0.33),
    "cjk": (0.65, 2.0, 0.40, 0.55),
    "other": (0.24, 6.5, 0.95, 0.31),
    "none": (1.3, 6.5, 0.15, 0.59),
}

#: Joint bands: a text of JOINT_TOKENS or more whose characters per token are no more than the first number fails if its entropy share reaches the second.
#: Prose is cut into single letters only where it repeats itself; random letters are cut so and spread evenly. Set on junk of the
#: script and on one half of the languages; figures for the other half in the README. Greek, Hebrew, Cyrillic and cjk have none: there
#: prose reaches the junk's entropy, or the bands above tell them apart.
JOINT_TOKENS = 256
JOINT = {"latin": (1.7, 0.805), "accented": (1.16, 0.712), "arabic": (0.83, 0.506), "indic": (0.55, 0.456)}

#: Lead bytes of UTF-8 that belong to letters of a script (fixed by the encoding).
_LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew": [0xD7],
    "arabic": [0xD8, 0xD9, 0xDA, 0xDB],
    "indic": [0xE0],
    "cjk": [*range(0xE3, 0xEE)],
    "other": [*range(0xCA, 0xCE), *range(0xD4, 0xD7), *range(0xDC, 0xE0), 0xE1, 0xEE],
}


class Pieces:
    """A sentence-piece vocabulary with byte fallback."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.size)])

    def fertility(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, entropy as a share of the most possible.

        Words recur in natural text, so the entropy of a long text is held against SATURATION tokens.
        """
        tokens = np.asarray(self.model.encode(b" ".join(words).decode("utf-8", "replace")), dtype=np.int64)
        n = len(tokens)
        if n < 2:
            return n, float(chars), 0.0, 1.0
        counts = np.bincount(tokens, minlength=self.size)
        p = counts[counts > 0] / n
        entropy = float(-(p * np.log2(p)).sum())
        return n, chars / n, float(counts[self.is_byte].sum()) / n, entropy / math.log2(min(n, SATURATION))


@functools.lru_cache(maxsize=2)
def pieces(path: str | None) -> Pieces:
    return Pieces(path)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included.

    Windows are found by a rolling hash; where hashes are equal, the words themselves are compared.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    names = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        rolled = rolled * _MIX + names[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    hit: set[int] = set()
    for k in np.flatnonzero(same).tolist():
        a, b = int(order[k]), int(order[k + 1])
        if words[a : a + window] == words[b : b + window]:
            hit.update((a, b))
    starts = np.fromiter(hit, dtype=np.int64, count=len(hit))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def script_of(raw: bytes) -> str:
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256)
    found = {name: int(counts[leads].sum()) for name, leads in _LEADS.items()}
    most = max(found, key=found.get)
    if not found[most]:
        return "none"
    return "accented" if most == "latin" and counts[0xC3:0xCA].sum() + counts[0xE1] >= ACCENTED * found[most] else most


def in_bands(script: str, n_tokens: int, per_token: float, byte_share: float, entropy: float, bands: dict) -> bool:
    low, high, most_bytes, least_entropy = bands[script]
    dense, even = JOINT.get(script, (0.0, 1.0))
    scattered = n_tokens >= JOINT_TOKENS and per_token <= dense and entropy >= even
    return low <= per_token <= high and byte_share <= most_bytes and entropy >= least_entropy and not scattered


class Rater:
    """The measures of one text; used alike for reports and for filtering."""

    def __init__(self, path: str | None = None, bands: dict = BANDS):
        self.coder, self.bands = pieces(path), bands

    def base(self, raw: bytes) -> tuple[list[bytes], int, bool]:
        """Words, words in repeated windows, and whether the base rules fail."""
        words = raw.split()
        repeat = repeated_words(words)
        return words, repeat, len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)

    def fertility(self, raw: bytes, words: list[bytes], chars: int) -> tuple[str, int, float, float, float, bool]:
        """Script, tokens, the three measures, and whether they are in the script's bands."""
        script = script_of(raw)
        n, *measures = self.coder.fertility(words, chars)
        return script, n, *measures, in_bands(script, n, *measures, self.bands)

    def keeps(self, text: str | None) -> bool:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words, _, failed = self.base(raw)
        return not failed and self.fertility(raw, words, word_chars(text))[-1]


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def rate(docs: DataFrame, path: str | None = None, bands: dict = BANDS) -> DataFrame:
    """Counts, fertility and verdict for every document."""

    def make():
        rater = Rater(path, bands)

        def row(doc_id, text):
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            words, repeat, failed = rater.base(raw)
            chars = word_chars(text)
            *measures, good = rater.fertility(raw, words, chars)
            yield doc_id, len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeat, failed, not failed and good, *measures

        return row

    return map_rows(
        docs, ["doc_id", "text"], make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
        " kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy_share double",
    )


def keep_good(docs: DataFrame, path: str | None = None, bands: dict = BANDS) -> DataFrame:
    """The documents that pass, with all their columns, in one scan without a join; texts that fail the base rules are not encoded.

    Nulls and empty texts go, repeated rows are judged alike, an empty table stays empty.
    """

    def run(batches):
        rater = Rater(path, bands)
        for batch in batches:
            yield batch.filter(pa.array([rater.keeps(t) for t in batch.column("text").to_pylist()], type=pa.bool_()))

    return arrow_ready(docs).mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"))
