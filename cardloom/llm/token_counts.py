"""Token counts by linear longest-match word pieces, without building the pieces.

The vocabulary is a trie. Every node has a failure link: the node reached after the tokens that the longest-match
rule would by then have emitted are popped off its front, and the number of those popped tokens is precomputed. A
word is walked once; where a node has no edge for the next symbol, the popped count is added and the link followed. So
a word costs time in proportion to its length however the vocabulary looks, and only a number comes out.

The vocabulary is a public one whose pieces are used with or without their word-end mark alike (a longest match that had
to close every word with the mark would leave most words without a spelling); its base symbols are the 256 bytes,
written as printable characters, so every text has a count. Words are lower-cased runs of letters, single digits,
and runs of other visible characters, as the vocabulary's own splitting does it.

Defined cases: null and empty texts have no words and no tokens; a word that the vocabulary cannot spell counts as
one token; a very long text or word is counted whole, in time linear in it; repeated rows give one row each; an empty table
gives no rows; extra columns are ignored, also those with the names of results.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

END = "</w>"
#: Distinct words whose counts a task keeps before it starts anew, and characters of a word that is kept at most.
MEMO = 500_000
MEMO_CHARS = 64
#: Runs of letters, single digits, runs of anything else that is visible.
SPLIT = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class LongestMatch:
    """Trie nodes with edges, failure links and popped-token counts.

    prefix: what marks the pieces that continue a word; these have a root of their own. Without one, every piece may
    stand anywhere.
    """

    def __init__(self, vocabulary: Iterable[str], prefix: str = ""):
        self.rest = 1 if prefix else 0  # where a word goes on after a token
        self.edges: list[dict[str, int]] = [{} for _ in range(self.rest + 1)]
        token = [False] * len(self.edges)
        for piece in vocabulary:
            follows = prefix and piece.startswith(prefix)
            node = self.rest if follows else 0
            for c in piece[len(prefix) :] if follows else piece:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    token.append(False)
                node = self.edges[node][c]
            token[node] = node > self.rest
        self.link: list[int] = [-1] * len(self.edges)
        self.popped: list[int] = [0] * len(self.edges)
        todo = deque((root, c, t) for root in range(self.rest + 1) for c, t in self.edges[root].items())
        while todo:  # breadth first, so a parent's link is known before its children's
            parent, c, node = todo.popleft()
            if token[node]:
                self.link[node], self.popped[node] = self.rest, 1
            elif parent > self.rest:
                at, n = self.link[parent], self.popped[parent]
                while at != -1 and c not in self.edges[at]:
                    n += self.popped[at]
                    at = self.link[at]
                if at != -1:
                    self.link[node], self.popped[node] = self.edges[at][c], n
            todo.extend((node, x, t) for x, t in self.edges[node].items())

    def count(self, word: str) -> int:
        """Tokens of the word's greedy longest match; 1 if it cannot be spelled."""
        node, n = 0, 0
        edges, link, popped = self.edges, self.link, self.popped
        for c in word:
            while c not in edges[node]:
                if link[node] == -1:
                    return 1
                n += popped[node]
                node = link[node]
            node = edges[node][c]
        while node > self.rest:
            if link[node] == -1:
                return 1
            n += popped[node]
            node = link[node]
        return n


class WordCounts(dict):
    """Token counts of words, worked out when first asked for."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.match = LongestMatch({v.removesuffix(END) for v in vocabulary})
        self.symbols = byte_symbols()

    def __missing__(self, word: str) -> int:
        n = self.match.count("".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
        if len(word) <= MEMO_CHARS:
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def word_counts(path: str | None) -> WordCounts:
    return WordCounts(path)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""

    def make():
        import regex

        split, counts = regex.compile(SPLIT), word_counts(path)

        def row(doc_id, text):
            if len(counts) > MEMO:
                counts.clear()
            words = split.findall(text.lower()) if text else []
            yield doc_id, len(words), sum(map(counts.__getitem__, words))

        return row

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
