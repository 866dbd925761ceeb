"""Secret scans: base patterns, and formats learned from labelled credentials by grammar inference.

Three base patterns (assignments, access keys, hex runs) give spans that always stay. Their values are the labelled
credentials. Values of one format (the same kinds of characters and length, or where few share a length, the same kinds of
characters) are made into a prefix tree: the first HEAD characters as they are, then symbol classes. Its states are merged
where they are statistically compatible (Hoeffding bound on how often a state ends and how often it continues with each symbol,
for all states that a merge implies): first states of the same depth, which gathers enough visits in each, then states of
different depth, which makes loops. The result is a probabilistic automaton for each format. One more is learned from other
long tokens. Every long token of every document is scored: it is a secret (kind `grammar`) if its bits for each symbol under a
format's automaton are no more than a little above what that format's own values need, and fewer by MARGIN than under the
ordinary automaton (so what is common among unlabelled tokens is no secret). Tokens within a base span are covered already; a token that encloses or crosses one is scored as a whole.

Learning takes at most SAMPLE distinct values of a format (those with the least hashes), of at most LONGEST characters, and at most
FORMATS formats of at least LEAST_VALUES values; these bounds hold for learning alone, scanning has none.

Defined cases: null and empty texts have no secrets; too few labelled credentials for a format means no automata and base spans
only; a very long text or token is scanned whole, in time linear in it; repeated rows give one row each; an empty table gives no
rows; extra columns are ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_ready, least_of, map_rows, table

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "grammar")
#: An assignment needs one of these; checked on the lower-cased text, which is cheaper than the pattern.
_WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Distinct values that an automaton is learned from, characters of each at most, formats at most, and fewest values of one.
SAMPLE = 400
LONGEST = 512
FORMATS = 64
LEAST_VALUES = 20
#: Characters at the start of a value that stand for themselves.
HEAD = 4
#: Error of the compatibility test: larger merges less.
ALPHA = 0.05
#: Bits for each symbol by which a credential automaton must beat the ordinary one, and by which a value may need more than
#: the costliest one that the automaton was learned from.
MARGIN = 0.5
SLACK = 0.1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, value), in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


_CLASSES = str.maketrans({c: k for k, chars in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in chars})
_KINDS = str.maketrans({c: k for k, chars in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in chars})


def symbols(value: str) -> list[str]:
    """The first characters marked as themselves, then classes: d digit, h a-f, l g-z, U A-Z, everything else itself."""
    return ["=" + c for c in value[:HEAD]] + list(value[HEAD:].translate(_CLASSES))


def format_of(value: str) -> str:
    """The kinds of characters of a value; hexadecimal letters in one case are a kind unless other letters occur, + and / are one."""
    kinds = set(value.rstrip("=").translate(_KINDS).replace("/", "+"))
    for part, whole in (("h", "l"), ("H", "U")):
        if whole in kinds:
            kinds.discard(part)
    return "".join(sorted(kinds))


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int, str]]:
    """Long tokens that no base span holds, without punctuation at the end."""
    starts = [a for a, *_ in base]
    furthest = list(accumulate((b for _, b, *_ in base), max))
    out = []
    for m in CANDIDATE.finditer(text):
        value = m[0].rstrip(".=-" if m[0][-1] != "=" else ".-")
        if len(value) >= 12:
            a, b = m.start(), m.start() + len(value)
            k = bisect_right(starts, a)
            if not (k and furthest[k - 1] >= b):
                out.append((a, b, value))
    return out


class Automaton:
    """A probabilistic automaton learned from strings of symbols; states hold visits, ends and symbol counts."""

    def __init__(self, strings: Iterable[list[str]], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.visits = [0]
        self.ends = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        depth = [0]
        for s in strings:
            state = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.visits.append(0)
                    self.ends.append(0)
                    depth.append(depth[state] + 1)
                self.count[state][c] = self.count[state].get(c, 0) + 1
                state = self.next[state][c]
                self.visits[state] += 1
            self.ends[state] += 1
        self.up = list(range(len(self.next)))  # the state that each one was merged into
        self._merge_layers(depth)
        self._merge_across(depth)
        self.most = [max(self.count[k], key=lambda c, k=k: (self.count[k][c], c), default=None) for k in range(len(self.next))]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 < n2 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _alike(self, a: int, b: int) -> bool:
        if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
            return False
        return not any(self._differ(self.count[a].get(c, 0), self.visits[a], self.count[b].get(c, 0), self.visits[b]) for c in self.count[a].keys() | self.count[b].keys())

    def _implied(self, a: int, b: int) -> list[tuple[int, int]] | None:
        """All merges that merging a and b implies, if each is of compatible states."""
        todo, done, own = [(a, b)], [], {}

        def top(k: int) -> int:
            k = self.root(k)
            while k in own:
                k = own[k]
            return k

        while todo:
            a, b = (top(k) for k in todo.pop())
            if a == b:
                continue
            if not self._alike(a, b):
                return None
            own[b] = a
            done.append((a, b))
            todo.extend((self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys())
        return done

    def _merge(self, a: int, b: int) -> bool:
        pairs = self._implied(a, b)
        if pairs is None:
            return False
        todo = list(pairs)
        while todo:
            a, b = (self.root(k) for k in todo.pop())
            if a == b:
                continue
            self.up[b] = a
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]
        return True

    def _merge_layers(self, depth: list[int]) -> None:
        """States of the same depth, from the start on; the often visited first."""
        layers: dict[int, list[int]] = {}
        for k, d in enumerate(depth):
            layers.setdefault(d, []).append(k)
        for d in sorted(layers):
            kept: list[int] = []
            for k in sorted({self.root(k) for k in layers[d]}, key=lambda k: (-self.visits[k], k)):
                if self.root(k) == k and not any(self._merge(a, k) for a in kept):
                    kept.append(k)

    def _merge_across(self, depth: list[int]) -> None:
        """States of different depth, each into the first compatible one nearer to the start."""
        states = sorted({self.root(k) for k in range(len(self.up))}, key=lambda k: (depth[k], k))
        for n, k in enumerate(states):
            for a in states[:n]:
                if self.root(k) != k:
                    break
                if self.root(a) == a:
                    self._merge(a, k)

    def states(self) -> int:
        return len({self.root(k) for k in range(len(self.up))})

    def bits(self, s: list[str], limit: float = math.inf) -> float:
        """Minus log2 of the likelihood of s, end included, for each symbol; infinite as soon as it must exceed the limit.

        A symbol never seen in a state costs more than any seen one, and the walk goes on where most strings go.
        """
        state, total, most = 0, 0.0, limit * max(1, len(s))
        for c in s:
            n = self.count[state].get(c, 0)
            if n:
                total += math.log2(self.visits[state] / n)
            else:
                total += math.log2(self.visits[state] + 2) + 3
                c = self.most[state]
            if total > most:
                return math.inf
            if c is not None:
                state = self.root(self.next[state][c])
        n = self.ends[state]
        total += math.log2(self.visits[state] / n) if n else math.log2(self.visits[state] + 2) + 3
        return total / max(1, len(s)) if total <= most else math.inf


def formats_of(values: Iterable[str], least: int = LEAST_VALUES) -> dict[str, list[str]]:
    """Values by format: kinds of characters with the length where enough values share it, else kinds alone; rarer ones drop out."""
    values = sorted(set(values))
    exact = Counter((format_of(v), len(v)) for v in values)
    groups: dict[str, list[str]] = {}
    for v in values:
        f = format_of(v)
        groups.setdefault(f"{f}:{len(v)}" if exact[f, len(v)] >= least else f, []).append(v)
    return {f: v for f, v in sorted(groups.items()) if len(v) >= least}


class Formats:
    """An automaton for each format of labelled credentials, what its own values cost at most, and the ordinary automaton."""

    def __init__(self, labelled: Iterable[str], ordinary: Iterable[str], least: int = LEAST_VALUES):
        self.known: dict[str, tuple[Automaton, float]] = {}
        for name, values in formats_of(labelled, least).items():
            automaton = Automaton(map(symbols, values))
            self.known[name] = automaton, max(automaton.bits(symbols(v)) for v in values) + SLACK
        self.ordinary = Automaton(map(symbols, sorted(ordinary)))
        self.list = list(self.known.values())

    def score(self, value: str) -> float:
        """Bits for each symbol in favour of a credential; minus infinite if no format fits."""
        s = symbols(value)
        best = min((a.bits(s, limit) for a, limit in self.list), default=math.inf)
        if best == math.inf:
            return -math.inf
        return self.ordinary.bits(s) - best if self.ordinary.visits[0] else MARGIN

    def spans(self, text: str | None, margin: float = MARGIN) -> list[tuple[int, int, int]]:
        """(start, end, number of the kind) of base and learned secrets, in order."""
        base = base_spans(text or "")
        found = [(a, b, k) for a, b, k, _ in base]
        if not self.known:
            return found
        return sorted(found + [(a, b, 3) for a, b, v in candidates(text or "", base) if self.score(v) >= margin], key=lambda x: (x[0], x[2]))


def learn_formats(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from all documents' base matches and other long tokens; of each format, the sample values with the least hashes."""

    def make():
        def row(text):
            if text:
                base = base_spans(text)
                found = [(f"{format_of(v)}:{len(v)}", v) for *_, v in base] + [("ordinary", v) for *_, v in candidates(text, base)]
                for name, value in found:
                    if len(value) <= LONGEST:
                        yield name, value, int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest())

        return row

    rows = least_of(map_rows(docs, ["text"], make, "format string, value string, h long"), "format", "h", sample)
    labelled: dict[str, list[str]] = {}
    for r in rows:
        labelled.setdefault(r["format"], []).append(r["value"])
    ordinary = labelled.pop("ordinary", [])
    # the formats with the most values of one length, and together those whose lengths differ
    often = sorted(labelled, key=lambda f: (-len(labelled[f]), f))
    chosen = [v for f in often[:FORMATS] for v in labelled[f]]
    rest: dict[str, list[str]] = {}
    for f in often[FORMATS:]:
        rest.setdefault(f.rsplit(":", 1)[0], []).extend(labelled[f])
    return Formats(chosen + [v for values in rest.values() for v in values[:sample]], ordinary)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, formats: Formats, margin: float = MARGIN) -> DataFrame:
    """Counts and spans of every document."""

    def make():
        def row(doc_id, text):
            spans = formats.spans(text, margin)
            base = sorted((x for x in spans if x[2] < 3), key=lambda x: (x[0], x[2]))
            n = [sum(k == kind for *_, k in spans) for kind in range(4)]
            yield doc_id, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]

        return row

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, formats: Formats, mark: str = "[SECRET]", margin: float = MARGIN) -> DataFrame:
    """docs with every secret's span replaced in text, and n_chars to match; one scan, no join."""

    def run(batches):
        for batch in batches:
            texts = [t and redacted(t, formats.spans(t, margin), mark) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, type=batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                kept = zip(batch.column("text").to_pylist(), texts, batch.column("n_chars").to_pylist(), strict=True)
                new["n_chars"] = pa.array([n if a == b else len(b) for a, b, n in kept], type=batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

    return arrow_ready(docs).mapInArrow(run, docs.schema)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, learn_formats(docs))
