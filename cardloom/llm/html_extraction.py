"""Main text of web pages, with site template removal.

Every element's subtree is hashed (tag, children's hashes, text). Spark counts on how many pages of a host each subtree occurs
(pages with the same main text count once, so copies of a page do not make a template of it). Subtrees that recur on many of the
host's pages are its template and are deleted with all they hold: menus, notices, footers and other chrome however they are
marked. How many pages that takes grows slowly: MIN_PAGES, or the logarithm of the host's pages. A subtree with prose (paragraphs,
list items and the like) outside of anything marked as chrome may be a quotation, so it takes MIN_SHARE of the host's pages, beyond
LARGE_HOST pages a share that falls with their root. Where a page has an article or main element, its text is guarded: plain text
blocks in it and whatever holds them are no template candidates, so a passage that many articles quote stays; other
subtrees that hold some of it are candidates only if they are less than half of it, and stay if all of them together are not.

What recurrence does not show (hosts with few pages) is left to lists that only add to it: elements that are never main text by tag,
and elements whose class, id or role names chrome. Names are whole tokens, or tokens made of names and of words for places and containers
(`site-footer`, but not `has-sidebar` or `related-work`); within an article they do not count for plain text blocks, ids are anchors, and
names that prose bears too (DOUBTFUL) remove nothing that holds prose. An element that is only suspected
(a form, a marked element, a page header around the article) stays if it holds more than half of the main text. What remains is
the text of the articles, or of the main element, or of the body; where the text outside
is longer than the articles, both: one line for each block.

Template keys are 8 bytes each and broadcast; if a corpus has more than MAX_KEYS of them, hosts are dealt to several
passes, each over its own hosts' pages with their keys.

Defined cases: null html is empty; pages without a host (null url) have no template; an unclosed tag at the end is dropped,
unclosed elements end with the page, a quotation mark that is never closed is part of its value; long and broken pages are read
in linear time; repeated rows count as one page for the template and give one row each; an empty table gives no rows; extra
columns are ignored, also those with the names of results.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, map_rows, saved, table

#: Pages that a template subtree needs at least; share of the host's pages that one with prose needs.
MIN_PAGES = 5
MIN_SHARE = 0.1
#: Pages of a host from which the pages that prose needs grow with the root of the host's pages.
LARGE_HOST = 1000
MAX_KEYS = 2_000_000

#: A tag with its attributes, whose values may be quoted; nothing in it is tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+|=[^\s/>=]*+)*+)>""")
#: The same without regard to quotation marks.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Fixed by HTML: elements without content, elements whose content is no markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks of plain text: inside an article they are no template candidates.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr figcaption caption tbody article main body html".split())
#: Blocks of prose: a subtree that holds one of them inside an article is text too.
PROSE = frozenset("p li blockquote pre dd dt td th".split())
#: Elements that are never main text, and elements that are not unless they hold most of it.
NEVER = frozenset("head nav button select menu dialog svg canvas object audio video map math".split()) | RAW
SELDOM = frozenset("aside footer header form".split())
#: Names that mark menus, notices, adverts and the like, and reader comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer masthead cookie cookies consent notice gdpr popup modal newsletter subscribe share sharing social"
    " related widget toolbar pagination pager complementary contentinfo search skip".split()
)
COMMENTS = frozenset("comment comments disqus respond".split())
#: Marks that sections of prose bear as well: in an article, one of these alone never removes prose, recurrence does.
DOUBTFUL = frozenset("menu notice promo related search share sharing skip social".split())
#: Words that may stand beside a mark in a name: places, containers and their contents.
BESIDE = frozenset(
    "area articles author bar body bottom box button buttons column container content desktop fixed form global group header icons inner item items label left"
    " link links list main media meta mobile news outer overlay page panel posts primary region reply right row secondary section signup site slot sticky"
    " stories thread top unit wrap wrapper".split()
)
#: Elements that an open paragraph ends at.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WHOLE = frozenset(("html", "body", "main", "article"))


class Element:
    __slots__ = ("children", "doubt", "first", "never", "part", "prose", "soft", "tag", "text")

    def __init__(self, tag: str, part: int, first: int, never: bool, soft: int, doubt: bool = False):
        self.tag, self.part, self.first, self.doubt = tag, part, first, doubt  # part: 0 body, 1 main, 2 article
        self.never, self.soft = never, soft  # soft: number of the innermost suspected element around, or -1
        self.children: list[bytes] = []
        self.text: list[str] = []
        self.prose = False


def named(attributes: str, names: frozenset[str], inside: bool = False) -> bool:
    """Whether a token of class, id (not inside an article) or role is a name, or is made of names and of words beside them."""
    for m in NAMES.finditer(attributes):
        if inside and m[1].lower() == "id":
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            if token in names:
                return True
            parts = [p for p in re.split(r"[-_:]+", token) if p]
            if any(p in names for p in parts) and all(p in names or p in BESIDE or p in MARKS for p in parts):
                return True
    return False


def tags(html: str):
    """(start, end, slash, name, attributes) of the tags; name None for what is no element. Linear in the page."""
    at, last, quotes = 0, html.rfind(">"), True
    while (at := html.find("<", at)) >= 0:
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            name = None
        elif after in ("!", "?") or (after == "/" and not html[at + 2 : at + 3].isalpha()):
            end = html.find(">", at)
            end = len(html) if end < 0 else end + 1
            name = None
        elif after.isascii() and after.isalpha() or after == "/":
            if at > last:  # never closed
                yield at, len(html), "", None, ""
                return
            m = TAG.match(html, at) if quotes else None
            if m is None:
                quotes = False  # a quotation mark swallows the page: read on without them
                m = PLAIN_TAG.match(html, at)
            if m is None:
                at += 1
                continue
            end = yield at, m.end(), m[1], m[2].lower(), m[3]
            at = end if end is not None else m.end()
            if end is not None:
                yield at, at, "", None, ""  # the answer to send()
            continue
        else:
            at += 1
            continue
        yield at, end, "", None, ""
        at = end


def read(html: str, template: object = (), subtrees: dict[int, bool] | None = None) -> str:
    """The main text; template: hashes of subtrees to delete; subtrees: gets the template candidates, True with prose."""
    blocks: list[tuple[int, str, bool, int]] = []  # part, text, in an element that is never text, innermost suspected element around
    suspects: list[tuple[int, bool]] = []  # of each suspected element: the one around it, whether only an article in it can save it
    cleared: set[int] = set()  # suspected elements that hold prose and have only a doubtful name
    stack = [Element("", 0, 0, False, -1)]
    is_open: Counter[str] = Counter()
    pending: list[str] = []
    hashing = bool(template) or subtrees is not None
    candidates: list[tuple[int, int, int, bool, bool]] = []  # key, first and last block, prose of an article, prose outside

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                e = stack[-1]
                blocks.append((e.part, text, e.never, e.soft))
            pending.clear()

    def close() -> None:
        e = stack[-1]
        if e.tag in BLOCKS:
            flush()
        stack.pop()
        is_open[e.tag] -= 1
        if e.doubt and (e.prose or e.tag in PROSE):
            cleared.add(e.soft)
        if hashing:
            raw = "\x00".join([e.tag, *e.text]).encode("utf-8", "surrogatepass") + b"".join(e.children)
            name = hashlib.blake2b(raw, digest_size=8).digest()
            stack[-1].children.append(name)
            prose = e.prose or e.tag in PROSE
            if e.tag in BLOCKS and len(blocks) > e.first and (e.part == 0 or e.tag not in TEXT_BLOCKS) and e.tag not in _WHOLE:
                key = int.from_bytes(name, "little", signed=True)
                if subtrees is not None or key in template:
                    candidates.append((key, e.first, len(blocks), e.part > 0 and e.prose, prose and not e.never and e.soft < 0))
        stack[-1].prose |= e.prose or (e.tag in PROSE and len(blocks) > e.first)

    def words(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pending.append(text)
            if hashing and not text.isspace():
                stack[-1].text.append(" ".join(text.split()))

    at = 0
    found = tags(html)
    for start, end, slash, tag, attributes in found:
        words(html[at:start])
        at = end
        if tag is None:
            continue
        if slash:
            if is_open[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag == "br" or tag == "hr":
            pending.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            raw_end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            at = raw_end.end() if raw_end else len(html)
            found.send(at)
            continue
        if tag in BLOCKS:
            flush()
            ends = _ENDS.get(tag)
            if is_open["p"] or (ends and any(is_open[t] for t in ends)):
                for k in range(len(stack) - 1, 0, -1):
                    if not is_open["p"] and not (ends and any(is_open[t] for t in ends)):
                        break
                    t = stack[k].tag
                    if t == "p" or (ends and t in ends):
                        while len(stack) > k:
                            close()
                    elif t in BLOCKS and not (ends and t == "p"):
                        break
        up = stack[-1]
        comment = tag not in ("html", "body", "main") and bool(attributes) and named(attributes, COMMENTS, up.part == 2)
        part = max(up.part, 0 if comment else 2 if tag == "article" else 1 if tag == "main" else 0)
        by_tag = tag in SELDOM and not (tag == "header" and up.part)
        by_name = not by_tag and bool(attributes) and tag not in _WHOLE and not (up.part == 2 and tag in TEXT_BLOCKS) and named(attributes, MARKS, up.part == 2)
        doubt = by_name and up.part == 2 and not named(attributes, MARKS - DOUBTFUL, True)
        suspect = by_tag or by_name
        soft = up.soft
        if suspect:
            suspects.append((soft, tag in ("aside", "footer", "header")))
            soft = len(suspects) - 1
        stack.append(Element(tag, part, len(blocks), up.never or comment or tag in NEVER, soft, doubt))
        is_open[tag] += 1
    words(html[at:])
    while len(stack) > 1:
        close()
    flush()
    return "\n".join(_main_text(blocks, suspects, cleared, candidates, template, subtrees))


def _main_text(blocks: list[tuple], suspects: list[tuple[int, bool]], cleared: set[int], candidates: list[tuple], template: object, subtrees: dict[int, bool] | None) -> list[str]:
    best = max((p for p, _, never, _ in blocks if not never), default=0)
    size = [len(t) if p == best and not never else 0 for p, t, never, _ in blocks]  # of what may be main text
    total = sum(size)
    held = [0] * (len(suspects) + 1)  # the last one: outside of all
    for (_, _, _, k), n in zip(blocks, size, strict=True):
        held[k] += n
    for k in range(len(suspects) - 1, -1, -1):  # inner ones come after those around them
        held[suspects[k][0]] += held[k] if suspects[k][0] >= 0 else 0
    out = [False] * (len(suspects) + 1)
    for k, (around, needs_article) in enumerate(suspects):
        out[k] = (k not in cleared and 2 * held[k] <= total) or (needs_article and not best) or out[around]
    kept = [not never and not out[k] for _, _, never, k in blocks]
    if candidates:
        # within an article or main element, only what is small next to it
        ends = [0, *accumulate(len(t) if best and p == best and k else 0 for (p, t, *_), k in zip(blocks, kept, strict=True))]
        fit = [(key, a, b, own, prose) for key, a, b, own, prose in candidates if ends[b] == ends[a] or (not own and 2 * (ends[b] - ends[a]) < ends[-1])]
        if subtrees is not None:
            for key, _, _, _, prose in fit:
                subtrees[key] = subtrees.get(key, False) or prose
        here = [x for x in fit if x[0] in template]
        gone = {k for _, a, b, *_ in here for k in range(a, b)}
        if gone and 2 * sum(ends[k + 1] - ends[k] for k in gone) >= ends[-1] > 0:
            gone = {k for _, a, b, *_ in here if ends[b] == ends[a] for k in range(a, b)}
        kept = [k and j not in gone for j, k in enumerate(kept)]
    left = [(p, t) for (p, t, *_), k in zip(blocks, kept, strict=True) if k]
    best = max((p for p, _ in left), default=0)
    inside = sum(len(t) for p, t in left if p == best)
    if best == 2 and sum(len(t) for _, t in left) - inside > inside:
        best = int(any(p == 1 for p, _ in left))  # a teaser beside the text
    return [t for p, t in left if p >= best]


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, subtree of the recurring subtrees of each host; pages with the same main text count once."""

    def make():
        def row(host, html):
            found: dict[int, bool] = {}
            text = read(html, subtrees=found)
            main = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            yield host, None, main, False
            for key, prose in found.items():
                yield host, key, main, prose

        return row

    hosted = pages.select(host_of().alias("host"), "html").where("host <> '' and html is not null")
    found = map_rows(hosted, ["host", "html"], make, "host string, subtree long, main long, prose boolean").distinct()
    counts = saved(
        found.groupBy("host", "subtree").agg(F.countDistinct("main").alias("n"), F.max("prose").alias("prose")).where(F.col("subtree").isNull() | (F.col("n") >= min_pages)), "subtrees"
    )
    totals = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    need = F.greatest(
        F.lit(float(min_pages)), F.when(F.col("prose"), min_share * F.least(F.col("pages").cast("double"), F.sqrt(LARGE_HOST * F.col("pages")))).otherwise(F.log2("pages"))
    )
    return counts.where("subtree is not null").join(totals, "host").where(F.col("n") >= need).select("host", "subtree")


def extract(pages: DataFrame, keys: DataFrame, limit: int = MAX_KEYS) -> DataFrame:
    """page_id, url, text, n_chars of every page; keys: host, subtree, stored."""
    passes = max(1, -(-keys.count() // limit))
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host_of(), F.lit("")).alias("host"))
    out = None
    for k in range(passes):
        own = keys.where(F.pmod(F.xxhash64("host"), F.lit(passes)) == k).select("host", "subtree").toPandas()
        by_host = {h: frozenset(g.tolist()) for h, g in own.groupby("host")["subtree"]}
        shared = pages.sparkSession.sparkContext.broadcast(by_host)  # at most limit keys, by the pass count

        def run(batches, shared=shared):
            for batch in batches:
                hosts, htmls = batch.column("host").to_pylist(), batch.column("html").to_pylist()
                texts = [read(h or "", shared.value.get(host, ())) for host, h in zip(hosts, htmls, strict=True)]
                sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes)], names=["page_id", "url", "text", "n_chars"])

        part = hosted.where(F.pmod(F.xxhash64("host"), F.lit(passes)) == k) if passes > 1 else hosted
        done = arrow_ready(part).select("page_id", "url", "html", "host").mapInArrow(run, "page_id long, url string, text string, n_chars long")
        out = done if out is None else out.unionByName(done)
    return out


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, saved(template_keys(pages), "template"))
