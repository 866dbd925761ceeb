import html
import re

from cardloom.llm import html_extraction as h


def page(body):
    return f"<!DOCTYPE html><html><head><title>No &amp;</title><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_blocks_entities_and_white_space():
    got = h.read(page("<nav><ul><li>Menu</li></ul></nav><article><h1>A &amp; B</h1><p><b>one\n  two<br>three<p>fo<i>ur</i> &lt;x&gt; &#233;&nbsp;z</article><footer>&copy; f</footer>"))
    assert got == "A & B\none two three\nfour <x> é z"


def test_never_main_text():
    junk = '<header>H</header><aside>S</aside><div class="ad">A</div><div id="cookie-notice">C</div><form>F</form><style>p{}</style><!-- <p>x</p> -->'
    inside = '<section class="comments"><p>first!</p></section><div class="share-bar">tweet</div><footer>by</footer>'
    assert h.read(page(f"{junk}<main><p>M</p><article><p>Body text</p>{inside}</article></main>{junk}")) == "Body text"
    assert h.read(page(f"{junk}<p>plain</p><div>page<p>more</div>")) == "plain\npage\nmore"
    assert h.read(page(f"{junk}<main><p>M</p></main><p>other</p>")) == "M"


def test_broken_pages():
    assert h.read("") == "" and h.read("<article><p>a &am") == "a &am" and h.read("<article><p>a<foot") == "a"
    assert h.read("<article><p>a<!-- open") == "a" and h.read("</p></div>x <3 y") == "x <3 y"
    assert h.read("<article>" + "<div>" * 2000 + "deep") == "deep"


def test_template_removed_for_its_host_only(spark):
    share = "<div><span>Read more on our site</span></div>"
    rows = [(k, f"http://a.example/{k}", page(f"<div>Site line</div><article><p>quoted everywhere</p><p>own {k}</p>{share}</article>")) for k in range(30)]
    rows += [(100 + k, f"https://u@b.example:80/{k}", page(f"<div>Site line</div><p>words {k}</p>")) for k in range(30)]
    rows += [(200, "http://c.example/", page("<div>Site line</div><p>x</p>")), (201, None, page("<p>n</p>")), (202, "http://a.example/z", None), (None, "bad url", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    keys = h.template_keys(pages)
    for limit in (10**6, 1):
        got = {r.page_id: r.text for r in h.extract(pages, keys, limit).collect()}
        assert len(got) == len(rows)
        assert got[3] == "quoted everywhere\nown 3" and got[105] == "words 5"
        assert got[200] == "Site line\nx" and got[201] == "n" and got[202] == "" and got[None] == ""


def test_text_of_articles_is_no_template(spark):
    quoted = "<ul><li>first of the list</li><li>second</li></ul><table><tr><td>cell</td></tr></table><section><p>wrapped words</p></section>"
    foot = "<div>Chrome line</div>"
    body = "<div>a whole body in one element</div>"
    halves = "<div>one third of it</div><div>another third</div><div>the last third</div>"
    bodies = [(f"http://a.example/{k}", f"<article><p>own {k}</p>{quoted}</article>{foot}") for k in range(30)]
    bodies += [(f"http://b.example/{k}", f"<div><article>{body}</article></div>{foot}") for k in range(30)]  # copies of one page
    bodies += [(f"http://c.example/{k}", f"<article>{halves}<div>{k}</div></article>{foot}") for k in range(30)]  # near copies
    bodies += [(f"http://d.example/{k}", f"<p>no article here</p>{foot}") for k in range(30)]
    pages = spark.createDataFrame([(k, u, page(b)) for k, (u, b) in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(pages, h.template_keys(pages)).collect()}
    assert got[3] == "own 3\nfirst of the list\nsecond\ncell\nwrapped words"
    assert got[33] == "a whole body in one element"
    assert got[63] == "one third of it\nanother third\nthe last third\n3"
    assert got[93] == "no article here\nChrome line"  # copies of one page show no template


def test_ids_inside_articles_are_anchors():
    assert h.read(page('<article><h2 id="related-work">R</h2><section id="cookies"><p>C</p></section><div class="related">x</div></article>')) == "R\nC"


def test_template_of_a_large_host(spark):
    rows = [(k, f"http://a.example/{k}", page(f"<p>words {k}</p>" + ("<div>Rare chrome</div>" if k % 20 == 0 else ""))) for k in range(5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(pages, h.template_keys(pages)).collect()}
    assert got[40] == "words 40"  # on 250 of 5000 pages


def test_recurrence_removes_what_no_list_names(spark):
    """Chrome without a telling tag, class or id goes because it recurs; without the template it would stay."""
    chrome = '<div class="x1"><ul><li>Shop</li><li>About us</li></ul></div>'
    rows = [(k, f"http://a.example/{k}", page(f"<div><p>words of page {k}</p></div>{chrome if k % 5 == 0 else ''}")) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    keys = h.template_keys(pages)
    with_, without = ({r.page_id: r.text for r in h.extract(pages, k).collect()} for k in (keys, keys.where("false")))
    assert without[5] == "words of page 5\nShop\nAbout us" and with_[5] == "words of page 5"
    assert with_[6] == without[6] == "words of page 6"


def test_marked_chrome_recurs_too(spark):
    menu = '<nav><ul><li>Shop</li></ul></nav><div class="ad">Buy</div>'
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", page(f"{menu}<p>words {k}</p>")) for k in range(40)], "page_id long, url string, html string")
    assert h.template_keys(pages).count() >= 3


def test_quotations_need_a_share_of_the_host(spark):
    rows = [(k, f"http://a.example/{k}", page(f"<p>words of page {k}</p>" + ("<p>A saying.</p>" if k < 20 else ""))) for k in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in h.extract(pages, h.template_keys(pages)).where("page_id = 3").collect()} == {"words of page 3\nA saying."}


def test_articles_are_not_lost():
    assert h.read(page('<div class="wrap has-sidebar"><article><p>A</p></article></div><div class="sidebar"><p>S</p></div>')) == "A"
    assert h.read(page('<form action="x"><p>The whole page is in a form.</p><input></form><form><p>Find</p></form>')) == "The whole page is in a form."
    assert h.read(page('<article class="post no-comments"><p>A</p></article><article class="comment"><p>C</p></article>')) == "A"
    assert h.read(page('<article><section id="search-results"><p>A</p></section><p class="notice">B</p></article>')) == "A\nB"
    assert h.read(page("<p title=it's>Hello<p title='a>b'>you</p>")) == "Hello\nyou"
    assert h.read(page("<article><p>Teaser</p></article><div><p>The long text of the page stands outside.</p></div>")) == "Teaser\nThe long text of the page stands outside."
    assert h.read(page('<div class="widget"><article><p>A</p></article></div><div class="site-footer"><p>F</p></div>')) == "A"
    assert h.read(page('<div id="comments"><article class="comment-body"><p>first!</p></article></div><p>text</p>')) == "text"


def test_names_that_only_begin_or_end_like_chrome():
    first = "<p>The first paragraph of the article is longer than all that follows after it in the page.</p>"
    for kind in ("section", "div"):
        for name in ("related-work", "ad-hoc-queries", "social-history", "menu-planning", "related", "notice"):
            assert h.read(page(f'<article>{first}<{kind} class="{name}"><p>Own prose.</p></{kind}></article>')).endswith("\nOwn prose."), name
        for name in ("ad", "ad-slot", "sidebar-left", "cookie-banner", "site-footer", "newsletter"):
            assert "Own" not in h.read(page(f'<article>{first}<{kind} class="{name}"><p>Own prose.</p></{kind}></article>')), name
    assert h.read(page(f'{first}<div class="search-methods"><p>Own prose.</p></div>')).endswith("Own prose.")
    assert "Own" not in h.read(page(f'<article>{first}<div class="share-buttons">Own</div></article>'))


def test_templates_do_the_work_of_the_lists(spark, monkeypatch):
    """A host whose chrome no list names: the template removes it, and without any list the texts are the same."""
    top = '<div class="x1"><ul><li>Shop</li><li>About us</li></ul></div><div class="x2">Call now</div>'
    end = '<div class="x3"><div><p>All rights reserved.</p></div></div>'
    inside = '<section class="x4"><b>Read this next</b></section>'
    rows = [(k, f"http://a.example/{k}", page(f"{top}<article><h1>Page {k}</h1><p>words of page {k}, quite a few of them</p>{inside}</article>{end}")) for k in range(60)]
    rows += [(k, f"http://b.example/{k}", page(f"{top}<div><p>words of page {k}, quite a few of them</p></div>{end}")) for k in range(60, 120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    want = {k: (f"Page {k}\n" if k < 60 else "") + f"words of page {k}, quite a few of them" for k in range(120)}
    assert {r.page_id: r.text for r in h.extract(pages, h.template_keys(pages)).collect()} == want
    by_lists = {r.page_id: r.text for r in h.extract(pages, h.template_keys(pages).where("false")).collect()}
    assert all("Read this next" in by_lists[k] for k in range(60)) and all("Shop" in by_lists[k] for k in range(60, 120))
    plain = [h.read(html, subtrees=None) for _, _, html in rows]
    for name in ("SELDOM", "MARKS", "COMMENTS"):
        monkeypatch.setattr(h, name, frozenset())
    monkeypatch.setattr(h, "NEVER", h.RAW)
    assert [h.read(html) for _, _, html in rows] == plain  # the lists have no part in these pages


def test_long_and_broken_pages_take_linear_time():
    import time

    n = 1_000_000
    bodies = ["<a x " * (n // 5), "<a href=\"x> y " * (n // 14), "<p>a<b>" * (n // 7), "<b>" * (n // 6) + "<p>" * (n // 6), "<div>" * (n // 10) + "</x>" * (n // 8), "<" * n,
              "<a '" * (n // 4) + ">", "&" * n, "<!--" * (n // 4), "<p " + "a=b " * (n // 4) + ">t", "word " * (n // 5), "<a href='x>" * (n // 11) + '"' + ">" * 5]
    for body in bodies:
        started = time.process_time()
        h.read(f"<article><p>start</p>{body}", subtrees={})
        assert time.process_time() - started < 4, body[:40]


def test_table_against_plain_reading(spark, sf):
    def plain(source):
        body = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1] if body else "")
        texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        return "\n".join(filter(None, texts))

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    rows = h.extract(pages, h.template_keys(pages)).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)
