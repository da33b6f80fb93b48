"""Main text of pages and nearest neighbours."""

import numpy as np
import pytest

from mediafold.llm import ann, html_text
from mediafold.sources.tables import load

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, a long notice about cookies that nobody reads, but long it is.</div>
<article><h1>A &amp; B</h1><p><b>First   paragraph&nbsp;with a lot of text that goes on and on.<br><p>Second one, also with
many words in it, so that the ratio is high.</p><p>Hi.</p><ul><li>item one</li><li>item two</li></ul>
<form><input><label>mail</label></form><aside>See also this other thing</aside>
<div id="comments"><p>A reader's long comment that has as many words as the paragraphs of the article.</p></div></article>
<div class="sidebar">links</div><footer>&copy; me</footer></body>"""


def test_article_without_boilerplate():
    assert html_text.main_text(PAGE).split("\n") == [
        "A & B", "First paragraph with a lot of text that goes on and on.",
        "Second one, also with many words in it, so that the ratio is high.", "Hi.", "item one", "item two"]


@pytest.mark.parametrize("html", [None, "", "<p", "<script>x", "<!-- c", "<![bad", "&#x;", "<div></div>", "<nav>a</nav>"])
def test_pages_without_text(html):
    assert html_text.main_text(html) in ("", "&#x;")


def test_plain_body_and_cut_page():
    assert html_text.main_text("<body><p>one</p>two <b>three</b><p>four") == "one\ntwo three\nfour"
    assert html_text.main_text("just text") == "just text"


@pytest.mark.parametrize("mark", ["<![foo]>", "<![ IF x]>", "a[i]<![1]>", "<![endif]-->", "<![CDATA[>", "<![CDATA[x]]>",
                                  "<!--[if !IE]> --><p>kept</p><!-- <![endif]-->", "<!--[if IE]>x<![endif]-->", "<!x>"])
@pytest.mark.parametrize("lead", ["", " ", "\n\ufeff", "before "])
def test_text_behind_marked_sections(mark, lead):
    got = html_text.main_text(f"{lead}{mark}<p>one</p><p>two</p>{mark}<p>three").split("\n")
    assert [x for x in got if x in ("one", "two", "three")] == ["one", "two", "three"]
    assert html_text.main_text(f"{lead}<p>one</p>{mark[:-1]}").split("\n")[-1] != ""


def test_no_markup_stops_the_parser():
    rng = np.random.default_rng(3)
    bits = ["<", "<!", "<![", "<!-", "<!--", "-->", "]>", "]]>", "[", ">", "</", "<p", "<p>", "=", "'", '"', "&#", "&", ";",
            "<?", "/", " ", "a", "IF", "CDATA[", "doctype", "\n", "\x00", "\ufeff"]
    for _ in range(5000):
        html_text.main_text("".join(rng.choice(bits, rng.integers(1, 25))))


LONG = "A sentence of the main text that has many words and goes on for quite a while, without any link in it. " * 3


def test_runs_choose_blocks_of_a_page_without_article():
    links = "".join(f'<li><a href="/{i}">Top {i}</a></li>' for i in range(8))
    html = f"""<body><div class="masthead"><a>The Site</a><p>Since 1999</p></div><ul class="top-links">{links}</ul>
        <div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>{LONG}</p><p>The end</p></div>
        <div class="site-info"><a>Imprint</a><p>Contact</p><p><a>Map</a></p><p>Me</p><p>You</p></div></body>"""
    long = LONG.strip()
    assert html_text.main_text(html).split("\n") == ["Title", long, "Short.", long, long, "The end"]


def test_the_only_article_stays():
    items = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12))
    html = f'<body><article><h1>List</h1><ul>{items}</ul></article><div class="blurb"><p>{LONG}</p><p>{LONG}</p></div></body>'
    assert html_text.main_text(html).split("\n") == ["List", *[f"Item {i}" for i in range(12)]]


@pytest.mark.parametrize("name, never", [
    ("post-comments", True), ("article-comments", True), ("page-footer", True), ("main-nav", True),
    ("content-sidebar", True), ("content-with-sidebar", False), ("no-sidebar", False), ("post-related-text", False)])
def test_names_of_boilerplate(name, never):
    assert html_text.never_content("div", [("class", name)], True) is never


@pytest.mark.parametrize("name", ["article-ad", "post-share", "story-related", "article-newsletter", "page-banner",
                                  "content-widget", "main-promo", "share-post", "ad-body", "masthead"])
def test_boilerplate_beside_words_of_content(name):
    html = f'<body><article><p>{LONG}</p><div class="{name}"><p>Buy this now, it is cheap.</p></div><p>End.</p></article></body>'
    assert html_text.main_text(html).split("\n") == [LONG.strip(), "End."]


@pytest.mark.parametrize("hide", ["hidden", 'hidden="hidden"', 'style="color:red; display: none"', 'style="VISIBILITY:hidden"',
                                  'aria-hidden="true"'])
def test_hidden_elements_go(hide):
    assert html_text.main_text(f"<article><p>one</p><div {hide}><p>two</p></div><p>three</p></article>") == "one\nthree"
    assert html_text.main_text('<article><p style="display:block">one</p></article>') == "one"


def test_a_stray_inline_end_tag_closes_no_block():
    assert html_text.main_text("<span><article><p>one</p></span><p>second</p></article>") == "one\nsecond"
    assert html_text.main_text("<article><b><p>one</b> more</p></article>") == "one more"


def test_ratios_strike_link_blocks_inside_an_article(monkeypatch):
    links = "".join(f'<li><a href="/{i}">Another story {i}</a></li>' for i in range(8))
    html = f"""<body><article><h1>Title</h1><p>{LONG}</p><ul class="x"><li>one</li><li>two</li></ul><p>{LONG}</p>
        <ul class="more">{links}</ul><p>{LONG}</p><p>See <a href="/">this page</a> for it.</p></article></body>"""
    long = LONG.strip()
    assert html_text.main_text(html).split("\n") == ["Title", long, "one", "two", long, long, "See this page for it."]
    only = f"<body><article><ul>{links}</ul></article></body>"
    assert len(html_text.main_text(only).split("\n")) == 8          # an article of links alone stays
    monkeypatch.setattr(html_text, "smooth", lambda r: r * 0 + 1)     # without ratios nothing is under the cut
    assert "Another story 3" in html_text.main_text(html)


def test_smoothing_and_cut_match_loops():
    import math
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40):
        r = rng.exponential(20, n)
        weights = {d: math.exp(-0.5 * d * d) for d in range(-2, 3)}
        total = sum(weights.values())
        want = [sum(w * r[min(max(i + d, 0), n - 1)] for d, w in weights.items()) / total for i in range(n)]
        assert np.allclose(html_text.smooth(r), want)
        lo, hi = min(want), max(want)
        for _ in range(50):
            middle = (lo + hi) / 2
            low, high = [x for x in want if x <= middle], [x for x in want if x > middle]
            if hi - lo < 1e-9 or not high:
                break
            lo, hi = sum(low) / len(low), sum(high) / len(high)
        cut = html_text.threshold(np.array(want))
        assert cut == pytest.approx((lo + hi) / 2) if n > 1 else cut == pytest.approx(want[0])


def test_pages_table(spark):
    pages = load(spark, "/root/testdata/sf0.001", "pages")
    rows = html_text.extract_pages(pages).collect()
    assert len(rows) == pages.count()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "track(" not in r["text"] and html[r["page_id"]].count("<p>") + 1 >= r["text"].count("\n")
    edge = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>x" * 50_000, 3)],
                                 "page_id long, url string, html string, text int")
    got = html_text.extract_pages(edge).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 99_999]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# ----------------------------------------------------------------- search
def brute(ids, x, k, query):
    out = {}
    for i in sorted({int(i) for i in ids if query(int(i))}):
        q = x[list(ids).index(i)]
        s = ann.pair_scores(x, np.broadcast_to(q, x.shape))
        s = np.where(ids == i, -np.inf, s)
        order = [o for o in np.lexsort((ids, -s))[:k] if s[o] > -np.inf]
        out[i] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def test_recall_on_the_given_table(spark):
    rows = load(spark, "/root/testdata/sf0.1", "embeddings")
    got = {}
    for r in ann.search(rows, lambda c: c % 20 == 0, block_rows=300, leaf_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    data = rows.collect()
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], float)
    want = brute(ids, x, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hit = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    scores = dict(zip(ids.tolist(), x, strict=True))
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - float(scores[q] @ scores[v])) < 1e-9 for v, s in found)


def test_ties_bad_vectors_and_few_candidates(spark):
    same = [0.6, 0.8]
    rows = [(i, same) for i in range(60)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]),
                                             (103, [1.0, None]), (104, [float("inf"), 0.0]), (None, same), (120, [1.0]),
                                             (140, [-1.0, 0.0]), (5, same)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(df, lambda c: c % 20 == 0, k=4, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4], 20: [0, 1, 2, 3], 40: [0, 1, 2, 3], 140: [0, 1, 2, 3]}
    few = ann.search(df.where("vec_id in (20, 21, 140)"), lambda c: c % 20 == 0, k=20)
    assert few.where("query_id = 20").count() == 2
    assert ann.search(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_a_walk_goes_on_until_it_holds_enough_rows():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 8)), 40 * rng.normal(size=(8, 8))])  # outliers get leaves of their own
    tree = ann.build_tree(x, 16)
    held = np.bincount(ann.descend(tree, x), minlength=tree.n_leaves)
    assert held.min() < 21
    for q in np.concatenate([x[:50], x[-8:]]):
        leaves = ann.best_bins(tree, q, 2, held, 21)
        assert held[leaves].sum() >= 21 and len(set(leaves)) == len(leaves) >= 2
        assert leaves[:2] == ann.best_bins(tree, q, 2)
        assert held[ann.best_bins(tree, q, 2, held, 10_000)].sum() == len(x)  # all rows, if there are fewer
