import itertools
import time

import numpy as np
import pytest

from schemaloom.llm import dom
from schemaloom.llm import html_extract as H
from schemaloom.llm.synthetic_pages import synthetic_page


def blocks(source):
    return [t for _, t in dom.parse(source).blocks]


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a  b\n c<br>d<p>e &amp; f&lt;g&#233;", ["a b c d", "e & f<gé"]),
        ("<p><b>one<br><p>two</b> three</p>", ["one", "two three"]),
        ("<script>var t='</p><p>x';</script><style>p{}</style>y<!-- <p>z</p> -->w", ["yw"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<div>a<div>b</div>c</div>d", ["a", "b", "c", "d"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ('<p class="x>y" title=\'a>b\'>t</p>', ["t"]),
        ("<p>open <!-- never closed", ["open"]),
        ("</div></p>text</article>", ["text"]),
        ("<script>never closed", []),
        ("<head><title>t</title></head><body>b", ["b"]),
        ("<button>x</button>a<select><option>o</select>b", ["ab"]),
        ("<p>a&nbsp;&nbsp;b&am c&a</p>", ["a b&am c&a"]),
        ("<SCRIPT>x</SCRIPT ><P>Y</P>", ["Y"]),
        ("", []),
        (None, []),
    ],
)
def test_blocks(source, want):
    assert blocks(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<html><head><title>t</title><body><article><p>a<p>b</article>", ["a", "b"]),
        ("<html><head><title>t</title><meta charset=x><link rel=y><style>s</style><article><p>a</article>", ["a"]),
        ("<head><title>t</title>\n text <b>c</b>", ["text c"]),
        ("<head><title>t</title><a href=x>l</a> m", ["l m"]),
        ("<head><script>s</script><img src=x>a<br>b", ["a b"]),
        ("<head><head><title>t</title></head><p>a", ["a"]),
        ("<head><noscript><img src=x>n</noscript><template><p>u</p></template><title>t</title><p>a", ["a"]),
        ("<head><noscript><style>s</style><body>a", ["a"]),
        ("<head><template><body><p>u</template><p>a", ["a"]),
        ("<head><title>t</title><p>a</head>b<p>c", ["ab", "c"]),
        ("<head>\n<title>t</title>\n</head>\n<p>a", ["a"]),
    ],
)
def test_a_head_ends_without_its_end_tag(source, want):
    assert blocks(source) == want


def test_deep_and_broken_pages_are_read():
    assert blocks("<div>" * 3000 + "x" + "</div>" * 10) == ["x"]
    rng = np.random.default_rng(0)
    page = synthetic_page(rng)[0]
    for _ in range(60):
        i, j = sorted(rng.integers(0, len(page), 2))
        H.main_texts([page[:i] + page[j:], page[i:j]], H.trained())


def test_held_out_pages():
    rng = np.random.default_rng(1234)
    right = extra = missing = 0
    for _ in range(150):
        source, wanted = synthetic_page(rng)
        got = set(H.main_texts([source], H.trained())[0].split("\n")) - {""}
        right, extra, missing = right + len(got & wanted), extra + len(got - wanted), missing + len(wanted - got)
    assert right / (right + extra) > 0.97 and right / (right + missing) > 0.97


def brute_decoding(nodes, logit):
    """The best value of any choice of in, out or undecided for each node, by enumeration along the tree."""
    weight = np.where(nodes.subtree > 0, np.sqrt(1 + np.minimum(nodes.own, 400) / 20), 0.0)
    keep, drop = -np.logaddexp(0, -logit) * weight, -np.logaddexp(0, logit) * weight
    n = len(logit)
    children = [[j for j in range(n) if nodes.parent[j] == i] for i in range(n)]
    under = lambda i: [i, *(k for j in children[i] for k in under(j))]
    best, chosen = -np.inf, None
    for states in itertools.product((0, 1, 2), repeat=n):
        if any(nodes.parent[i] >= 0 and states[nodes.parent[i]] and states[i] != states[nodes.parent[i]] for i in range(n)):
            continue
        value = sum(keep[i] if s == 1 else drop[i] if s == 2 else (max(keep[i], drop[i]) if nodes.own[i] else 0) - H.MIXED for i, s in enumerate(states))
        if value > best + 1e-9:
            best, chosen = value, states
    return best, [s == 1 or (s == 0 and logit[i] > 0) for i, s in enumerate(chosen)], chosen, under


def test_decoding_is_the_best_one_and_keeps_or_drops_wholes():
    rng = np.random.default_rng(8)
    mixed = 0
    for _ in range(40):
        n = int(rng.integers(1, 8))
        parent = np.array([-1, *(int(rng.integers(0, i)) for i in range(1, n))])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        own = rng.integers(0, 2, n) * rng.integers(1, 900, n)
        subtree = own.copy()
        for i in range(n - 1, 0, -1):
            subtree[parent[i]] += subtree[i]
        nodes = H.Nodes(parent, depth, np.zeros((n, 1), np.float32), own, subtree)
        logit = rng.normal(size=n) * 3
        _, kept, states, under = brute_decoding(nodes, logit)
        got = H.decode(nodes, logit)
        with_text = own > 0
        assert got[with_text].tolist() == np.array(kept)[with_text].tolist()
        for i, s in enumerate(states):
            if s and subtree[i]:
                assert {bool(got[k]) for k in under(i) if own[k]} <= {s == 1}
        mixed += 0 in states
    assert mixed > 5


@pytest.mark.parametrize(
    "source",
    ["<p>" + "<b>" * 100_000 + "</i>" * 100_000, "<font>" * 100_000 + "<li>" * 100_000, "<i>" + "<p>" + "<b>" * 100_000 + "</i>" * 100_000]
    + ["<a " * 200_000, "<!" * 200_000, '<a ">" ' * 50_001, "<!--" * 100_000, "<script>" * 50_000, "<div><span>" * 100_000 + "x"],
    ids=["unmatched ends", "items", "ends beyond the block", "no end of tags", "declarations", "open quotes", "comments", "raw", "never closed"],
)
def test_broken_pages_are_read_in_linear_time(source):
    began = time.process_time()
    dom.parse(source)
    assert time.process_time() - began < 2


def test_text_behind_the_last_tag_and_open_comments():
    assert [t for _, t in dom.parse("<p>a</p>b < c <d").blocks] == ["a", "b < c <d"]
    for comment in ("<!-- c", "<!-- c > d", "<!-- c</p> d"):
        assert [t for _, t in dom.parse("<p>a</p>b" + comment).blocks] == ["a", "b"]
    assert [t for _, t in dom.parse('<p title="x > y">a</p><p title="z>b</p>').blocks] == ["a", "b"]


def test_trees_fit_what_they_are_shown():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = H.boost(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.logit(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site. <button>OK</button></div>
<article><h1>A title of the page</h1><p>First paragraph of the text, with enough words to be one &amp; more.</p><div class="ad">Buy this thing now, very cheap.</div>
<p>Second paragraph, which goes on for a while and says things, as paragraphs do.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thank you for it.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Another story</a></li></ul></aside><footer>&copy; somebody</footer></body></html>"""


def test_a_page_without_end_of_head_has_its_text():
    whole, body = H.main_texts([PAGE, PAGE.replace("</head>", "")], H.trained())
    assert body == whole != ""
    assert H.main_texts([PAGE.replace("</head><body>", "")], H.trained()) == [whole]


def test_query(spark):
    rows = [(1, "u", PAGE, "old", 1), (2, None, None, None, None), (3, "v", "", "", 2), (3, "v", "", "", 2), (None, "w", PAGE, "x", 3), (5, "z", "no tags at all", None, 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars bigint")
    got = H.op8_html_extraction(pages).collect()
    want = "A title of the page\nFirst paragraph of the text, with enough words to be one & more.\nSecond paragraph, which goes on for a while and says things, as paragraphs do."
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, None)] == [want, want]
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert H.extract_text(pages).columns == ["page_id", "url", "html", "n_chars", "text"]
    assert H.op8_html_extraction(pages.limit(0)).collect() == []


def test_decoding_follows_clear_signs():
    rng = np.random.default_rng(5)
    nodes = H.table_of([dom.parse(synthetic_page(rng)[0]) for _ in range(10)])
    assert H.decode(nodes, np.full(len(nodes.parent), 5.0))[nodes.subtree > 0].all()
    assert not H.decode(nodes, np.full(len(nodes.parent), -5.0)).any()
