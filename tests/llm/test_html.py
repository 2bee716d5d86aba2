import itertools
import random

import pytest

from nothi.llm import common
from nothi.llm import op8_html_mincut as op8

SENTENCE = "The river rose in the night and the whole village moved to higher ground before dawn. "
ARTICLE = f"<h1>Flood</h1><p>{SENTENCE * 2}</p><p>Second &amp; <b>bo</b>ld&nbsp;text<br>after a break, with some more words to make it long enough.</p>"
WANT = f"Flood {(SENTENCE * 2).strip()} Second & bold text after a break, with some more words to make it long enough."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var x='</p><p>no</p>';</script></head><body>{NAV}<article>{ARTICLE}</article><footer>&copy; all rights</footer></body></html>",
        f"<body><header><h1>Site</h1>{NAV}</header><main><article><header>{ARTICLE.split('</h1>')[0]}</h1></header>{ARTICLE.split('</h1>')[1]}</article></main></body>",
        f"<div class='menu'><a href=a>One</a> <a href=b>Two</a></div><div id='content'>{ARTICLE}</div><div class='sidebar'><p>{SENTENCE}</p></div>",
        f"<div class=page>{ARTICLE}<div class='comments'><article class='comment'><p>{SENTENCE}</p></article></div></div>",
        f"<article>{ARTICLE}<aside><p>{SENTENCE}</p></aside><div class='ad-banner'>Buy now. {SENTENCE}</div><form><label>Mail</label><input name=q><button>Go</button></form></article>",
        f"<!-- c --><ARTICLE CLASS='post'>{ARTICLE}</ARTICLE><div class='cookie-notice'><p>We use cookies. {SENTENCE}</p></div><noscript>Enable</noscript>",
        f"<div class='has-sidebar sidebar-right'><article>{ARTICLE}</article></div><div role='navigation'>Skip</div>",
        f"<article>{ARTICLE}",
        f"<p>{ARTICLE}</p></div></div><footer><p>{SENTENCE}",
    ],
)
def test_pages(page):
    assert op8.main_text(page) == WANT


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("   ", ""), ("<", ""), ("<p", ""), ("<!--", ""), ("<script>x", ""), ("&#x41;&#0;&bogus; " + SENTENCE, "A�&bogus; " + SENTENCE.strip())])
def test_odd_pages(page, text):
    got = op8.main_text(page)
    assert got == text or (page == "<" and got in ("", "<"))


def cost(label, odds, edges):
    return sum(max(0.0, o) if not x else max(0.0, -o) for x, o in zip(label, odds)) + sum(w for i, j, w in edges if label[i] != label[j])


@pytest.mark.parametrize("seed", range(30))
def test_the_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    odds = [r.choice([-2, -1, -0.5, 0.25, 0.5, 1, 2]) for _ in range(n)]
    edges = [(i, j, r.choice([0.25, 0.75, 1.0])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
    best = min(cost(x, odds, edges) for x in itertools.product([False, True], repeat=n))
    assert cost(op8.minimum_cut(odds, edges), odds, edges) == pytest.approx(best)


def test_long_and_deep_pages():
    assert len(op8.main_text("<article><p>" + SENTENCE * 3000)) == len(SENTENCE) * 3000 - 1
    assert op8.main_text("<div>" * 3000 + "<article>" + ARTICLE) == WANT
    assert op8.minimum_cut([], []) == []


def test_many_doubtful_blocks():
    r = random.Random(1)
    n = 20_000
    odds, edges = [r.choice([-0.5, 0.5]) for _ in range(n)], [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 2, 0.75) for i in range(n - 2)]
    label = op8.minimum_cut(odds, edges)
    assert len(label) == n and cost(label, odds, edges) <= min(cost([x] * n, odds, edges) for x in (True, False))


def test_rows(spark):
    d = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}"), (1, "u", f"<article>{ARTICLE}"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    out = op8.extract(d).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT))]
    assert op8.extract(d.limit(0)).count() == 0


LONG = f"<p>{SENTENCE * 3}</p>"
LONG_TEXT = (SENTENCE * 3).strip()
DOUBTFUL = [
    (f"<div id=x>{LONG}<div>Fig. 2</div>{LONG}</div>", f"{LONG_TEXT} Fig. 2 {LONG_TEXT}"),
    (f"<div id=x>{LONG}<ul><li>flour</li><li>two eggs</li></ul>{LONG}</div>", f"{LONG_TEXT} flour two eggs {LONG_TEXT}"),
    (f"<div id=x>{LONG}<blockquote><div>So be it</div></blockquote>{LONG}</div>", f"{LONG_TEXT} So be it {LONG_TEXT}"),
    (f"<div id=x><div>{'<br>'.join(['x'] * 1)}</div>{LONG}<div>1998</div><div>Photo: A. Smith</div>{LONG}</div>", f"x {LONG_TEXT} 1998 Photo: A. Smith {LONG_TEXT}"),
    ("<div>" + "".join(f"<div><a href=#>Link number {i}</a></div>" for i in range(4)) + "<div>A word of the day for all who pass by.</div>" + "".join(f"<div><a href=#>Link number {i}</a></div>" for i in range(4)) + "</div>", ""),
    (f"<table><tr><td>{LONG}<td>{LONG}<tr><td>12<td>{LONG}</table>", f"{LONG_TEXT} {LONG_TEXT} 12 {LONG_TEXT}"),
]


@pytest.mark.parametrize("page, want", DOUBTFUL)
def test_the_cut_is_right_where_the_classifier_errs(page, want):
    blocks, odds, label = op8.labelled(page)
    by_sign = " ".join(b.text for b, o in zip(blocks, odds) if o > 0)
    assert op8.main_text(page) == want and by_sign != want


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>Let <math>x</math> be.</p>", "Let x be."),
        ("<svg><text>Chart of the river</text>", "Chart of the river"),
        ("<noscript><p>Shown without scripts, as it was meant to be.</p></noscript>", "Shown without scripts, as it was meant to be."),
        ("<object>Shown instead of the film</object>", "Shown instead of the film"),
        (f"<div class='related-work'><p>{SENTENCE}</p></div>", SENTENCE.strip()),
        (f"<div class='alert'><p>{SENTENCE}</p></div>", SENTENCE.strip()),
        ("<script>var a = 1;", ""),
        ("<textarea>typed</textarea><select><option>One</select><button>Go</button>", ""),
    ],
)
def test_nothing_of_the_article_is_lost(inside, text):
    page = f"<body>{NAV}<article>{ARTICLE}{inside}<p>{SENTENCE}</p></article><footer>end</footer>"
    assert op8.main_text(page) == " ".join(filter(None, [WANT, text, SENTENCE.strip()]))


def test_time_grows_with_size():
    import time

    began = time.time()
    op8.main_text("<div>x " * 150_000)
    op8.main_text("<div>" * 20_000 + "<p>some words</p>" * 20_000)
    op8.main_text("<b><i>x " * 20_000 + "</u>" * 20_000 + "<p>y" * 20_000 + "<script>" * 20_000)
    assert time.time() - began < 30


#: The same prose without a paragraph element.
UNMARKED = [
    (f"<article><div>{SENTENCE}</div></article>", SENTENCE),
    (f"<article><div>{SENTENCE}</div><div>{SENTENCE}</div><div>{SENTENCE}</div></article>", SENTENCE * 3),
    (f"<article><h1>Flood</h1><div>{SENTENCE}</div><div>{SENTENCE}</div></article>", f"Flood {SENTENCE * 2}"),
    (f"<article><blockquote>{SENTENCE}</blockquote></article>", SENTENCE),
    (f"<article><table><tr><td>{SENTENCE}</td></tr></table></article>", SENTENCE),
    ("<article><ul><li>The first of the two items, with a few words more</li><li>The second of the two items</li></ul></article>", "The first of the two items, with a few words more The second of the two items"),
    (f"<main>{SENTENCE}<br>{SENTENCE}</main>", SENTENCE * 2),
    (f"<body><div>{SENTENCE * 3}<br><br>{SENTENCE * 3}</div></body>", SENTENCE * 6),
    (f"<body>{SENTENCE * 10}</body>", SENTENCE * 10),
    (f"<body><p>{SENTENCE * 4}</p></body>", SENTENCE * 4),
    (f"<article><xmp>{SENTENCE}</xmp></article>", SENTENCE),
]


@pytest.mark.parametrize("page, text", UNMARKED)
def test_prose_without_paragraphs(page, text):
    assert op8.main_text(page) == text.strip()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_a_text_does_not_depend_on_other_pages(spark, sf):
    """Every page of these tests beside the pages of a table."""
    mine = [(-1 - i, "u", p) for i, (p, _) in enumerate([*UNMARKED, *DOUBTFUL])]
    pages = common.pick(common.table(spark, f"/root/testdata/sf{sf}", "pages"), page_id="long", url="string", html="string")
    got = {r.page_id: r.text for r in op8.extract(pages.union(spark.createDataFrame(mine, pages.schema))).filter("page_id < 0").collect()}
    assert got == {-1 - i: w.strip() for i, (_, w) in enumerate([*UNMARKED, *DOUBTFUL])}


def test_report(spark):
    page = lambda i: f"<body>{NAV}<article><h1>Head {i}</h1>{LONG}<p>Short.</p><ul><li>one</li></ul>{LONG}</article><aside><p>{SENTENCE}</p></aside><footer>&copy; site {i}</footer></body>"
    d = spark.createDataFrame([(i, "u", page(i)) for i in range(120)] + [(200 + i, "v", p) for i, (p, _) in enumerate(DOUBTFUL)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op8.extract(d).collect()}
    assert all(got[i] == f"Head {i} {LONG_TEXT} Short. one {LONG_TEXT}" for i in range(120))
    report = op8.cut_report(d).head()
    assert report.blocks > 1000 and report.doubtful > report.flipped > 0
