"""Page texts: layouts of many kinds, and all pages of a table against a plain reading of their articles."""

import html
import re
import time

import numpy as np
import pytest

from tessellar.llm import html_extract
from tessellar.llm.queries import op1_extract_pages

ONE, TWO = (f"This is paragraph {k} of the article, with enough words in it to be taken for content by any reader who looks at it." for k in (1, 2))
BOTH = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE} {TWO}"
OTHER = "<p>Welcome to the best site ever, all of you who read it, and come back soon.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div id=header>{OTHER}</div><div id=menu><a href=x>A</a></div><div id=content>{BOTH}</div><div id=sidebar>{OTHER}</div><div id=footer>{OTHER}</div>", TEXT),
        (f"<div class=siteHeader>{OTHER}</div><div class=postBody>{BOTH}</div><div class=sideBar>{OTHER}</div><div class=siteFooter>{OTHER}</div>", TEXT),
        (f"<article>{BOTH}<section id=comments><h2>Comments</h2>{OTHER}</section></article>", TEXT),
        (f"<main>{BOTH}<ol class=commentlist><li>{OTHER}</ol><div class='user-comments'>no</div></main>", TEXT),
        (f"<article><p>{ONE}</p><article class=comment>{OTHER}</article><p>{TWO}</p></article>", TEXT),
        (f"<article><p>{ONE}</p><div class='ad-slot'>no</div><ins class=adsbygoogle>no</ins><p>{TWO}</p></article>", TEXT),
        (f"<div class='cookie-banner'>no</div><div role=alert>no</div><article><p>{ONE}</p><aside>no</aside><p>{TWO}</p></article>", TEXT),
        (f"<div class='page has-sidebar'><article class='post comments-open'>{BOTH}</article></div>", TEXT),
        (f"<BODY><NAV>no</NAV><ARTICLE><P>{ONE}<P>{TWO}</ARTICLE><FOOTER>no</FOOTER></BODY>", TEXT),
        (f"<p>no<nav><a>no</a></nav><article>{BOTH}</article>", TEXT),
        ("<article><p>a &lt;b&gt; &amp;amp; &#8212; &#x41;&nbsp;&eacute;</p></article>", "a <b> &amp; — A é"),
        ("<article><p>x<!-- y > z --> w</p><script>if (a<b) f('</p>')</script><p hidden>no</p><p>k</p></article>", "x w k"),
        ("<nav>no</nav><article><p>Hi.</p></article><footer>Longer than the article by far, by far.</footer>", "Hi."),
        ("<nav><a>no</a></nav><footer>no</footer>", ""),
    ],
)
def test_layouts(page, want):
    assert html_extract.main_text(page) == want


def test_names_of_a_state_mark_nothing():
    assert html_extract.marks_of("has-sidebar open comments-open") == (0, 0, False)
    assert html_extract.marks_of("sideBar")[0] == html_extract.marks_of("site-sidebar")[0] == html_extract.marks_of("sidebar-prices")[1] != 0


def test_whole_table(spark):
    at = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in op1_extract_pages(spark, at).collect()}
    for k, page in pages.items():
        article = re.sub(r"<!--.*?-->", "", page.split("<article>")[1].split("</article>")[0], flags=re.S)
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article.replace("<br>", " "))
        lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in blocks)
        text = " ".join(x for x in lines if x)
        assert got.pop(k) == (text, len(text))
    assert not got


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class=elementor-widget><div class='elementor-widget-text widget'>{BOTH}</div></div><div class=sidebar>{OTHER}</div>", TEXT),
        (f"<body><form action=x><div id=nav><a>A</a></div><div>{BOTH}</div></form></body>", TEXT),
        (f"<article><h2 id=share-prices>Prices</h2><p>{ONE}</p><section id=cookies><h2 class=related-work>More</h2><p>{TWO}</p></section></article>", f"Prices {ONE} More {TWO}"),
        (f"<main><article><p>{ONE}</p></article><article><p>{TWO}</p></article></main>", TEXT),
        (f"<main><div class=content><p>{ONE}</p></div><div class=content><p>{TWO}</p></div></main>", TEXT),
        (f"<![foo[bar]]><article>{BOTH}<![if !IE]><![endif]></article>", TEXT),
        ("<article><p>see <code><span class='hljs-comment'>// a comment</span> x</code> and on it goes for a while, so that it is read.</p></article>", "see // a comment x and on it goes for a while, so that it is read."),
        (f"<div><a>Home</a> <a>News</a></div><div><p>{ONE}</p><p>{TWO}</p></div><div><a>Imprint</a></div>", TEXT),
        ("<![x<!y<?z", "<![x<!y<?z"),
    ],
)
def test_marks_are_evidence_only(page, want):
    assert html_extract.main_text(page) == want


def test_the_ratio_chooses():
    # no names, no article: only the ratio tells the text from what is around it
    page = "<div>" + "".join(f"<div><b>x</b><i>{k}</i><u>y</u></div>" for k in range(8)) + f"</div><div>{BOTH}</div><div>" + "".join(f"<div><b>z</b><i>{k}</i></div>" for k in range(8)) + "</div>"
    assert html_extract.main_text(page) == TEXT
    turned = html_extract.main_text(page, scores=lambda lines: 1000.0 / (1 + np.array([len(x[0]) for x in lines])))
    assert turned != TEXT


MANY = " ".join([ONE] * 9)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body>{BOTH}</body>", TEXT),
        (f"<body><p>{ONE}</p><p>Short.</p><p>{MANY}</p><p>The end.</p></body>", f"{ONE} Short. {MANY} The end."),
        (f"<body><h1>Title</h1><p>Short lead.</p>{f'<p>{MANY}</p>' * 3}</body>", f"Title Short lead. {MANY} {MANY} {MANY}"),
        (f"<div><section>{f'<p>{ONE}</p>' * 9}</section><section><p>The last part.</p></section></div>", f"{MANY} The last part."),
        (f"<div><p>{ONE}</p><ul><li>first<li>second</ul></div><div><a>Home</a></div>", f"{ONE} first second"),
        (f"<article><p>{ONE}</p><div class=advert><p>{MANY}</p></div><p>{TWO}</p></article>", TEXT),
        (f"<article><p>{ONE}</p><div class=sidebar><p>{MANY}</p></div><p>{TWO}</p></article>", TEXT),
        (f"<body><p>Short one.</p><div class=notice><p>{MANY}</p></div><p>Short two.</p></body>", "Short one. Short two."),
        (f"<article><p>{ONE}</p><form><p>{MANY}</p><input></form><p>{TWO}</p></article>", TEXT),
        (f"<aside><article><p>{MANY}</p></article></aside><div><p>{ONE}</p></div>", ONE),
        (f"<div class=modal><article>{BOTH}</article></div><div>one more line</div>", TEXT),
        ("<article><p>x</p><![CDATA[ a > b ]]><p>y</p></article>", "x y"),
    ],
)
def test_no_share_of_the_text_decides(page, want):
    assert html_extract.main_text(page) == want


def test_scores_choose_on_pages_without_names(spark):
    """The table's pages without their article and class names: the text changes with the scores, and holds the article with them as they are."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()
    changed = found = 0
    for r in rows:
        page = re.sub(r"</?(?:article|main|nav|header|footer|aside|form)\b", lambda m: m[0].replace(m[0].lstrip("</"), "div"), r.html)
        page = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)
        shuffled = lambda lines: np.random.default_rng(3).permutation([len(x[0]) / x[1] for x in lines])
        own = html_extract.main_text(page)
        changed += own != html_extract.main_text(page, scores=shuffled)
        longest = max(re.findall(r"<p>([^<]+)</p>", r.html.split("<article>")[1].split("</article>")[0]), key=len, default="")
        found += " ".join(html.unescape(longest).split()) in own
    assert changed > len(rows) // 3 and found > len(rows) * 0.9


def test_odd_markup_takes_linear_time():
    n = 20000
    for page in ("<div>" * n + "</p>" * n, "</p>" * (n * 10), "<b>" * n + "<p>x" * n, "<span>" * n + "</div>" * n, "<!--" * n, "<a " * n, "</" * n):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 4
