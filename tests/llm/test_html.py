"""Main text of pages: literal pages, brute-force ratios, what switching the ratios off changes, and pages that are large or broken."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import html

LONG = "Long text, with words, and so on. More text here; yes, and more."
PAGES = [
    (f"<html><body><header>Site</header><div id=nav>a b</div><div class='post-body'><h2>Title</h2><p>{LONG}<p>Short.<ul><li>one<li>two</ul></div><div class=comments><p>I like it, very much, so good. Yes indeed this is long!</p></div><footer>c</footer>", f"Title {LONG} Short. one two"),
    ("<article><p>a <b>bo</b>ld &lt;x&gt;\n t<br>z</p><aside>no</aside><form>f</form></article>", "a bold <x> t z"),
    ("<script>never closed <p>zz</p>", ""), ("a < b and c &gt; d", "a < b and c > d"), ("", ""), (None, ""), ("<div>", ""), ('<p "broken', ""), ('<p "odd>text', "text"), ('said <p title="never closed>text', "said"),
    ("<nav><a href=x>Menu</a></nav><main><h1>T</h1><p>x</p></main><div class=ad>Buy, now. Really, this is a long advert, isn't it?</div>", "T x"),
    (f'<div class="content-sidebar-wrap"><div id="page" class="no-sidebar"><article><h1>T</h1><p>{LONG}</p></article></div></div>', f"T {LONG}"),
    (f'<div class="sidebar"><article><p>{LONG}</p></article></div><p>x</p>', LONG),
    (f"<body><h1>T</h1><p>{LONG}</p><p>{LONG}</p><ul><li>a</ul><div><div>Menu</div></div></body>", f"T {LONG} {LONG} a"),
    ('<article><p>seen <span hidden>un<i>seen</i></span> on</p><p style="display: none">no</p></article>', "seen on"),
]


def test_pages(spark):
    rows = [(i, "u", p) for i, (p, _) in enumerate(PAGES)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "path", "block")})
    got = html.report(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for r in got:
        assert (r.text, r.n_chars) == (PAGES[r.page_id][1], len(PAGES[r.page_id][1])), PAGES[r.page_id][0]
    assert html.report(df.limit(0)).count() == 0


NAMES = "site-footer page-footer main-navigation sidebar-container cookie-container comments-wrapper site-header mainMenu page_comments content-footer".split()


@pytest.mark.parametrize("name", NAMES)
def test_layout_words_take_no_mark_back(name):
    other = f'<div class="{name}"><p>{LONG} Said by others.</p></div>'
    assert html.main_text(f"<body><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{other}</body>") == f"T {LONG} {LONG}"
    assert html.main_text(f"<body>{other}</body>") == ""


def test_pages_of_nothing_but_something_else_are_empty():
    for page in ("<nav><ul><li><a>Home</a><li><a>About</a></ul></nav>", '<div class="cookie-banner"><p>We use cookies, as all do. Accept?</p></div>', f"<footer><p>{LONG}</p></footer><aside>{LONG}</aside>"):
        assert html.main_text(page) == ""
    for name in ("no-sidebar", "has-sidebar", "with-comments", "content-sidebar-wrap"):
        assert html.main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG


def test_ratios_decide_between_unmarked_blocks(monkeypatch):
    """Nothing is marked here, and there is no article: only the ratios tell links and lines of data from prose."""
    page = "<body><section><div>Home</div><div>News</div></section><section>" + f"<p>{LONG}</p>" * 3 + "</section><section><div>12</div><div>13</div></section></body>"
    assert html.main_text(page) == " ".join([LONG] * 3)
    monkeypatch.setattr(html, "fused", lambda path, texts, prior: prior)
    assert html.main_text(page) == " ".join(["Home", "News", *[LONG] * 3, "12", "13"])


def test_ratios_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 12)
        path = [r.randrange(4) for _ in range(n)]
        texts = ["".join(r.choice("ab .,;!?x") for _ in range(r.randint(1, 90))) for _ in range(n)]
        prior = [r.choice((1.0, 8.0, 1 / 64)) for _ in range(n)]
        mean = lambda p, f: sum(f(t) for q, t in zip(path, texts, strict=True) if q == p) / path.count(p)  # noqa: E731, B023
        raw = [[mean(p, len) for p in path], [1 + mean(p, lambda t: sum(t.count(c) for c in ".,;!?")) for p in path]]
        side = math.exp(-0.5)
        smooth = lambda x: [(side * x[max(i - 1, 0)] + x[i] + side * x[min(i + 1, n - 1)]) / (1 + 2 * side) for i in range(n)] if n > 2 else x  # noqa: E731, B023
        exp = [a * b * c for a, b, c in zip(smooth(raw[0]), smooth(raw[1]), prior, strict=True)]
        got = html.fused(np.array(path), texts, np.array(prior))
        assert got == pytest.approx(exp)
        mid = sum(exp) / n
        least = min(math.sqrt(sum((x - mid) ** 2 for x in exp) / n), max(exp))
        some = {p for p, x in zip(path, exp, strict=True) if x >= least * (1 + 1e-12)}
        assert set(np.array(path)[html.chosen(np.array(path), got)].tolist()) >= some


def test_given_pages_have_text(spark, small):
    assert all(html.main_text(r.html or "") for r in spark.read.parquet(f"{small}/pages.parquet").collect())


@pytest.mark.parametrize(
    "page, n",
    [("<div>x" * 100_000, 199_999), ("<div>" * 100_000, 0), ('<p "' * 250_000, 0), ('<p a="' * 200_000, 0), ("<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, 0), ("<b>x" * 100_000, 100_000), ("<" * 10**6, 10**6), ("</div>" * 200_000, 0), ("<article>" + "<header>x" * 50_000, 99_999), ("<p>one word. </p>" * 100_000, 999_999)],
    ids=range(10),
)
def test_large_and_broken_pages_take_linear_time(page, n):
    began = time.process_time()
    assert len(html.main_text(page)) == n
    assert time.process_time() - began < 10
