import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from stowage.llm import html_text as h

LONG = "Some words of an article that go on. " * 5


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>  </p>", ""),
        ("plain &amp;amp; text\n more", "plain &amp; text more"),
        ("<article><h1>T</h1><p>a<p>b <i>c</i>&eacute;</article><footer>f</footer>", "T\na\nb cé"),
        ("<nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy it</div><article><p>x</p></article><aside>s</aside>", "x"),
        ("<article><p>x</p><div class='reader-comments'><p>I think</p></div><p><a href=1>all a link</a></p></article>", "x\nall a link"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a<br>b", "a b"),
        (f"<div id=topMenu>m</div><p>{LONG}</p><p>short</p><div class='cookie-notice'>ok?</div>", f"{LONG.strip()}\nshort"),
        (f"<header>Site</header><main><p>{LONG}</p><form>name<input></form></main><p>outside</p>", LONG.strip()),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<p>a <!-- <p>no</p> --> b</p>", "a b"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ],
)
def test_cases(html, want):
    assert h.extract(html) == want


@pytest.mark.parametrize("html", ["<a " * 50_000, "<!--" * 50_000, "<p x='" * 50_000, "<svg>" * 50_000, "<div>" * 50_000 + "</span>" * 50_000, "<p>" * 50_000, "<!" * 50_000, "<p>a</p>" * 50_000])
def test_odd_markup_takes_linear_time(html):
    began = time.time()
    h.extract(html)
    assert time.time() - began < 20


def test_surge_and_dive():
    assert h.spans([0, 0, 0, 0, 50, 60, 0, 70, 0, 0, 0, 5, 0, 0, 0], 80) == [(2, 8)]
    assert h.spans([0, 5, 0, 0, 0, 0, 9], 80) == [(4, 7)]
    assert h.spans([], 80) == []


def test_query(spark, tmp_path):
    rows = [(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in h.op1_html_text(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)]


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<h2><a href=1>Title</a></h2><p>{LONG}</p><p><a href=2>a linked paragraph</a></p><p>end</p>", f"Title\n{LONG.strip()}\na linked paragraph\nend"),
        (f"<p><a href=1>before</a></p><nav>menu</nav><p>{LONG}</p>", LONG.strip()),
        (f"<p>{LONG}</p><p><a href=1>one</a></p><p><a href=1>two</a></p><p><a href=1>three</a></p><p>short</p>", LONG.strip()),
        (f"<p>outside</p><article><p>{LONG}</p></article><p>outside</p><article><p>x</p></article>", f"{LONG.strip()}\nx"),
    ],
)
def test_linked_lines_between_surge_and_dive(html, want):
    assert h.extract(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<body><div class="has-sidebar no-ads"><p>{LONG}</p></div>', LONG.strip()),
        (f'<main><div class="content with-sidebar"><p>{LONG}</p></div></main>', LONG.strip()),
        (f'<div class="comments-off article-body"><p>{LONG}</p></div>', LONG.strip()),
        (f'<div class="page sidebar-layout"><p>{LONG}</p></div><p>end</p>', f"{LONG.strip()}\nend"),
        (f'<div class="promo"><nav>menu</nav><article><p>{LONG}</p></article></div>', LONG.strip()),
        (f'<p title="a hidden gem">{LONG}</p>', LONG.strip()),
        (f'<p data-id="ad-1" data-class="ad">{LONG}</p>', LONG.strip()),
        (f"<p data-x='class=\"ad\"'>{LONG}</p>", LONG.strip()),
        ('<article><p>All about <span class="social">social security</span> and more.</p></article>', "All about social security and more."),
        ('<article><p>x</p><p><span class="ad">Buy it</span></p><p>y</p></article>', "x\ny"),
        ("<article><p>x</p><svg><p>y</p><noscript><p>z</p></article>", "x\ny\nz"),
        ("<article><p>x<svg><path d='M0'/><text>no</text></svg></p><noscript>no</noscript><p>z</p></article>", "x\nz"),
        (f"<p>{LONG}</p><script>never closed", LONG.strip()),
        ("<article><p>one<br>two<br/>three</br>four</p></article>", "one two three four"),
        (f'<p>{LONG}</p><div class="comments"><p>{LONG * 9}</p></div>', LONG.strip()),
        (f'<div id="comments"><article><p>{LONG * 9}</p></article></div><p>{LONG}</p>', LONG.strip()),
        (f'<p>{LONG}</p><div class="AD"><p>buy</p></div><div CLASS=cookie-notice>ok</div><div style="display: none">x</div><p aria-hidden="true">y</p>', LONG.strip()),
        ('<article class="comment"><p>me too</p></article><article><p>x</p></article>', "x"),
    ],
)
def test_asides_are_told_from_articles(html, want):
    assert h.extract(html) == want


def test_line_blocks_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, rng.randint(1, 90)]) for _ in range(rng.randrange(25))]
        threshold, window = rng.choice([0, 40, 80]), rng.randint(1, 4)
        sums = [sum(weights[i : i + window]) for i in range(len(weights))]
        runs, at = [], 0
        for above, group in itertools.groupby(sums, key=lambda x: x > 0):
            n = len(list(group))
            if above:
                runs.append((at, at + n))
            at += n
        passed = [r for r in runs if max(sums[r[0] : r[1]]) > threshold]
        if not passed and runs:
            best = max(max(sums[a:b]) for a, b in runs)
            passed = [next(r for r in runs if max(sums[r[0] : r[1]]) == best)]
        assert h.spans(weights, threshold, window) == passed


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert h.op1_html_text(spark, str(tmp_path)).count() == 0


def test_pages_without_marks_give_the_same_text():
    # what the marks of an article say, surge and dive find by themselves where the rest is in asides
    body = f"<h1>Title</h1><p>{LONG}</p><p>short</p><p>{LONG}</p>"
    page = "<nav><a href=/>Home</a></nav><div class=ad>Buy</div>{}<footer>f</footer>"
    assert h.extract(page.format(body)) == h.extract(page.format(f"<article>{body}</article>")) == f"Title\n{LONG.strip()}\nshort\n{LONG.strip()}"
