"""Markup that only looks like something beside the text, pages without marks, malformed pages."""

import time

import pytest

from loomcat.llm import pages


def kept(html):
    return [text for text, zone in pages.blocks(html) if zone != pages.BESIDE]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article class="post comments-open"><p>Text</p></article>', ["Text"]),
        ('<div class="content no-sidebar"><p>Text</p></div>', ["Text"]),
        ('<div class="site-footer"><p>Foot</p></div><div id="sidebar-left">Side</div><p>Text</p>', ["Text"]),
        ("<form action=x><nav>Menu</nav><h1>Head</h1><p>Text</p><input><button>Go</button></form>", ["Head", "Text"]),
        ("<form><p>Mail us</p><label>Name</label></form><p>Text</p>", ["Text"]),
        ("<form><article><p>Text</p></article></form><p>Foot</p>", ["Text"]),
        ("<article><p>Teaser</p></article><p>A text that is longer than it</p>", ["Teaser", "A text that is longer than it"]),
        ('<article><p>Long text of it</p><div class="comments"><p>Reader</p></div></article><p>Foot</p>', ["Long text of it"]),
        ('<p title="a > b" data-x=\'"\'>One</p><p title="open>Two</p><p>Three', ["One", "Two", "Three"]),
        ("<p>1 < 2 &lt; 3</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->", ["1 < 2 < 3"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul></b></i>e", ["a", "b", "c", "d", "e"]),
        ("", []), ("<p>end <a href=", ["end"]), ("<p>end <!-- no", ["end"]),
    ],
)
def test_blocks(html, want):
    assert kept(html) == want


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 200_000, "<a " * 200_000 + '">', "<a b='" * 200_000, "</p>" * 200_000, "<i>" * 200_000 + "</p>" * 200_000,
        "<li><ul>" + "<i>" * 100_000 + "<li></li>" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 400_000,
        "<p>" + "text &amp; " * 300_000, "<b x=" + " " * 500_000, "<div>" * 200_000 + "text" + "</div>" * 200_000,
    ],
)
def test_malformed_pages_take_linear_time(html):
    begin = time.time()
    pages.blocks(html)
    assert time.time() - begin < 5


def test_neighbours_decide_where_nothing_is_marked(spark):
    """Against a plain comparison of all lines of neighbouring pages, on pages without any marks."""
    shared = [f"Shared line {k}" for k in range(6)]
    rows, want = [], {}
    for n in range(30):
        own = [f"Page {n} line {k}" for k in range(1 + n % 4)]
        lines = [*shared[:3], *own, *shared[3 : 3 + n % 3 + 1]]
        rows.append((n, f"http://h{n % 3}.example/{n:03d}", "".join(f"<p>{x}</p>" for x in lines)))
        want[n] = own, lines
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.extract_main_text(frame).collect()}
    for n, (own, lines) in want.items():
        near = [want[m][1] for m in (n - 3, n + 3) if m in want]
        expected = [x for x in lines if not any(x in other for other in near)]
        assert got[n]["text"] == "\n\n".join(expected) and got[n]["n_shared"] == len(lines) - len(expected) > 0
        assert set(own) <= set(expected)
