import time

import pyarrow.parquet as pq
import pytest

from netsift.llm.main_text import FEATURES, LABELLED, blocks_of, extract, features_of, grow, is_main, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this fine thing now, it is cheap and good.</div>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p>First   <b>bold</b>
words&nbsp;here.<br><p>One.</p><p>Caf&eacute; &lt;tag&gt; &#233;</p><aside>Related things</aside><form><p>Sign up</p><input></form></article>
<div id="comments"><p>Reader says this is a long comment about the article, quite long.</p></div><footer>&copy; x</footer></body></html>"""


def test_page():
    assert extract(PAGE) == "Head & line First bold words here. One. Café <tag> é"


def test_odd_pages():
    assert extract(None) == extract("") == extract("<html><body></body></html>") == extract("<nav>a</nav><script>x") == ""
    assert extract("<article><p>cut in the mid&am") == "cut in the mid&am"
    assert extract("<article><p>a < b and <p>c") == "a < b and c"
    assert extract("<article>" + "<p>word</p>" * 5000 + "</article>") == " ".join(["word"] * 5000)
    assert extract("<div>" * 3000 + "<article>deep words</article>") == "deep words"
    assert extract("<main><p>Text.</p><div class='share-links'><a>x</a></div></main>") == "Text."


def test_unmarked_page_by_density():
    page = "<body><div><a>Home</a> <a>About</a> <a>Contact</a></div><p>" + "plain words " * 20 + "</p><p>" + "more words " * 15 + "</p><div><a>next</a> <a>previous</a></div></body>"
    assert extract(page) == " ".join((("plain words " * 20) + ("more words " * 15)).split())


def test_tree_fits_its_table():
    assert sum(is_main(r[:-1]) != bool(r[-1]) for r in LABELLED) <= 3


def test_frames(spark):
    rows = [(1, "u", PAGE, "old", 3, "e"), (2, None, None, None, None, "e"), (2, None, None, None, None, "e"), (None, "v", "", "x", 1, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, extra string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "extra", "text", "n_chars"]
    got = out.collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, len(extract(PAGE))), (2, 0), (2, 0), (None, 0)]
    assert main_text(df.limit(0)).collect() == []


def test_names_of_stories_and_their_heads():
    assert extract("<div class='article header'><h1>Head</h1></div><div class='entry-content'><p>Words.</p><div class='post-comments'>no</div></div>") == "Head Words."
    assert extract("<article><p>one <b>two<p>three</b> four<div class='ad'>no</b> no</div> five</article>") == "one two three four five"
    assert extract("<article><p>a<table><tr><td><p>b<div>c</div></td></tr></table>d</article>") == "a b c d"


N = 100_000


@pytest.mark.parametrize("html,want", [
    ("<article>" + "<i></b>" * N + "end", "end"), ("<article>" + "<div></p>" * N + "end", "end"), ("<article><p>" + "<span>" * N + "<div>end", "end"), ("<article>" + "<p>" * N + "end", "end"),
    ("<article>" + "</div>" * N + "end", "end"), ("<article>" + "<table><td>" * N + "end", "end"), ("<article>" + "<b><p>" * N + "end", "end"), ("<article>" + "&lt;" * N, "<" * N), ("<article>" + "a " * N * 10, " ".join("a" * N * 10)),
    ("<article class='" + "post " * N + "'>end", "end"), ("<article style='" + "display " * N + "'>end", "end"),
])
def test_hostile_pages_take_linear_time(html, want):
    began = time.time()
    assert extract(html) == want and time.time() - began < 20


def elements(html):
    """(text, is article) of the pages' layout, read by plain splitting: what stands in <article> and what does not."""
    at, end = html.index("<article>"), html.index("</article>")
    return html[:at], html[at:end], html[end:]


def test_pages_of_the_tables_by_another_reader():
    import html as h
    import re

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        _, story, _ = elements(page)
        cut = re.sub(r"<(?:h1|/h1|p|/p|br)>", " ", story).replace("<article>", " ")
        assert extract(page) == " ".join(h.unescape(re.sub(r"</?b>", "", cut)).split())


def test_words_and_links_alone_are_right_nine_times_of_ten():
    """The tree without what elements say of themselves, on the blocks of the tables' pages."""
    text = [FEATURES.index(f) for f in FEATURES if f not in ("in_frame", "in_story", "page_has_story")]
    plain = grow([tuple(r[k] for k in text) + r[-1:] for r in LABELLED])

    def keeps(x):
        node = plain
        while isinstance(node, tuple):
            f, cut, low, high = node
            node = low if x[f] <= cut else high
        return node

    right = total = 0
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist():
        blocks = blocks_of(page)
        for b, x in zip(blocks, features_of(blocks)):
            total += 1
            right += keeps([x[k] for k in text]) == (b.story and not b.frame)
            assert is_main(x) == (b.story and not b.frame)
    print(f"blocks {total}, right {right / total:.4f}")
    assert right / total > 0.85
