import math
import random
import time
import tracemalloc

import pytest

from lithogrid.llm.html_extract import content_nodes, html_extract, main_text

FIRST = "First paragraph, with some text in it, and more words. It goes on, and on."
SECOND = "Second paragraph; also with text, and a link, and so on. End."


def page(around):
    return around.replace("BODY", f"<h1>Title &eacute;&#33;</h1><p>{FIRST}</p><p>{SECOND.replace('a link', '<a href=x>a <b>link</b></a>')}</p>")


WANT = f"Title é! {FIRST} {SECOND}"


@pytest.mark.parametrize("around", [
    "<article>BODY</article>",
    "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><main>BODY</main><footer>c</footer></body></html>",
    "<body><div id='cookie-notice'>We use cookies. Really, do.</div><div>BODY</div><div class=sidebar><p>Popular, posts.</p></div></body>",
    "<body><div class='c'>BODY<div class=comments><p>I disagree, strongly, and at length, as you see.</p></div></div></body>",
    "<body><header><h2>Site</h2></header><div>BODY</div><form><p>Name, please.</p></form><aside>More</aside></body>",
    "<body><script>var a='</p>';</script><!-- <p>no</p> --><div>BODY<style>p{}</style></div><div role=banner>Top</div></body>",
    "<div><section>BODY</section></div><div class='adBox advert'>Buy now, cheap, good, today!</div>",
])
def test_article_alone(around):
    assert main_text(page(around)) == WANT


@pytest.mark.parametrize("given, want", [
    (None, ""), ("", ""), ("  ", ""), ("<script>only</script>", ""), ("plain  text\n here", "plain text here"),
    ("<p>a<p>b", "a b"), ("<ul><li>x<li>y</ul>", "x y"), ("<p>a<br>b</p>", "a b"), ("a &amp;amp; b &lt;c&gt;", "a &amp; b <c>"),
    ("<p>one</b> two</p></div>", "one two"), ("<p>x<!-- unclosed", "x"), ("<p>1 < 2</p>", "1 < 2"),
    ("<p title='a>b'>t</p>", "t"), ("<p>a<select><option>o", "a o"), ("<p>a<script>x", "a"),
])
def test_small_pages(given, want):
    assert main_text(given) == want


def test_long_and_deep_pages_end():
    began = time.time()
    assert main_text("<p>" + "word, " * 300_000 + "</p>").count("word") == 300_000
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert main_text("<svg>" * 50_000 + "<b>" * 5000 + "1 < " * 20_000).startswith("1 <")
    assert time.time() - began < 60


def test_query_rows(spark):
    rows = [(1, "u", page("<article>BODY</article>"), "own"), (2, None, None, None), (2, "u", "", "x"), (None, "v", "<p>é😀</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted(
        [(1, WANT, len(WANT)), (2, "", 0), (2, "", 0), (0, "é😀", 2)])
    assert html_extract(pages.limit(0)).count() == 0


def test_content_in_several_containers_is_whole():
    def words(start, count):
        return " ".join(f"word{k}, and more" for k in range(start, start + count)) + "."

    long, short = words(0, 60), words(100, 14)
    split = f"<div><section><p>{long}</p></section><section><p>{short}</p></section></div>"
    assert main_text(split) == f"{long} {short}"
    assert main_text(f"<body><nav>Menu</nav><main><article><p>{long}</p></article><h2>Part two</h2>"
                     f"<article><p>{short}</p></article></main><footer>c</footer></body>") == f"{long} Part two {short}"
    assert main_text(f"<div><p>{short}</p><ul>{''.join(f'<li>{words(9 * k, 9)}</li>' for k in range(9))}</ul></div>").startswith(short)


def test_unnamed_lists_of_links_are_no_article():
    links = "<ul><li><a href=1>Link one</a><li><a href=2>Link two</a><li>Buy</ul>"
    for around in ("<div>BODYLINKS</div>", "<div>LINKSBODY</div>", "<article>BODY<div>LINKS</div></article>"):
        assert main_text(page(around).replace("LINKS", links)) == WANT
    items = "<ul><li>Salt<li>Two eggs<li>Flour, <a href=3>sifted</a></ul>"
    assert main_text(page(f"<article>BODY{items}</article>")) == f"{WANT} Salt Two eggs Flour, sifted"
    assert main_text(f"<div><h1><a href=4>Linked title</a></h1><p>{FIRST}</p></div>") == f"Linked title {FIRST}"


def test_deep_pages_take_little_memory():
    tracemalloc.start()
    assert main_text("<div>" * 200_000 + "deep") == "deep"
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def slow_content(paths, texts):
    """Content paths by plain loops: sums per path, a Gaussian over the two nodes on each side, their product."""
    marks = [sum(c in ".,;:!?…。、，！？；：" for c in t) for t in texts]
    weights = [math.exp(-k * k / 2) for k in range(-2, 3)]

    def smoothed(values):
        mean = {p: sum(v for v, q in zip(values, paths) if q == p) / paths.count(p) for p in paths}
        return [sum(w * mean[paths[min(max(i + k, 0), len(paths) - 1)]] for k, w in zip(range(-2, 3), weights)) / sum(weights)
                for i in range(len(paths))]

    node = [a * (b + .1) for a, b in zip(smoothed([len(t) for t in texts]), smoothed(marks))]
    fused = [sum(v for v, q in zip(node, paths) if q == p) / paths.count(p) for p in paths]
    total = sum(map(len, texts))
    mean = sum(f * len(t) for f, t in zip(fused, texts)) / total
    spread = math.sqrt(sum((f - mean) ** 2 * len(t) for f, t in zip(fused, texts)) / total)
    return [f >= mean - .5 * spread - 1e-9 for f in fused]


def test_ratios_match_plain_loops():
    draw = random.Random(5)
    for _ in range(50):
        n = draw.randrange(1, 40)
        paths = [draw.randrange(5) for _ in range(n)]
        texts = ["a, b. c" * draw.randrange(1, 30) if p < 2 else "menu" * draw.randrange(1, 4) for p in paths]
        assert content_nodes(paths, texts).tolist() == slow_content(paths, texts)
