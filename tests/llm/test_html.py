"""Main text of pages: known layouts, held-out composed pages and the table's own pages."""

import re
from html import unescape

from riskweave.llm import html_blocks, html_labels, html_text

PAIR = None


def extract(html):
    weights, moves = html_text.model()
    return html_text.extract(html, [tuple(map(float, w)) for w in weights], moves.tolist())[0]


def test_blocks_decode_and_collapse():
    html = ("<p>a <b>b</b>\n c&amp;d<br>e</p><script>x<p>y</script><!-- no <p>z --><style>p{}</style>"
            "<ul><li>one<li>t&eacute;<a title='a>b'>wo</a></ul>tail < 3")
    assert [b[0] for b in html_blocks.blocks(html)] == ["a b c&d e", "one", "téwo", "tail < 3"]
    assert html_blocks.blocks("<head><title>t</title></head>") == []


def test_viterbi_finds_the_best_of_all_paths():
    import itertools
    scores, moves = [(0.3, 0.1), (0.0, 0.9), (1.2, 0.4), (0.2, 0.25)], [[0.5, -0.7], [-0.4, 0.6]]
    def value(path):
        return (sum(s[y] for s, y in zip(scores, path))
                + sum(moves[a][b] for a, b in zip(path, path[1:])))
    best = max(itertools.product((0, 1), repeat=4), key=value)
    assert html_text.viterbi(scores, moves) == list(best)


def test_held_out_composed_pages():
    weights, moves = html_text.model()
    right = total = 0
    for page in html_labels.labelled_pages(200, seed=1234):
        found = html_blocks.blocks(page)
        scores = [tuple(weights[f].sum(axis=0)) for _, f, _ in found]
        labels = html_text.viterbi(scores, moves.tolist())
        right += sum(label == main for label, (_, _, main) in zip(labels, found))
        total += len(found)
    assert right >= 0.995 * total


def test_usual_parts_are_left_out():
    page = """<html><body><header class="site-header"><a href="/">Site</a></header>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to improve this site. Please accept.</p></div>
    <div class="ad">Buy this wonderful thing now, it is cheap.</div>
    <main><article><h1>A title of some words</h1><p>First paragraph, with text. And more of it.</p>
    <p>Second one &amp; its <a href="#">link</a>.</p></article></main>
    <form><label>Your name</label><input><button>Send</button></form>
    <aside class="sidebar"><h3>Related</h3><p>Another story, which is told here briefly.</p></aside>
    <section id="comments"><div class="comment"><p>I do not agree, this is wrong.</p></div></section>
    <footer>&copy; Site 2020. All rights reserved.</footer></body></html>"""
    assert extract(page) == ("A title of some words First paragraph, with text. And more of it. "
                             "Second one & its link .".replace("link .", "link."))


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.main_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_edge_pages(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>"), (2, "u", "plain text only"),
            (3, "u", "<" * 500), (4, "u", "<p class='" + "x" * 3000), (5, "u", "<div>" * 3000 + "deep"),
            (6, "u", "<article><p>" + "word " * 60000 + ".</p></article>"), (7, "u", "&#0;&bogus;&lt;")]
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "page_id long, url string, html string, text string")
    got = html_text.main_texts(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 1} == {""}
    assert max(r.n_chars for r in got) == 5 * 60000 + 1
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_head_without_end_tag():
    texts = lambda html: [b[0] for b in html_blocks.blocks(html)]
    head = "<html><head>\n<meta charset=utf-8><link href=x><title>t</title>\n<style>p{}</style> "
    assert texts(head + "<h1>One</h1><p>Two</p>") == ["One", "Two"]
    assert texts(head + "plain <b>text</b>") == ["plain text"]
    assert texts(head + "only text") == ["only text"]
    assert texts(head + "<noscript><link href=y></noscript><script>z</script></head>\n<p>b") == ["b"]
    assert texts(head) == []


def test_svg_that_closes_itself():
    texts = lambda html: [b[0] for b in html_blocks.blocks(html)]
    assert texts("<p>a</p><svg class='>' /><p>b</p><svg/><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><svg><g/><text>x</text></svg><p>b</p><svg a='/'>y</svg>c") == ["a", "b", "c"]


def test_comments_end_as_browsers_end_them():
    texts = lambda html: [b[0] for b in html_blocks.blocks(html)]
    assert texts("<p>a</p><!--><p>b</p><!---><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><!-- x --!><p>b</p><!-- <p>no</p> > -->c") == ["a", "b", "c"]
    assert texts("<p>a</p><!---- ><p>no</p>--><p>b</p><!-- open <p>no</p>") == ["a", "b"]


def test_nested_templates_show_nothing():
    texts = lambda html: [b[0] for b in html_blocks.blocks(html)]
    page = "<p>a</p><template><p>x</p><template>y</template><div>z</div></template><p>b</p>"
    assert texts(page) == ["a", "b"]
    assert texts("t<template>x") == ["t"] and texts("</template><p>a</p>") == ["a"]
    assert texts("<head><template>x</template></head><p>a</p>") == ["a"]


def test_many_unmatched_end_tags_take_linear_time():
    import time
    start = time.perf_counter()
    assert html_blocks.blocks("<b>" * 100_000 + "</i>" * 100_000 + "x")[0][0] == "x"
    assert html_blocks.blocks("<i><p>" * 50_000 + "</q>" * 50_000 + "y")[-1][0] == "y"
    assert time.perf_counter() - start < 10
