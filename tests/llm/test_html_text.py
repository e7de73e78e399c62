import html as entities
import itertools
import math
import re

import numpy as np
import pytest

from llm.html_text import Dom, extract, extract_text, marginals, op5_tree_marginals, read_page, train


def brute(page):
    """The article of a page of the test tables, by their fixed layout."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not m:
        return ""
    body = re.sub(r"</?(?:p|h1|h2|li|ul)>", "\n", re.sub(r"<[^>]*$", "", m[1]))
    lines = re.sub(r"<[^>]+>", "", body.replace("<br>", " ")).split("\n")
    return "\n".join(" ".join(entities.unescape(x).split()) for x in lines if x.strip())


def test_query(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op5_tree_marginals(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_sum_product_is_exact(model):
    dom, _, features = read_page("<body><nav><ul><li><a href=x>A</a></li></ul></nav><div><h1>T</h1><p>Some words, and more.</p></div><footer>f</footer>")
    n = len(dom.tag)
    assert n <= 10
    evidence = sum(model["features"][k][:, features[:, k]] for k in range(features.shape[1]))
    weight = np.zeros((n, 2))
    for y in itertools.product((0, 1), repeat=n):
        s = model["root"][y[0]] + sum(evidence[y[i], i] for i in range(n)) + sum(model["pair"][y[dom.parent[i]], y[i]] for i in range(1, n))
        for i in range(n):
            weight[i, y[i]] += math.exp(s)
    want = weight[:, 1] / weight.sum(axis=1)
    assert np.allclose(marginals(dom.parent, features, model), want)


def test_pages_without_an_article(model):
    page = """<body><header><h1>Site</h1></header><div class="sidebar"><p>Other long text here, with commas, and more. Yes.</p></div>
    <div id="content"><h2>Title</h2><p>A long paragraph of text,\n which is   the main one. It has two sentences.</p><aside>Aside text.</aside></div>
    <div class="cookie-notice"><p>We use cookies, as everyone does.</p></div><form><p>Name, address.</p></form>
    <div class="comments"><p>I liked this, thank you. Really nice.</p></div><script>var x = "<p>no</p>";</script></body>"""
    assert extract_text(page, model) == "Title\nA long paragraph of text, which is the main one. It has two sentences."


def test_odd_markup(model):
    text = "A sentence that is long enough, and then some more of it."
    assert extract_text(f"<article><p>{text} &amp; &eacute;&#33; &am", model) == f"{text} & é! &am"
    assert extract_text(f"<article><p>{text}<p>{text}</p", model) == f"{text}\n{text}"
    assert extract_text(f"</div></p><article><p>{text}</article></article></b>", model) == text
    assert extract_text(None, model) == extract_text("", model) == extract_text("<", model) == ""
    assert extract_text("<div>" * 20_000 + f"<article><p>{text}", model).endswith(text)
    assert len(Dom("</x>" * 20_000 + "<p>" * 20_000).tag) > 2


def test_edge_rows(spark, model):
    pages = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "plain words", "z"), (2, "plain words", "z")], "page_id long, html string, label string")
    rows = extract(pages, model).collect()
    assert len(rows) == 4 and rows[0].text == "" and rows[0].n_chars == 0
    assert extract(pages.limit(0), train(pages.limit(0))).count() == 0
