import re
from collections import defaultdict

import pandas as pd

from evalgate.llm import html_text

from .helpers import rows_of

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def text_of(page):
    return html_text.main_text(page, [])


def test_markup_decides():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">no</a></li></ul></nav><!-- no <p>no</p> --><div class="ad">no</div>
    <article class="post"><header><h1>Caf&eacute; &amp; <i>b</i>ar</h1></header><p>One<b> two</b>
      three&nbsp;four<br>five<p>six <span title="a>b">se</span>ven<div class="share-buttons">no</div><aside>no</aside>
    <form><input>no</form><ul><li>a</li><li>b</li></ul><section id="comments"><p>no</section> 1 < 2 &#x41;</article>
    <div id="cookie-notice">no</div><footer>&copy; no</footer></body></html>"""
    assert text_of(page) == "Café & bar One two three four five six seven a b 1 < 2 A"
    assert text_of("") == "" and text_of("plain   words") == "plain words" and text_of("<p>a<p>b</p></div></b>c") == "a b c"
    assert text_of("<article>open end <b>x") == "open end x" and text_of("<main>m</main><p>o") == "m o"


def test_given_pages_are_their_articles(spark):
    got = html_text.extracted(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).toPandas().set_index("page_id")
    table = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    assert len(got) == len(table)
    for page, source in zip(table.page_id, table.html, strict=True):
        article = re.search("(?s)<article>(.*?)(?:</article>|$)", source)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())
        assert got.text[page] == want and got.n_chars[page] == len(want)


def test_repeated_runs_of_a_host_go(spark):
    bar = "this long bar of words stands on every single page of the host"
    rows = [(i, "http://a.example/x" if i < 30 else f"http://h{i}.example/", f"<div>{bar}</div><div>own{i} text{i} <b>here</b></div>") for i in range(40)]
    rows += [(50, "http://c.example/1", "<p>a whole page that is only copied from another one</p>"), (51, "http://c.example/2", "<p>a whole page that is only copied from another one</p>")]
    rows += [(60, "http://a.example/y", f"<article>{bar}</article><div>{bar} plus</div>"), (61, None, None), (None, "x", "<p>no id"), (62, "http://a.example/", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages(spark, rows)).collect()}
    assert all(got[i] == f"own{i} text{i} here" for i in range(30))
    assert all(got[i] == f"{bar} own{i} text{i} here" for i in range(30, 40))
    assert got[50] == got[51] == "a whole page that is only copied from another one"
    assert got[60] == f"{bar} plus" and got[61] == "" and got[62] == "" and got[None] == "no id"


def test_suffix_array_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages_of = defaultdict(set)
    for page, url, source in table.select("page_id", "url", "html").collect():
        for _, suffix in html_text.suffixes(html_text.stream(html_text.blocks(source))[0]):
            pages_of[(html_text.host_of(url), suffix)].add(page)
    want = {k for k, v in pages_of.items() if len(v) > 1}
    array = html_text.suffix_array(table)
    assert array.count() and html_text.repeated(array).distinct().count() == len(want)


def test_clashing_columns_and_empty_table(spark):
    docs = pages(spark, [(1, "http://a.b", "<p>x y"), (1, "http://a.b", "<p>x y")])
    assert rows_of(html_text.extracted(docs.selectExpr("*", "1 AS row", "2 AS places", "3 AS text"))) == [(1, "http://a.b", "x y", 3)] * 2
    assert html_text.extracted(docs.limit(0)).count() == 0
