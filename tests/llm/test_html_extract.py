import html
import re

import pyarrow.parquet as pq

from outline_ledger.llm.html_extract import content_paths, extract_text, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li>Menu, long. With. Points.</ul></nav><div class="cookie-notice">We use cookies, yes.</div><div id=content><h2>Title</h2>
<p>First, with <b>bold <a href=x>link</a>; and more.<p>Second &amp; third&#33;<ul><li>one<li>two</ul><div class="ad banner">Buy! Buy, now.</div></div>
<aside>Side, text. More.</aside><form><p>Sign up, please.</form><section class=comments><article class=comment><p>No, never.</article></section>
<footer>&copy; me</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_article_parts():
    assert main_text(PAGE) == "Title First, with bold link; and more. Second & third! one two"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p><!-- x") == ""
    assert main_text("only text") == "only text"
    assert main_text("<p>a < b<p>c</b></div> d") == "a < b c d"
    assert main_text("<nav>menu<article><p>Never closed, above.</article>") == "Never closed, above."
    assert main_text("<article><p>" + "word, " * 50_000 + "</article>").count("word") == 50_000


def test_link_lists_go():
    blocks = [("/body/div/p", "A long sentence, with marks; and more.", 0, False)] * 5 + [("/body/ul/li", "Home", 4, False)] * 9
    assert content_paths(blocks) == {"/body/div/p"}


def test_all_pages_of_the_table(spark):
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in extract_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"<(?:/?p|/?h1|br)>", inner))
        want = " ".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>Hi.", "y")],
                               "page_id bigint, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in extract_text(df).collect()) == [(0, "Hi."), (1, ""), (1, "")]
    assert extract_text(df.where("false")).count() == 0
