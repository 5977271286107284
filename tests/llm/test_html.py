import html as escape
import re
import time

import pytest

from rillflow.llm import html, queries

from .helpers import SMALL

P = "<p>A paragraph with some words, a comma, and enough length to count as one, number {}.</p>"
BODY = "".join(P.format(n) for n in range(4))
WANT = "\n".join(f"A paragraph with some words, a comma, and enough length to count as one, number {n}." for n in range(4))
NOISE = "<nav><a href='/'>Home</a></nav><div class='ad'>Buy, buy, buy, this, now, it is cheap, very cheap, indeed.</div><!-- <p>no</p> -->"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p></p><br>", ""), ("just &lt;text&gt; &amp;c", "just <text> &c"),
        (f"<html><body>{NOISE}<article><h1>Title</h1>{BODY}</article><footer>&copy; me</footer></body></html>", "Title\n" + WANT),
        (f"<body>{NOISE}<div id=wrap><div class='post'>{BODY}</div><div class='sidebar'>{BODY}</div></div></body>", WANT),
        (f"<div><section>{BODY}</section><section>{BODY}</section><div class=comments>{BODY}</div></div>", WANT + "\n" + WANT),
        (f"<main>{BODY}<form><p>Name, address, and more, please, thank you.</p></form><aside>{BODY}</aside></main>", WANT),
        (f"<article>{BODY}<div class='user-comments'>{BODY}</div><article class='comment'>{BODY}</article></article>", WANT),
        (f"<div role='alert'>{BODY}</div><div hidden>{BODY}</div><div>{BODY}</div>", WANT),
        ("<article><p>one<p>two <b>bold<br><p>three</article>", "one\ntwo bold\nthree"),
        ("<article><ul><li>a&nbsp; b<li>c</ul><table><tr><td>x<td>y<tr><td>z</table></article>", "a b\nc\nx\ny\nz"),
        ("<article><p>if (a < b && c > d) <script>var t='</p>';</script>ok</p><style>p{}</style></article>", "if (a < b && c > d) ok"),
        ("<article><p>unclosed <script> everything is script </article>", "unclosed"),
        ("<article><p>x <a title='>'>link</a> y <i>z</p></article>tail", "x link y z"),
        ("<ARTICLE><P>Upper\n\tcase</P></ARTICLE>", "Upper case"),
        ("<div>" * 3000 + BODY, WANT),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "mine"), (1, "u", f"<article>{BODY}</article>", "mine"), (2, None, None, None), (3, "v", "<article>" + P.format(1) * 20000 + "</article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = html.extracted(pages)
    assert got.columns == ["page_id", "url", "html", "Text", "text_"]
    out = sorted((r.page_id, r.text_) for r in got.collect())
    assert out[:3] == [(1, WANT), (1, WANT), (2, "")] and out[3][1].count("\n") == 19999
    assert html.extracted(pages.limit(0)).count() == 0


def test_query_on_pages_with_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op10_html(spark, SMALL).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(escape.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("piece", ["<div>some text, here", "<span>some text, here", "<p>x<b>y</div></i>", "<table><div>x, y", "<li><p>x"])
def test_deep_and_unclosed_markup_takes_time_in_proportion(piece):
    began = time.process_time()
    found = html.main_text(piece * 4000)
    assert time.process_time() - began < 1 and found


def test_letters_whose_lower_case_is_longer():
    assert html.main_text("<article><p>İİİİ one</p><script>İ</script><p>two</p></article>") == "İİİİ one\ntwo"
