import pytest

from loomgraph.llm.html_text import extract, extract_text

CASES = {
    "<p>One<p>Two <b>bold</b>  x<br>next": "One\n\nTwo bold x\nnext",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li value=9>y<li>z</ol>": "3. x\n9. y\n10. z",
    "<table><tr><th>Name<th>Qty<tr><td>Apple juice<td>1</table>": "Name         Qty\nApple juice  1",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide</table>": "a  b\n   c\nwide",
    "a<div>b</div>c": "a\nb\nc",
    "<pre>  x\n   y </pre>": "  x\n   y",
    "<div hidden>n</div><p style='color:red; DISPLAY : none'>n</p><script>var a='<p>';</script>v": "v",
    "<title>t</title><body>&lt;a&gt; &amp;amp; &copy;<!-- c -->": "<a> &amp; ©",
    "x</p>y</div>z": "x\n\nyz",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "a < b and <3": "a < b and <3",
    "unclosed <a href='": "unclosed",
    "<p>a<table><tr><td>1</table>b": "a\n\n1\n\nb",
    "<head><title>T</title>Hello <b>you</b>": "Hello you",
    "<html><head> <title>T</title>\n<style>x</style> Hello<style>y</style> all": "Hello all",
    "": "",
    '<p style="visibility:hidden">no <b style="visibility: visible">yes</b> no</p><p style="visibility:hidden">gone</p>end': "yes\n\nend",
    '<div style="display:none"><b style="visibility:visible">no</b></div>x': "x",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    assert extract(source) == CASES[source]


def test_frame_cases(spark):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, None), (None, "", "x"), (3, "<div>" * 5000 + "deep", "")]
    frame = extract_text(spark.createDataFrame(rows, "page_id long, html string, lines string"))
    assert frame.columns == ["page_id", "lines", "text"]
    assert sorted(r["text"] for r in frame.collect()) == ["", "", "a", "a", "deep"]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
    with pytest.raises(ValueError):
        extract_text(spark.createDataFrame([], "html string, text string"))


def test_every_visible_word_stays(spark):
    """Brute force on the test pages: all words outside of head, script and comments, in order."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for page in pages:
        body = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<!--.*?-->", " ", page["html"])
        words = unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", body)).split()
        assert [w for w in extract(page["html"]).split() if w != "-"] == [w for w in words if w != "-"]
