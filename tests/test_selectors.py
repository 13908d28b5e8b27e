"""Selectors, cascades and first-wins addresses."""

import pytest

from tidemark.sources import pages as P
from tidemark.sources import selectors as L
from tidemark.sources.pages import tree

PAGE = "<div class='a b'><ul id='u'><li class='x'>1</li><li data-k='abc'>2</li></ul></div><ul><li>3</li></ul>"


@pytest.mark.parametrize("selector, texts", [("li", "123"), ("ul#u li", "12"), ("div.b li", "12"), ("div.a.b li.x", "1"), ("[data-k]", "2"), ("li[data-k*='b']", "2"), ("li[data-k=b]", ""), (".x, [data-k]", "12"), ("div ul div li", ""), ("p", "")])
def test_select(selector, texts):
    assert "".join(n.text() for n in L.select(tree(PAGE), selector)) == texts


def test_errors():
    with pytest.raises(ValueError):
        list(L.select(tree(PAGE), "li > a"))


def test_cascade():
    assert L.first(tree(PAGE), "p", "li.x", "li").text() == "1"
    assert L.article_of("<h1>T</h1><div class='content'>no<p> </p></div><div id='zoom'><p>a</p><p>b  c</p></div>") == {"title": "T", "content": "a\nb c", "full": "T\nno\na\nb c"}
    assert L.article_of("<div class='content'>plain<br>text</div>tail")["content"] == "plain\ntext"
    assert L.article_of("<b>only</b> text")["content"] == "only\ntext"
    assert L.article_of(None) == L.article_of("") == {"title": "", "content": "", "full": ""}


def test_items():
    many = "".join(f"<div data-sku='{i}'><h5>t</h5>¥{i}</div>" for i in range(400))
    assert [x["price"] for x in L.items_of(many)] == [float(i) for i in range(300)]
    assert L.items_of(None) == L.notices_of(None, None) == []
    assert L.price_in("约 1,234.5元") == 1234.5 and L.price_in("x") is None


def test_first_of_url(spark):
    rows = spark.createDataFrame([("u", 2, "b"), ("u", 1, "c"), ("u", 1, "a"), (None, 5, None), ("v", 3, None)], "url string, page_id int, title string")
    assert sorted(map(str, (tuple(r) for r in L.first_of_url(rows, "url", "page_id").collect()))) == sorted(map(str, [("u", 1, "a"), (None, 5, None), ("v", 3, None)]))
    assert L.first_of_url(rows.limit(0), "url", "page_id").count() == 0


def test_references_without_a_semicolon_stay():
    page = "<h1>A&amp;&amp b &lt; &quot &#39;&#39 &nosuch; &ampx;</h1><article><p>x &amp;amp y &amp</p></article>"
    want = "A&&amp b < &quot '&#39 &nosuch; &ampx;"
    found = L.article_of(page, ("article",))
    assert (found["title"], found["content"]) == (want, "x &amp y &amp")
    assert P.links_of("<li><a href='/a?b=1&copy=2'>t &lt</a></li>", "http://h") == [{"title": "t &lt", "url": "http://h/a?b=1&copy=2"}]
