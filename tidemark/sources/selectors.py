"""Selectors over parsed pages, and page readers that fall back from one to the next.

A selector is steps apart by blanks, each inside the one before: a tag, ``#id``, ``.class``, ``[attr]``, ``[attr=x]`` or
``[attr*=x]``, or several of them together; commas part alternatives. A cascade is a tuple of selectors of which the
first that finds anything counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.udf import arrow_udf
from tidemark.sources.pages import Node, _flat, tree

_STEP = re.compile(r"""(?P<tag>[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)['"]?(?P<value>[^'"\]]*)['"]?)?\]""", re.X)


@lru_cache(256)
def compiled(selector: str) -> list[list[list[dict]]]:
    """Alternatives of steps of conditions; an error for what is no selector."""
    out = []
    for one in selector.split(","):
        steps = []
        for step in one.split():
            found = list(_STEP.finditer(step))
            if "".join(m.group() for m in found) != step:
                raise ValueError(f"no selector: {selector}")
            steps.append([m.groupdict() for m in found])
        out.append(steps)
    return out


def _meets(node: Node, step: list[dict]) -> bool:
    for c in step:
        value = node.attrs.get(c["attr"]) if c["attr"] else None
        if c["tag"]:
            ok = node.tag == c["tag"]
        elif c["id"]:
            ok = node.attrs.get("id") == c["id"]
        elif c["cls"]:
            ok = c["cls"] in node.attrs.get("class", "").split()
        elif not c["op"]:
            ok = value is not None
        else:
            ok = value is not None and (value == c["value"] if c["op"] == "=" else c["value"] != "" and c["value"] in value)
        if not ok:
            return False
    return True


def _reached(node: Node, steps: list[list[dict]], top: Node) -> bool:
    if not _meets(node, steps[-1]):
        return False
    rest, up = len(steps) - 2, node.parent
    while rest >= 0 and up is not None:  # the nearest fitting ancestor is the best for each step
        if _meets(up, steps[rest]):
            rest -= 1
        up = up.parent
    return rest < 0


def select(top: Node, selector: str):
    """The nodes below ``top`` that the selector finds, in the page's order."""
    ways = compiled(selector)
    return (n for n in top.walk() if n is not top and any(_reached(n, w, top) for w in ways))


def first(top: Node, *cascade: str) -> Node | None:
    return next((n for s in cascade for n in select(top, s)), None)


def said(node: Node | None) -> str:
    return _flat(node.text(" ")) if node is not None else ""


#: Where cards of products keep their parts, and what addresses products have.
CARD, SKU_URL = "div[data-sku]", "https://item.jd.com/{}.html"
TITLE = ("[class*='title'][title]", "[class*='title']", "h5[title]", "h5")
COMMENT, SHOP = "[class*='comment'], .p-commit a", "[class*='shop'], .hd-shopname, .p-shop a"
PRODUCT_LINK, SITE, UP = "a[href*='item.jd.com'], a[href*='item.m.jd.com']", "https://www.jd.com/", 6
#: Lists and containers of notices.
LIST, LIST_TITLE, LIST_DATE = ("div.sj_e_tonzhi_list ul#div", "ul#div"), "span.sj_gztzle", "span.sj_gztzri"
CONTAINERS = ("div.TRS_Editor", "#zoom", "div.con-content", "div.content")


def price_in(text: str) -> float | None:
    """The number after a currency sign, which may have blanks about its point, else the first number."""
    marked = re.search(r"[¥￥]\s*(\d+(?:\s*\.\s*\d+)?)", text)
    plain = re.search(r"\d+(?:\.\d+)?", re.sub(r"\s+", "", marked.group(1) if marked else text.replace(",", "")))
    return float(plain.group()) if plain else None


def items_of(html: str | None, most: int = 300) -> list[dict]:
    """Products of a page: its cards, or where it has none with title and price, its anchors to products; each address once."""
    root, out = tree(html), {}

    def add(url: str, title: str, text: str, comment: str, shop: str, by: str) -> None:
        if url and title and url not in out and len(out) < most and (price := price_in(text)) is not None:
            out[url] = {"url": url, "title": title, "price": price, "comment": comment, "shop": shop, "extractor": by}

    for card in select(root, CARD):
        if sku := _flat(card.attrs["data-sku"]):
            named = first(card, *TITLE)
            title = _flat(named.attrs.get("title") or said(named)) if named is not None else ""
            add(SKU_URL.format(sku), title, said(first(card, "[class*='price']")) or said(card), said(first(card, COMMENT)), said(first(card, SHOP)), "card")
    for a in () if out else select(root, PRODUCT_LINK):
        around = a
        for _ in range(UP):
            around = around.parent or around
        add(urljoin(SITE, _flat(a.attrs["href"])), _flat(a.attrs.get("title", "")) or said(a), said(around), "", "", "anchor")
    return list(out.values())


def notices_of(html: str | None, base: str | None, lists: Sequence[str] = LIST) -> list[dict]:
    """(title, url, pub_time) of a list's items: the marked title, else the anchor's text; the marked date, else the first in the item."""
    box, out = first(tree(html), *lists), []
    for li in select(box, "li") if box is not None else ():
        a = first(li, "a")
        title = said(first(a, LIST_TITLE)) or said(a) if a is not None else ""
        href = _flat(a.attrs.get("href", "")) if a is not None else ""
        if title and href:
            day = re.search(r"\d{4}-\d{2}-\d{2}", said(li))
            out.append({"title": title, "url": urljoin(base or "", href), "pub_time": said(first(a, LIST_DATE)) or (day.group() if day else "")})
    return out


def article_of(html: str | None, containers: Sequence[str] = CONTAINERS) -> dict:
    """(title, content, full): paragraphs of the first container that is there, else its text, else the page's.

    ``full`` is the page's text with a line for each piece, from which ``pages.meta`` reads time, author and source.
    """
    root = tree(html)

    def lines(node: Node) -> str:
        return "\n".join(x for t in node.text("\n").split("\n") if (x := _flat(t)))

    box = first(root, *containers)
    paragraphs = [t for p in select(box, "p") if (t := said(p))] if box is not None else []
    return {"title": said(first(root, "h1")), "content": "\n".join(paragraphs) or lines(box or root), "full": lines(root)}


@arrow_udf("array<struct<url:string,title:string,price:double,comment:string,shop:string,extractor:string>>")
def items(html: pd.Series) -> pd.Series:
    return html.map(items_of)


@arrow_udf("array<struct<title:string,url:string,pub_time:string>>")
def notices(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([notices_of(h, b) for h, b in zip(html, base)], dtype=object)


def article(html: Column | str, containers: Sequence[str] = CONTAINERS) -> Column:
    """struct(title, content, full) of ``article_of``; a null page gives empty texts."""
    @F.pandas_udf("struct<title:string,content:string,full:string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_of(p, containers) for p in pages], columns=["title", "content", "full"])

    return read(html)


def first_of_url(rows: DataFrame, url: str, *order: str) -> DataFrame:
    """The first row of each address in the given order, across pages: one aggregate; ties go to the least row."""
    names = rows.columns
    row = F.struct(*(F.col(c) for c in names))
    best = rows.groupBy(F.col(url).alias("__key")).agg(F.min_by(row, F.struct(*(F.col(c) for c in (*order, *sorted(names))))).alias("__row"))
    return best.select(*(F.col("__row").getField(c).alias(c) for c in names))
