"""HTML pages as rows: tables, cards, sections, link lists and clean text.

Pages are parsed by Arrow-batched functions over an html column; each returns an array of structs that the caller
explodes, so parsing runs where the pages are and nothing is collected.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without an end tag, chrome that is no content, and elements that start a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CHROME = {"script", "style", "nav", "footer", "header", "noscript", "form", "svg", "aside", "head", "template"}
BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "br", "blockquote", "pre"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: "Node | None"):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self):
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def all(self, *tags: str, cls: str | None = None) -> "list[Node]":
        return [n for n in self.walk() if n is not self and (not tags or n.tag in tags) and (cls is None or cls in (n.attrs.get("class") or "").split())]

    def text(self, skip: set[str] = frozenset({"script", "style"})) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack.extend(reversed(node.kids))
        return " ".join("".join(out).replace("\xa0", " ").split())


class _Builder(HTMLParser):
    CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in self.CLOSES.get(tag, ()):
            while self.at.tag in self.CLOSES[tag]:
                self.at = self.at.up
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def links(node: Node) -> list[dict]:
    return [{"url": a.attrs["href"], "label": a.text() or (a.up.text() if a.up else "")} for a in node.all("a") if a.attrs.get("href")]


def _rows(table: Node) -> list[list[Node]]:
    return [[k for k in tr.kids if isinstance(k, Node) and k.tag in ("td", "th")] for tr in table.all("tr")]


LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())])
TABLE_ROW = T.StructType([T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(LINK)), T.StructField("is_header", T.BooleanType())])
CARD = T.StructType([T.StructField("title", T.StringType()), T.StructField("is_group", T.BooleanType()), T.StructField("group_count", T.IntegerType()), T.StructField("published_date_raw", T.StringType()), T.StructField("file_size", T.StringType()), T.StructField("link", T.StringType())])
SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("url", T.StringType()), T.StructField("label", T.StringType()), T.StructField("size", T.StringType())])


def _arrays(kind: T.DataType, one):
    @F.pandas_udf(T.ArrayType(kind))
    def run(pages):
        return pages.map(lambda p: one(parse(p)))

    return run


def _table_rows(root: Node) -> list[dict]:
    out = []
    for t, table in enumerate(root.all("table")):
        for r, cells in enumerate(_rows(table)):
            if cells:
                out.append({"table_no": t, "row_no": r, "cells": [c.text() for c in cells], "links": [x for c in cells for x in links(c)], "is_header": all(c.tag == "th" for c in cells)})
    return out


def _cards(root: Node, box: str = "announcementbox") -> list[dict]:
    out = []
    for card in root.all("div", cls=box):
        first = lambda *tags, cls: next(iter(card.all(*tags, cls=cls)), None)  # noqa: E731, B023
        icon, title, count, day = first("span", cls="material-symbols-outlined"), first("p", cls="mb-0"), first("div", cls="counter-box"), first("small", cls="ptype")
        size = next((s for d in card.all("div", cls="type-size") for s in d.all("small") if s.attrs.get("aria-label") and s is not day), None)
        group = bool(icon) and icon.text() == "file_copy"
        pdf = next((a for a in card.all("a") if (a.attrs.get("id") or "").startswith("btn-") and a.attrs.get("type") == "pdf"), None)
        link = first("a", cls="download-btn") if group else pdf or first("a", cls="download-btn")
        n = count.text() if count else ""
        out.append({"title": title.text() if title else "", "is_group": group, "group_count": int(n) if n.isdigit() else None, "published_date_raw": day.attrs.get("aria-label") if day else None, "file_size": size.attrs.get("aria-label") if size else None, "link": link.attrs.get("href") if link else None})
    return out


def _sections(root: Node) -> list[dict]:
    out, heading = [], None
    for n in root.walk():
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = n.text()
        elif n.tag == "a" and n.attrs.get("href") and heading is not None:
            label = n.text()
            size = re.search(r"\(?\s*(\d+(?:\.\d+)?\s*[KMG]B)\s*\)?", label, re.I)
            out.append({"heading": heading, "url": n.attrs["href"], "label": (label.replace(size[0], " ") if size else label).strip(), "size": size[1] if size else None})
    return out


def clean(root: Node, boilerplate: tuple[str, ...] = ()) -> str:
    """Text without chrome, one line a block, blank lines collapsed, boilerplate lines dropped."""
    out: list[str] = []

    def put(node):
        stack = [node]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(re.sub(r"\s+", " ", k.replace("\xa0", " ")))
            elif k.tag not in CHROME:
                mark = ["\n"] if k.tag in BLOCKS else []
                stack.extend([*mark, *reversed(k.kids)])
                out.extend(mark)

    for k in root.kids:
        put(k) if isinstance(k, Node) else out.append(k)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n")]
    lines = [x for x in lines if not any(b in x.lower() for b in boilerplate)]
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(\n\s*)+\n", "\n", "\n".join(lines))).strip()


table_rows = _arrays(TABLE_ROW, _table_rows)
cards = _arrays(CARD, _cards)
sections = _arrays(SECTION, _sections)
page_links = _arrays(LINK, links)


@F.pandas_udf(T.StringType())
def clean_text(pages):
    """Readable text of pages; null for null."""
    return pages.map(lambda p: clean(parse(p)), na_action="ignore")


def table(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row a table row: positional cells and links."""
    return pages.select(*(keep or [c for c in pages.columns if c != html]), F.explode(table_rows(F.col(html))).alias("r")).select(*(keep or [c for c in pages.columns if c != html]), "r.*")


def by_header(rows: DataFrame, page: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Cells by the header that names them: for each name the first column whose header holds one of its aliases.

    Headers are a row a table; they join the rows of their own table and page.
    """
    heads = rows.filter("is_header").groupBy(page, "table_no").agg(F.min(F.struct("row_no", "cells")).alias("h")).select(page, "table_no", F.transform("h.cells", F.lower).alias("heads"))
    body = rows.filter("NOT is_header").join(heads, [page, "table_no"])

    def cell(words: list[str]) -> Column:
        hit = F.transform("heads", lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w)))
        return F.when(F.array_position(hit, True) > 0, F.get(F.col("cells"), (F.array_position(hit, True) - 1).cast("int")))

    return body.select(page, "table_no", "row_no", "links", *(cell(words).alias(name) for name, words in aliases.items()))


def carried(rows: DataFrame, page: str) -> DataFrame:
    """Rows with the section of the single-cell row above them; the section rows themselves are left out."""
    head = F.when(F.size("cells") == 1, F.col("cells")[0])
    w = Window.partitionBy(page, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(head, ignorenulls=True).over(w)).filter(F.size("cells") > 1)


def one_per_link(rows: DataFrame, page: str) -> DataFrame:
    """One row a link of a table row; a link seen earlier on the page is skipped."""
    from ..operators.dedup import one_per_key

    out = rows.select(page, "table_no", "row_no", "cells", F.posexplode("links").alias("link_no", "l")).select(page, "table_no", "row_no", "link_no", "cells", "l.*")
    return one_per_key(out, [page, "url"], ["table_no", "row_no", "link_no"])


def unpivoted(rows: DataFrame, page: str, title_cell: int = 0) -> DataFrame:
    """One row a document column: the title cell with the column's header."""
    heads = rows.filter("is_header").groupBy(page, "table_no").agg(F.min(F.struct("row_no", "cells")).alias("h")).select(page, "table_no", F.col("h.cells").alias("heads"))
    out = rows.filter("NOT is_header").join(heads, [page, "table_no"]).select(page, "table_no", "row_no", "heads", F.col("cells")[title_cell].alias("name"), F.posexplode("cells").alias("i", "value"))
    return out.filter(F.col("i") != title_cell).select(page, "table_no", "row_no", "i", F.concat_ws(" - ", "name", F.get("heads", "i")).alias("title"), "value")


def hubs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links of pages without a table: the next pages to read. Callers keep the visited ones and stop at depth 1."""
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, table_rows(F.col(html)).alias("t"), page_links(F.col(html)).alias("l")).filter(F.size("t") == 0)
    return rows.select(*keep, F.explode("l").alias("x")).select(*keep, "x.*").distinct()
