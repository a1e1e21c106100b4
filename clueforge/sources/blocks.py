"""Blocks of pages as rows: a table function, for DataFrames and SQL, that builds a page's element tree."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements without content, elements whose text is not shown, and elements that end an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template".split())
BLOCKS = set("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
#: Elements that end an open one of the same kind beside them.
SIBLINGS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}}

RETURNS = "page_id string, block int, parent int, depth int, tag string, classes string, words int, text string"


class _Tree(HTMLParser):
    """Open elements as a stack; each block's own text, without that of blocks inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []  # parent, depth, tag, classes, pieces of text
        self.open: list[tuple[str, int]] = []  # tag, and its block or -1

    def _close(self, at: int) -> None:
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        tags = [t for t, _ in self.open]
        if tag in BLOCKS and "p" in tags:
            self._close(len(tags) - 1 - tags[::-1].index("p"))
        elif tag in SIBLINGS:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in SIBLINGS[tag]:
                    break
                if self.open[at][0] in (tag, *(("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else ())):
                    self._close(at)
                    break
        block = -1
        if tag in BLOCKS:
            inside = [b for _, b in self.open if b >= 0]
            block = len(self.blocks)
            self.blocks.append([inside[-1] if inside else None, len(inside), tag, " ".join((dict(attrs).get("class") or "").split()), []])
        if tag not in VOID:
            self.open.append((tag, block))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        if any(t in SILENT for t, _ in self.open):
            return
        for _, block in reversed(self.open):
            if block >= 0:
                self.blocks[block][4].append(data)
                return


def page_blocks(html: str | None) -> Iterator[tuple[int, int | None, int, str, str, str]]:
    """(block, parent, depth, tag, classes, text) of a page's blocks in the order in which they begin; blank ones too."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for place, (parent, depth, tag, classes, pieces) in enumerate(tree.blocks):
        yield place, parent, depth, tag, classes, " ".join("".join(pieces).split())


@F.arrow_udtf(returnType=RETURNS)
class Blocks:
    """SELECT * FROM page_blocks(TABLE(pages)): page_id and html come first; a page with null or no elements has no rows."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        for page, html in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            found = list(page_blocks(html))
            if found:
                place, parent, depth, tag, classes, text = zip(*found, strict=True)
                yield pa.table({
                    "page_id": pa.array([None if page is None else str(page)] * len(found), pa.string()), "block": pa.array(place, pa.int32()), "parent": pa.array(parent, pa.int32()), "depth": pa.array(depth, pa.int32()),
                    "tag": pa.array(tag, pa.string()), "classes": pa.array(classes, pa.string()), "words": pa.array([len(t.split()) for t in text], pa.int32()), "text": pa.array(text, pa.string()),
                })


def register(spark: SparkSession) -> None:
    """Make page_blocks known to SQL."""
    spark.udtf.register("page_blocks", Blocks)


def blocks_of(pages: DataFrame) -> DataFrame:
    """The blocks of pages (page_id, html); see Blocks."""
    register(pages.sparkSession)
    pages.select("page_id", "html").createOrReplaceTempView("_pages_of_blocks")
    return pages.sparkSession.sql("SELECT * FROM page_blocks(TABLE(_pages_of_blocks))")
