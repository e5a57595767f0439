"""HTML pages as a table of nodes in document order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCHEMA = "page_id long, pos int, end int, parent int, depth int, tag string, cls string, text string"


class Nodes(HTMLParser):
    """Elements and text with their place, the place after their last descendant, and their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, cls: str | None, text: str | None) -> None:
        self.rows.append([len(self.rows), len(self.rows) + 1, self.open[-1] if self.open else -1, len(self.open), tag, cls, text])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._add(tag, dict(attrs).get("class"), None)
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[i][4] == tag for i in self.open):
            while self.open and self.rows[self._close()][4] != tag:
                pass

    def _close(self) -> int:
        at = self.open.pop()
        self.rows[at][1] = len(self.rows)
        return at

    def handle_data(self, data: str) -> None:
        self._add("#text", None, data)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.rows


def html_nodes(pages: DataFrame) -> DataFrame:
    """SCHEMA for every node of pages (page_id, html); null html has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = Nodes()
                parser.feed(html or "")
                rows += [(page, *r) for r in parser.finish()]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "end", "parent", "depth", "tag", "cls", "text"])

    return pages.select("page_id", "html").mapInPandas(parse, SCHEMA)
