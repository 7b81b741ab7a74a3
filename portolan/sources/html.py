"""Tables in HTML pages, read in each task with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _FirstTable(HTMLParser):
    """Cells of the first table, or of the first with a given id; inner tables count as text."""

    def __init__(self, wanted: str | None, container: str, row: str, cell: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.container, self.row_tag, self.cell_tags = container, row, cell
        self.wanted, self.depth, self.done, self.cells, self.row, self.column, self.open = wanted, 0, False, [], -1, -1, False

    def handle_starttag(self, tag, attrs):
        if tag == self.container and not self.done and (self.depth or self.wanted is None or dict(attrs).get("id") == self.wanted):
            self.depth += 1
        elif self.depth == 1 and tag == self.row_tag:
            self.row, self.column, self.open = self.row + 1, -1, False
        elif self.depth == 1 and tag in self.cell_tags:
            self.row, self.column, self.open = max(self.row, 0), self.column + 1, True
            self.cells.append([self.row, self.column, ""])

    def handle_endtag(self, tag):
        if tag == self.container and self.depth:
            self.depth -= 1
            self.done = self.done or not self.depth
        elif tag in self.cell_tags and self.depth == 1:
            self.open = False

    def handle_data(self, data):
        if self.depth and self.open:
            self.cells[-1][2] += data


def first_tables(pages: DataFrame, key: str, html: str, table_id: str | None = None, container: str = "table", row: str = "tr", cell: tuple[str, ...] = ("td", "th")) -> DataFrame:
    """key, row, column, text (single spaces) for each cell of each page's table; pages without one give no rows."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, page in zip(pdf[key], pdf[html]):
                parser = _FirstTable(table_id, container, row, cell)
                parser.feed(page or "")
                out += [(k, r, c, " ".join(t.split())) for r, c, t in parser.cells]
            yield pd.DataFrame(out, columns=[key, "row", "column", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, row int, column int, text string")
