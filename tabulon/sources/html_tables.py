"""HTML tables from a table of pages.

``pages(page_id, url, html)`` -> one row per table row:
``(page_id, table_idx, row_idx, is_header, cells array<string>)``.

Parsing markup is the one step Spark has no expression for, so it runs in
``mapInPandas`` with the standard-library ``html.parser`` -- per partition,
Arrow batches, no driver involvement.  A JVM-side ``contains('<table')``
filter runs first, so pages without tables never reach Python.  Unclosed
tags, nested tables, ``rowspan``/``colspan`` (with the limits of the HTML
standard) and empty rows are handled; a page that fails to parse yields one
row with its ``error`` and no table.  Counting tables (``page_table_counts``)
builds no rows: it walks over the tags only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLE_ROWS_SCHEMA = ("page_id long, table_idx int, row_idx int, is_header boolean, "
                     "cells array<string>, error string")

# The largest spans of the HTML standard.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
# Rows handed to Spark at once.
CHUNK_ROWS = 2000

# Header words that mark a ranking/film table on an encyclopedia
# page, and the size it must have (more than 10 rows, at least 4 columns,
# at least 2 matching header words).
BEST_TABLE_KEYWORDS = ["rank", "title", "gross", "year", "peak", "film", "movie"]
BEST_MIN_ROWS, BEST_MIN_COLS, BEST_MIN_HITS = 10, 4, 2


class _Table:
    def __init__(self):
        self.rows: list[tuple[bool, list[tuple[str, int, int, bool]], int]] = []
        self.group = 0  # row groups: thead, tbody, tfoot
        self.row: list[tuple[str, int, int, bool]] | None = None
        self.cell: list[str] | None = None
        self.cell_attrs = (1, 1, False)
        self.in_head = False


# Tags without attributes and without contents of their own syntax.
_PLAIN = "table|thead|tbody|tfoot|tr|td|th|p|br|div|span|a|b|i"
_PLAIN_RUN = re.compile(f"([^<&]*)<(/?)({_PLAIN})>")


class _TableParser(HTMLParser):
    """Collects every ``<table>`` (nested ones separately, in document order)."""

    # -- plain tags and the text between them need none of the base class's steps
    def _plain_run(self, i: int) -> int:
        raw, match = self.rawdata, _PLAIN_RUN.match
        while m := match(raw, i):
            text, end, tag = m.groups()
            if text:
                self.handle_data(text)
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, ())
            i = m.end()
        return i

    def parse_starttag(self, i):
        end = self._plain_run(i) if self.cdata_elem is None else i
        return end if end > i else super().parse_starttag(i)

    def parse_endtag(self, i):
        end = self._plain_run(i) if self.cdata_elem is None else i
        return end if end > i else super().parse_endtag(i)

    def updatepos(self, i, j):  # line numbers, which nobody asks for
        return j

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, _Table]] = []
        self.stack: list[tuple[int, _Table]] = []
        self.count = 0

    # -- helpers
    def _close_cell(self, t: _Table):
        if t.cell is not None and t.row is not None:
            rs, cs, th = t.cell_attrs
            t.row.append((" ".join("".join(t.cell).split()), rs, cs, th))
        t.cell = None

    def _close_row(self, t: _Table):
        self._close_cell(t)
        if t.row is not None:  # an empty row is a row: spans go through it
            header = bool(t.row) and (t.in_head or all(c[3] for c in t.row))
            t.rows.append((header, t.row, t.group))
        t.row = None

    @staticmethod
    def _span(attrs, key, most):
        for k, v in attrs:
            if k == key:
                try:
                    n = int(v)
                except (TypeError, ValueError):
                    return 1
                if n == 0 and key == "rowspan":
                    return 0  # to the end of the row group
                return min(n, most) if n > 0 else 1
        return 1

    # -- events
    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append((self.count, _Table()))
            self.count += 1
            return
        if not self.stack:
            return
        t = self.stack[-1][1]
        if tag in ("thead", "tbody", "tfoot"):
            self._close_row(t)
            t.in_head = tag == "thead"
            t.group += 1
        elif tag == "tr":
            self._close_row(t)
            t.row = []
        elif tag in ("td", "th"):
            self._close_cell(t)
            if t.row is None:
                t.row = []
            t.cell = []
            t.cell_attrs = (self._span(attrs, "rowspan", MAX_ROWSPAN),
                            self._span(attrs, "colspan", MAX_COLSPAN),
                            tag == "th")
        elif tag == "br" and t.cell is not None:
            t.cell.append(" ")

    def handle_endtag(self, tag):
        if not self.stack:
            return
        t = self.stack[-1][1]
        if tag == "table":
            self._close_row(t)
            self.done.append(self.stack.pop())
        elif tag in ("td", "th"):
            self._close_cell(t)
        elif tag == "tr":
            self._close_row(t)
        elif tag in ("thead", "tbody", "tfoot"):
            self._close_row(t)
            t.in_head = False
            t.group += 1

    def handle_data(self, data):
        if self.stack and self.stack[-1][1].cell is not None:
            self.stack[-1][1].cell.append(data)

    def finish(self) -> list[tuple[int, _Table]]:
        self.close()
        while self.stack:  # unclosed tables
            idx, t = self.stack.pop()
            self._close_row(t)
            self.done.append((idx, t))
        return sorted(self.done, key=lambda x: x[0])


def _expand(rows: list[tuple[bool, list[tuple[str, int, int, bool]], int]]):
    """Apply rowspan/colspan row by row: every spanned slot repeats the cell's
    text; a slot that no cell reaches is missing.  Spans end with their row
    group."""
    carry: dict[int, tuple[str, int]] = {}  # column -> (text, rows left; -1: all of the group)
    last = None
    for header, cells, group in rows:
        if group != last:
            carry, last = {}, group
        out: dict[int, str] = {}
        for col in list(carry):
            text, left = carry[col]
            out[col] = text
            if left == 1:
                del carry[col]
            elif left > 0:
                carry[col] = (text, left - 1)
        col = 0
        for text, down, across, _th in cells:
            while col in out:
                col += 1
            for _ in range(across):
                if col in out:  # overlapping spans: the earlier cell stays
                    break
                out[col] = text
                if down != 1:
                    carry[col] = (text, down - 1)
                col += 1
        yield header, [out.get(c) for c in range(max(out, default=-1) + 1)]


def iter_tables(html: str):
    """The rows of all tables of one page as ``(table_idx, row_idx, is_header, cells)``."""
    p = _TableParser()
    p.feed(html)
    for idx, t in p.finish():
        for r, (header, cells) in enumerate(_expand(t.rows)):
            yield idx, r, header, cells


def parse_tables(html: str) -> list[tuple[int, int, bool, list[str]]]:
    return list(iter_tables(html))


def _parse_batches(batches):
    names = ["page_id", "table_idx", "row_idx", "is_header", "cells", "error"]

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"table_idx": "Int32", "row_idx": "Int32"})

    rows = []
    for pdf in batches:
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            if html is None:
                continue
            try:
                for idx, r, header, cells in iter_tables(html):
                    rows.append((int(pid), idx, r, header, cells, None))
                    if len(rows) >= CHUNK_ROWS:
                        yield frame(rows)
                        rows = []
            except Exception as e:  # noqa: BLE001 -- told in the page's own row
                rows.append((int(pid), None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
    if rows:
        yield frame(rows)


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every table row of every page; a page that could not be parsed to its
    end has a row with ``error`` (and the rows before the fault)."""
    src = (pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(html_col).alias("html"))
           .where(F.lower(F.col("html")).contains("<table")))
    return src.mapInPandas(_parse_batches, TABLE_ROWS_SCHEMA)


def table_stats(tables: DataFrame, keywords: Sequence[str] = BEST_TABLE_KEYWORDS) -> DataFrame:
    """Per table: ``(page_id, table_idx, n_rows, n_cols, header, hits)``.

    ``header`` is the first header row (else the first row), column names
    stripped; ``hits`` counts keywords found in any header cell (lower case).
    """
    first = F.min_by(F.col("cells"), F.struct(~F.col("is_header"), F.col("row_idx")))
    agg = tables.where("error IS NULL").groupBy("page_id", "table_idx").agg(
        F.count_if(~F.col("is_header")).alias("n_rows"),
        F.max(F.size("cells")).alias("n_cols"),
        first.alias("header"))
    header_text = F.lower(F.array_join(F.transform("header", lambda x: F.trim(x)), "\u0001"))
    hits = sum((header_text.contains(k).cast("int") for k in keywords), F.lit(0))
    return agg.select("page_id", "table_idx", "n_rows", "n_cols",
                      F.transform("header", lambda x: F.trim(x)).alias("header"),
                      hits.alias("hits"))


def best_tables(tables: DataFrame, pages: DataFrame, id_col: str = "page_id",
                url_col: str = "url", keywords: Sequence[str] = BEST_TABLE_KEYWORDS) -> DataFrame:
    """One table per page.

    On encyclopedia pages (``wikipedia.org`` in the URL) the first non-empty
    table with > 10 rows, >= 4 columns and >= 2 keyword hits wins; otherwise,
    and on other pages, the table with most rows, the first on ties.  The
    window is per page, so its partitions are one page's tables.
    """
    st = table_stats(tables, keywords)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    j = st.join(urls, "page_id")
    wiki = F.col("url").contains("wikipedia.org")
    good = (wiki & (F.col("n_rows") > BEST_MIN_ROWS) & (F.col("n_cols") >= BEST_MIN_COLS)
            & (F.col("hits") >= BEST_MIN_HITS))
    w = Window.partitionBy("page_id").orderBy(
        good.desc(), F.when(good, F.col("table_idx")).asc_nulls_last(),
        F.col("n_rows").desc(), F.col("table_idx").asc())
    return (j.where((F.col("n_rows") > 0) | (F.col("n_cols") > 0))
            .withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("page_id", "table_idx", "n_rows", "n_cols", "header", "hits",
                    good.alias("matched")))


def table_frame(tables: DataFrame, page_id: int, table_idx: int) -> DataFrame:
    """One harvested table as a DataFrame with its header as column names
    (the header row is the only thing read on the driver)."""
    t = tables.where((F.col("page_id") == page_id) & (F.col("table_idx") == table_idx))
    head = t.where("is_header").orderBy("row_idx").select("cells").limit(1).collect()
    body = t.where(~F.col("is_header"))
    if head:
        names = [str(c).strip() or f"col{i}" for i, c in enumerate(head[0][0])]
    else:
        width = body.agg(F.max(F.size("cells"))).first()[0] or 0
        names = [str(i) for i in range(width)]
    seen: dict[str, int] = {}
    uniq = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        uniq.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
    return body.orderBy("row_idx").select(
        *[F.get(F.col("cells"), i).alias(n) for i, n in enumerate(uniq)])


# A tag's attributes: only a value after "=" may be quoted and hold a ">".
_ATTRIBUTES = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))*+"""
# What may follow a row's tag without changing the count: text and tags without quotes.
_RUN = r"""(?:[^<]*+<(?!/?\s*+(?:table|script|style)[\s/>])/?[a-z][^>"']*+>)*+"""
# Of lower-case text: a row's or cell's tag and what follows it, or one other tag.
_TAGS = re.compile(
    rf"""<(?:(t[rdh])(?=[\s/>]){_ATTRIBUTES}>{_RUN}|/(?:\s*(table)(?=[\s/>]))?[^>]*>"""
    rf"""|(table)(?=[\s/>])({_ATTRIBUTES})>"""
    rf"""|(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\s*\5\s*>|\Z)"""
    rf"""|[a-z]{_ATTRIBUTES}>|!--.*?--\s*>|[!?][^>]*>)""", re.DOTALL)
_QUOTED = re.compile(r"""=+\s*(?:"[^"]*"|'[^']*')""")
_BARE_SLASH = re.compile(r"=\s*\S*/$")


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends with a slash that is no part of an unquoted value."""
    return attributes.endswith("/") and not _BARE_SLASH.search(_QUOTED.sub("", attributes))


def count_tables(html: str) -> int:
    """Tables with at least one row: tags are walked over with a stack of the open
    tables, and nothing is kept of their contents.  Comments, scripts and quoted
    attribute values hold no tags; a tag whose quoted value never ends is none."""
    rows: list[bool] = []  # of every open table: whether it has a row
    found = 0
    for row, closed, opened, attributes, _ in _TAGS.findall(html.lower()):
        if row:
            if rows and not rows[-1]:
                rows[-1] = True
                found += 1
        elif opened:
            if not _closes_itself(attributes):
                rows.append(False)
        elif closed:
            del rows[-1:]
    return found


def page_table_counts(pages: DataFrame, id_col: str = "page_id",
                      html_col: str = "html") -> DataFrame:
    """``(page_id, n_tables)`` for every page, zero included: a projection that
    gives one number a page.  Pages without ``<table`` are not sent to Python."""
    html = F.col(html_col)

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else count_tables(t) for t in texts.to_pylist()], pa.int64())

    n = counted(F.when(F.lower(html).contains("<table"), html))
    return pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(n, F.lit(0)).cast("long").alias("n_tables"))
