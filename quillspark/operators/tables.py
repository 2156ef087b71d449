"""Tables: markup to rows, rows to cells, detected rows and columns to a grid, CSV and Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions import geometry as G
from quillspark.functions import text as T

_ROWS = "array<array<string>>"


def parse_markup(markup: Column) -> Column:
    """Rows of cells of an HTML table, else of Markdown pipe rows without separator rows."""
    cell = lambda c: T.strip(T.unescape(F.regexp_replace(c, "<[^>]+>", "")))
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<(?:td|th)[^>]*>(.*?)</(?:td|th)>"), F.lit(1)), cell)
    html = F.filter(F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells), lambda r: F.size(r) > 0)
    pipes = F.filter(T.lines(markup), lambda x: x.startswith("|"))
    rows = F.transform(pipes, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), T.strip))
    piped = F.filter(rows, lambda r: F.exists(r, lambda c: c.rlike("[^-: ]")))
    return F.when(F.lower(markup).contains("<tr") & (F.size(html) > 0), html).otherwise(piped)


def build_cells(rows: Column, box: Column) -> Column:
    """Cells of an even grid over ``box``, as wide as the longest row; the first row is the header."""
    n, m = F.size(rows), F.array_max(F.transform(rows, F.size))
    high, wide = (box[3] - box[1]) / n, (box[2] - box[0]) / m

    def cell(r: Column, c: Column, content: Column) -> Column:
        own = F.array(box[0] + c * wide, box[1] + r * high, box[0] + (c + 1) * wide, box[1] + (r + 1) * high)
        return F.struct(r.alias("row"), c.alias("column"), content.alias("content"), own.alias("bbox_2d"), G.polygon_of(own).alias("polygon"), (r == 0).alias("is_header"))

    return F.flatten(F.transform(rows, lambda row, r: F.transform(row, lambda content, c: cell(r, c, content))))


def grid(rows: DataFrame, columns: DataFrame, headers: DataFrame, spans: DataFrame) -> DataFrame:
    """table_id, row, column, bbox_2d, is_header, row_span, col_span, span_root of detected boxes.

    All: table_id, bbox_2d. Rows are numbered from the top, columns from the left; a cell is where both
    meet; it is a header if its centre lies in a header box. A spanning box covers the cells of which it
    holds half, and counts if these lie in several rows or columns; the last such box wins, in order of idx
    where ``spans`` has it, else of the boxes. Tables go through numpy in batches: the rows and columns that a
    box can reach are found by binary search in their edges, for all boxes of a batch at once.
    """
    boxes = lambda df, name, key: df.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "bbox_2d"))), lambda x: x["bbox_2d"]).alias(name))
    box = F.col("bbox_2d")
    last = F.col("idx") if "idx" in spans.columns else box
    all_ = boxes(rows, "r", box[1]).join(boxes(columns, "c", box[0]), "table_id").join(boxes(headers, "h", box), "table_id", "left").join(boxes(spans, "s", last), "table_id", "left")
    kind = rows.schema["table_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cells(batch.column(0), *(_boxes(batch.column(i)) for i in range(1, 5)))

    cast = [F.coalesce(F.col(c).cast("array<array<double>>"), F.array().cast("array<array<double>>")).alias(c) for c in "rchs"]
    return all_.select("table_id", *cast).mapInArrow(run, f"table_id {kind}, row int, column int, bbox_2d array<double>, is_header boolean, row_span int, col_span int, span_root boolean")


def _boxes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(table of each box, boxes by row)."""
    each = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)
    return np.repeat(np.arange(len(each)), each), flat


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, position) of n[0] rows of 0, n[1] rows of 1 and so on."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _reach(table: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boxes from ``start`` to ``end`` of tables ``own``: the first and behind the last of the table's edges (by low) that may touch it."""
    values = np.unique(np.concatenate([low, high, start, end]))
    rank = lambda t, v: t * (len(values) + 1) + np.searchsorted(values, v)
    behind = np.searchsorted(rank(table, low), rank(own, end), "right")
    so_far = np.maximum.accumulate(rank(table, high))  # within a table: the farthest end up to here
    return np.searchsorted(so_far, rank(own, start), "left"), behind


def _cells(ids: pa.Array, rows: tuple, columns: tuple, headers: tuple, spans: tuple) -> pa.RecordBatch:
    (rt, r), (ct, c) = rows, columns
    wide = np.bincount(ct, minlength=len(ids))
    first_row, first_column = np.searchsorted(rt, np.arange(len(ids))), np.searchsorted(ct, np.arange(len(ids)))
    i, j = _spread(wide[rt])  # each row with every column of its table
    j = j + first_column[rt[i]]
    start = np.concatenate([[0], np.cumsum(wide[rt])])[:-1]
    box = np.stack([np.maximum(r[i, 0], c[j, 0]), np.maximum(r[i, 1], c[j, 1]), np.minimum(r[i, 2], c[j, 2]), np.minimum(r[i, 3], c[j, 3])], 1)
    there = (box[:, 0] < box[:, 2]) & (box[:, 1] < box[:, 3])

    def near(t: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, cell) of all cells that a box may touch."""
        y0, y1 = _reach(rt, r[:, 1], r[:, 3], t, b[:, 1], b[:, 3])
        x0, x1 = _reach(ct, c[:, 0], c[:, 2], t, b[:, 0], b[:, 2])
        k, n = _spread(np.maximum(y1 - y0, 0) * np.maximum(x1 - x0, 0))
        across = np.maximum(x1 - x0, 1)[k]
        cell = start[y0[k] + n // across] + x0[k] + n % across - first_column[t[k]] if len(k) else np.zeros(0, np.int64)
        return k[there[cell]], cell[there[cell]]

    header = np.zeros(len(box), bool)
    k, cell = near(*headers)
    x, y, h = (box[cell, 0] + box[cell, 2]) / 2, (box[cell, 1] + box[cell, 3]) / 2, headers[1][k]
    header[cell[(h[:, 0] <= x) & (x <= h[:, 2]) & (h[:, 1] <= y) & (y <= h[:, 3])]] = True
    st, s = spans
    k, cell = near(st, s)
    shared = np.maximum(0, np.minimum(box[cell, 2], s[k, 2]) - np.maximum(box[cell, 0], s[k, 0])) * np.maximum(0, np.minimum(box[cell, 3], s[k, 3]) - np.maximum(box[cell, 1], s[k, 1]))
    half = shared / ((box[cell, 2] - box[cell, 0]) * (box[cell, 3] - box[cell, 1])) >= 0.5
    k, cell = k[half], cell[half]
    in_rows, in_columns = np.unique(np.stack([k, i[cell]], 1), axis=0), np.unique(np.stack([k, j[cell]], 1), axis=0)
    n_rows, n_columns = (np.bincount(x[:, 0], minlength=len(s)) for x in (in_rows, in_columns))
    # Each covered row with each covered column of its span: these cells are the span's.
    own = in_rows[:, 0]
    p, q = _spread(np.where((n_rows > 1) | (n_columns > 1), n_columns, 0)[own])
    column = in_columns[(np.cumsum(n_columns) - n_columns)[own[p]] + q, 1] if len(p) else np.zeros(0, np.int64)
    cell = start[in_rows[p, 1]] + column - first_column[rt[in_rows[p, 1]]] if len(p) else np.zeros(0, np.int64)
    span = np.full(len(box), -1)
    np.maximum.at(span, cell, own[p])
    least_row, least_column = np.full(len(s), len(r)), np.full(len(s), len(c))
    np.minimum.at(least_row, in_rows[:, 0], in_rows[:, 1])
    np.minimum.at(least_column, in_columns[:, 0], in_columns[:, 1])
    out = np.flatnonzero(there)
    span, none = span[out], span[out] < 0
    of = lambda values: pa.array((values[span] if len(s) else np.zeros(len(out), np.int64)).astype(np.int32), mask=none)
    root = (least_row[span] == i[out]) & (least_column[span] == j[out]) if len(s) else np.zeros(len(out), bool)
    table = rt[i[out]]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(out) + 1, 4), pa.int32()), pa.array(box[out].ravel()))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(table)), pa.array((i[out] - first_row[table]).astype(np.int32)), pa.array((j[out] - first_column[table]).astype(np.int32)), lists, pa.array(header[out]), of(n_rows), of(n_columns), pa.array(root, mask=none)],
        ["table_id", "row", "column", "bbox_2d", "is_header", "row_span", "col_span", "span_root"],
    )


def shape(cells: DataFrame) -> DataFrame:
    """table_id, row_count, column_count, with spans."""
    return cells.groupBy("table_id").agg(F.max(F.col("row") + F.coalesce("row_span", F.lit(1))).alias("row_count"), F.max(F.col("column") + F.coalesce("col_span", F.lit(1))).alias("column_count"))


def element_counts(elements: DataFrame) -> DataFrame:
    """label, count of structure elements."""
    return elements.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def result(cells: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """table_id, row_count, column_count, cells as structs with kind (columnHeader or content) and spans; covered cells are left out."""
    shown = cells.filter("coalesce(span_root, true)")
    cell = F.struct("row", "column", F.coalesce("row_span", F.lit(1)).alias("row_span"), F.coalesce("col_span", F.lit(1)).alias("col_span"), F.when(F.col("is_header"), "columnHeader").otherwise("content").alias("kind"), G.polygon_of(F.col("bbox_2d")).alias("polygon"))
    return shape(cells).join(shown.groupBy("table_id").agg(F.array_sort(F.collect_list(cell)).alias("cells")), "table_id")


def padded(rows: Column) -> Column:
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def to_csv(rows: Column) -> Column:
    """Every cell quoted, rows padded to one width."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(T.text(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(padded(rows), lambda r: F.array_join(F.transform(r, quote), ",")), "\n")


def to_markdown(rows: Column) -> Column:
    """Header, separator and rows, pipes escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    safe = F.transform(padded(rows), lambda r: F.transform(r, lambda c: F.replace(T.text(c), F.lit("|"), F.lit("\\|"))))
    rule = F.transform(F.get(safe, F.lit(0)), lambda c: F.lit("---"))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(F.concat(F.slice(safe, 1, 1), F.array(rule), F.slice(safe, F.lit(2), F.greatest(F.size(safe) - 1, F.lit(0)))), line), "\n")).otherwise("")


def all_to_markdown(tables: Column) -> Column:
    """Several tables one after the other, labelled Tabelle 1, Tabelle 2 and so on; a single one without label."""
    label = F.transform(tables, lambda t, i: F.concat(F.lit("Tabelle "), (i + 1).cast("string"), F.lit("\n\n"), to_markdown(t)))
    return F.when(F.size(tables) == 1, to_markdown(F.get(tables, F.lit(0)))).otherwise(F.array_join(label, "\n\n"))


def markdown_rows(text: Column) -> Column:
    """The first Markdown table: a pipe row, a strict separator, and rows up to a line without pipe, padded."""

    @F.pandas_udf(_ROWS)
    def find(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[list[str]]:
            own = [x.strip() for x in (t or "").splitlines()]
            cells = lambda x: [c.strip() for c in x.strip("|").split("|")]
            rule = lambda c: len(c.strip(":")) >= 3 and set(c.strip(":")) == {"-"} and len(c) - len(c.strip(":")) <= 2
            for i in range(len(own) - 1):
                if "|" in own[i] and "|" in own[i + 1] and all(map(rule, cells(own[i + 1]))):
                    rows = [cells(own[i])]
                    for x in own[i + 2 :]:
                        if "|" not in x:
                            break
                        rows.append(cells(x))
                    width = max(map(len, rows))
                    return [r + [""] * (width - len(r)) for r in rows]
            return []

        return texts.map(one)

    return find(text)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.open[-1][-1].append("".join(self.cell).strip())
            self.cell = None
        elif tag == "table" and self.open:
            rows = [r for r in self.open.pop() if any(r)]
            if rows:
                self.tables.append(rows)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@F.pandas_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def html_tables(texts: pd.Series) -> pd.Series:
    """Every table of a page; a break is a new line in its cell; empty rows and tables go."""

    def one(t: str | None) -> list:
        parser = _Tables()
        parser.feed(t or "")
        return parser.tables

    return texts.map(one)


def structured_rows(columns: Column, rows: Column) -> Column:
    """Rows under a header, col_1, col_2 and so on where there is none, padded."""
    width = F.greatest(F.size(columns), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    header = F.when(F.size(columns) > 0, columns).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    return padded(F.concat(F.array(header), rows))
