"""Ordered pages. Every order ends in a unique tiebreak, so pages are repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.checks import one_of, whole
from ..plans.layout import TOPK_ROWS, behind, slice_sorted


def latest(df: DataFrame, n: int = 100, topk_rows: int = TOPK_ROWS) -> DataFrame:
    """The newest ``n`` logs, newest first."""
    n = whole("n", n, 0)
    return slice_sorted(df, [("ts", "desc"), ("id", "desc")], 0, n, topk_rows)


def spans_page(
    df: DataFrame,
    n: int = 100,
    sort: str = "-timestamp",
    ties: Sequence[str] = ("trace_id", "span_id"),
    topk_rows: int = TOPK_ROWS,
) -> DataFrame:
    """The first ``n`` spans by time, newest first unless ``sort`` is ``timestamp``.

    ``ties`` names the columns that make a span unique among those of one instant.
    """
    one_of("sort", sort, ("timestamp", "-timestamp"))
    way = "asc" if sort == "timestamp" else "desc"
    return slice_sorted(df, [(c, way) for c in ("ts", *ties)], 0, whole("n", n, 0), topk_rows)


def incidents_page(
    df: DataFrame, size: int = 10, offset: int = 0, topk_rows: int = TOPK_ROWS
) -> DataFrame:
    """One page of incidents, latest created first; the offset counts rows."""
    size, offset = whole("size", size, 1, 100), whole("offset", offset, 0)
    return slice_sorted(df, [("created", "desc"), ("id", "asc")], offset, size, topk_rows)


def hosts_page(
    df: DataFrame,
    sort_field: str = "name",
    sort_dir: str = "asc",
    start: int = 0,
    count: int = 100,
    topk_rows: int = TOPK_ROWS,
) -> DataFrame:
    """One page of hosts by a named field, nulls last, ties by id; at most 1000."""
    one_of("sort_field", sort_field, df.columns)
    if isinstance(df.schema[sort_field].dataType, T.MapType):
        raise ValueError(f"cannot sort by {sort_field}: maps have no order")
    one_of("sort_dir", sort_dir, ("asc", "desc"))
    start, count = whole("start", start, 0), whole("count", count, 0, 1000)
    order = [(sort_field, f"{sort_dir}_nulls_last"), ("id", "asc")]
    return slice_sorted(df, order, start, count, topk_rows)


def page_count(page: DataFrame) -> DataFrame:
    """How many rows the page holds (not how many matched)."""
    return page.agg(F.count(F.lit(1)).alias("count"))


def after_cursor(
    df: DataFrame,
    order: Sequence[tuple[str, str]],
    last: Sequence | None,
    n: int,
    topk_rows: int = TOPK_ROWS,
) -> DataFrame:
    """The next ``n`` rows behind a cursor: the order columns of the last row already read.

    For reading a table page by page. ``order`` is (column, direction) pairs ending in a unique
    one, ``last`` their values (None: from the start). What the cursor has passed is left out by
    a filter on the leading column that reaches the files, so a page costs the same however deep.
    """
    n = whole("n", n, 0)
    if last is not None:
        if len(last) != len(order):
            raise ValueError(f"the cursor needs {len(order)} values; got {len(last)}")
        df = df.filter(behind(df, order, last))
    return slice_sorted(df, order, 0, n, topk_rows)
