"""Record filters. None of them shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.checks import one_of
from ..functions.predicates import all_of, contains_ci, has_all, search
from ..functions.times import ts_lit, ts_type, utc_day

# fixed values: the states a monitor can be in
MONITOR_STATES = ("alert", "warn", "no data", "ok")


def time_range(
    df: DataFrame, from_s: float, to_s: float, col: str = "ts", day_col: str | None = None
) -> DataFrame:
    """Rows with ``from_s <= col < to_s`` (epoch seconds); an inverted range is empty.

    ``day_col`` names a DATE column that holds the UTC day of ``col``, by which the table is laid
    out; its folders are then pruned to the days touched.
    """
    kind = ts_type(df, col)
    low, high = ts_lit(from_s, kind), ts_lit(to_s, kind)
    pred = (F.col(col) >= low) & (F.col(col) < high)
    if day_col is not None:
        days = [F.lit(utc_day(at)) for at in (from_s, to_s)]
        pred = pred & F.col(day_col).between(*days)
    return df.filter(pred)


def search_rows(
    df: DataFrame,
    facets: Mapping[str, str] | None = None,
    text: Sequence[str] = (),
    text_col: str = "message",
) -> DataFrame:
    """Rows matching every facet and every text term."""
    return df.filter(search(df, facets, text, text_col))


def span_facets(
    df: DataFrame, service: str | None = None, operation: str | None = None
) -> DataFrame:
    """Spans of one service and/or operation; an empty string means no filter."""
    facets = {k: v for k, v in (("service", service), ("operation", operation)) if v}
    return search_rows(df, facets) if facets else df


def title_contains(df: DataFrame, name: str | None) -> DataFrame:
    """Dashboards whose title holds ``name`` literally, in any case; empty means no filter."""
    return df.filter(contains_ci("title", name)) if name else df


def csv_tags_all(df: DataFrame, tags: Sequence[str] | None) -> DataFrame:
    """Dashboards whose comma-separated description holds every tag, exactly and untrimmed."""
    if not tags:
        return df
    return df.filter(has_all(F.split("description", ","), tags))


def filter_monitors(
    df: DataFrame,
    states: Sequence[str] | None = None,
    name: str | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Monitors in any of the states, whose name holds ``name``, carrying all tags."""
    preds = []
    if states:
        for state in states:
            one_of("state", state, MONITOR_STATES)
        preds.append(F.lower("overall_state").isin(*states))
    if name:
        preds.append(contains_ci("name", name))
    if tags:
        preds.append(has_all("tags", tags))
    return df.filter(all_of(preds)) if preds else df


def filter_hosts(
    df: DataFrame, filter: str | None = None, from_s: float | None = None
) -> DataFrame:
    """Hosts matching a filter string and reported since ``from_s``.

    The string matches a tag exactly, or a part of the name or of an alias in any case.
    """
    preds = []
    if filter:
        alias_hit = F.exists("aliases", lambda a: contains_ci(a, filter))
        preds.append(
            has_all("tags", [filter])
            | contains_ci("name", filter)
            | F.coalesce(alias_hit, F.lit(False))
        )
    if from_s is not None:
        seen = F.col("last_reported") >= ts_lit(from_s, ts_type(df, "last_reported"))
        preds.append(F.coalesce(seen, F.lit(False)))
    return df.filter(all_of(preds)) if preds else df


def get_by_id(df: DataFrame, id: str | int, strict: bool = False) -> DataFrame:
    """The record with this id: one row, or none. ``strict`` raises when there is none."""
    if id == "" or id is None:
        raise ValueError("id must not be empty")
    # cast the argument, not the column, so the comparison reaches the file statistics
    found = df.filter(F.col("id") == F.lit(id).cast(df.schema["id"].dataType)).limit(1)
    if strict and found.isEmpty():
        raise LookupError(f"no record with id {id!r}")
    return found


def current_downtimes(df: DataFrame, as_of_s: float, current_only: bool = False) -> DataFrame:
    """All downtimes, or only those in force at ``as_of_s``: started, not ended, not disabled.

    A missing start means already begun, a missing end means still open.
    """
    if not current_only:
        return df
    now = ts_lit(as_of_s, ts_type(df, "ts_start"))
    return df.filter(
        ~F.coalesce(F.col("disabled"), F.lit(False))
        & (F.col("ts_start").isNull() | (F.col("ts_start") <= now))
        & (F.col("ts_end").isNull() | (F.col("ts_end") > now))
    )
