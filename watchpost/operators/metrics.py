"""Metric points into series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.checks import one_of, whole
from ..functions.predicates import has_all
from .filters import time_range

AGGREGATES = ("avg", "sum", "min", "max", "count")


def tag_set(tags: str) -> Column:
    """The tags as a set in one order, so equal sets group together."""
    return F.expr(f"sort_array(array_distinct(coalesce({tags}, array())))")


def _values_of(tags: str, key: str) -> str:
    """All ``key:value`` tags of a key as SQL, or value ``N/A`` when there is none."""
    own = f"filter({tags}, t -> startswith(t, concat({key}, ':')))"
    return f"transform(array({own}), o -> IF(size(o) = 0, array(concat({key}, ':N/A')), o))[0]"


def scope_labels(tags: str, by: str) -> Column:
    """``host:web-01,env:prod`` for the keys in column ``by``; ``*`` when it is empty.

    One label for each combination of values: a point with two values of a key is in two groups.
    """
    more = (
        f"flatten(transform(done, d -> transform({_values_of(tags, 'k')},"
        " v -> IF(d = '', v, concat(d, ',', v)))))"
    )
    return F.expr(
        f"IF(size({by}) = 0, array('*'), aggregate({by}, array(''), (done, k) -> {more}))"
    )


def scope_labels_for(tags: str, by: Sequence[str]) -> Column:
    """The same for keys known when the plan is built."""
    if not by:
        return F.array(F.lit("*"))
    keys = ["'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in by]
    labels = _values_of(tags, keys[0])
    for key in keys[1:]:
        labels = (
            f"flatten(transform({labels}, d -> transform({_values_of(tags, key)},"
            " v -> concat(d, ',', v))))"
        )
    return F.expr(labels)


#: doubles are added up as decimals of these types, by size; each holds 17 digits of its values
_DECIMALS = ((0.0, 1.0, "decimal(38,28)"), (1.0, 1e15, "decimal(38,16)"), (1e15, 1e34, "decimal(38,2)"))


def is_exact(df: DataFrame, c: str) -> bool:
    """Whether sums of the column are exact as they are: whole numbers and decimals."""
    return not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def exact_sum(c: str) -> Column:
    """The sum of a column of doubles, the same bits whatever the order of the rows.

    A double stands for the decimal it is written as. Decimals of about one size add up without
    rounding, so three sums by size, added at the end, do not depend on the order. What is beyond
    them, infinities and NaN, is added as it is.
    """
    size, parts = F.abs(c), []
    for low, high, kind in _DECIMALS:
        own = F.when((size >= low) & (size < high), F.col(c).cast("double"))
        # more than the decimal holds comes to null, and then to the plain sum
        parts.append(F.coalesce(F.try_sum(own.cast(kind)).cast("double"), F.sum(own), F.lit(0.0)))
    beyond = F.sum(F.when(~(size < _DECIMALS[-1][1]), F.col(c).cast("double")))
    total = parts[2] + parts[1] + parts[0]
    return F.when(F.count(c) > 0, F.coalesce(total + beyond, total))


def total(c: str, exact: bool) -> Column:
    return F.sum(c).cast("double") if exact else exact_sum(c)


def mean(c: str, exact: bool) -> Column:
    """Sum over count; ``exact`` says that the column's own sums are."""
    return total(c, exact) / F.count(c)


def space_aggregate(agg: str, c: str) -> Column:
    """Over the tag sets' averages, which are doubles."""
    return {
        "avg": mean(c, False),
        "sum": total(c, False),
        "min": F.min(c),
        "max": F.max(c),
        "count": F.count(c),
    }[agg].cast("double")


def rollup(points: DataFrame, agg: str, by: Sequence[str], step_s: int) -> DataFrame:
    """Points of one metric to ``(scope, ts, value)``, batch or stream.

    Within a step each tag set is averaged first, then ``agg`` is taken across the tag sets of
    a group; a set with several values of a ``by`` key is in a group for each. The first grouping carries the whole tag set and the step, and is combined before
    its shuffle, so one busy host or metric is not one task.
    """
    step = f"{step_s} seconds"
    sets = points.groupBy(F.window("ts", step).alias("w"), tag_set("tags").alias("tags")).agg(
        mean("value", is_exact(points, "value")).alias("value")
    )
    return (
        sets.select("w", "value", F.explode(scope_labels_for("tags", by)).alias("scope"))
        .groupBy(F.window(F.window_time("w"), step).alias("w"), "scope")
        .agg(space_aggregate(agg, "value").alias("value"))
        .select("scope", F.col("w.start").alias("ts"), "value")
    )


def query_metric(
    points: DataFrame,
    metric: str,
    from_s: float,
    to_s: float,
    agg: str = "avg",
    scope: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
    step_s: int = 60,
) -> DataFrame:
    """One metric over a time range and scope, as one series per ``by`` group."""
    one_of("agg", agg, AGGREGATES)
    step_s = whole("step_s", step_s, 1)
    if not metric:
        raise ValueError("metric must not be empty")
    chosen = time_range(points, from_s, to_s).filter(F.col("metric") == metric)
    if scope:
        chosen = chosen.filter(has_all("tags", [f"{k}:{v}" for k, v in scope.items()]))
    return rollup(chosen, agg, by, step_s).select(
        F.lit(metric).alias("metric"), "scope", "ts", "value"
    )


def to_pointlist(
    series: DataFrame, from_s: float, step_s: int = 60, max_points: int = 10_000
) -> DataFrame:
    """Each series as an ordered list of ``(ts, value)``.

    A list covers at most ``max_points`` steps counted from ``from_s``; a longer series goes on
    in the next ``part``, so no row grows with the length of the range.
    """
    since = F.unix_timestamp("ts") - F.lit(int(from_s) - int(from_s) % step_s)
    part = F.floor(since / F.lit(step_s * max_points)).alias("part")
    return series.groupBy("metric", "scope", part).agg(
        F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("pointlist")
    )
