"""Continuous metric rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.checks import one_of, whole
from ..operators.metrics import AGGREGATES, rollup


def stream_metric(
    points: DataFrame,
    metric: str,
    step_s: int = 60,
    by: Sequence[str] = (),
    agg: str = "avg",
    delay: str = "10 minutes",
) -> DataFrame:
    """One metric's series as steps close; for append output.

    The batch rollup behind a watermark: points later than ``delay`` are dropped, a step is
    emitted once, and its state is freed. ``ts`` has to be TIMESTAMP, the only type Spark takes
    for event time.
    """
    one_of("agg", agg, AGGREGATES)
    step_s = whole("step_s", step_s, 1)
    live = points.filter(F.col("metric") == metric).withWatermark("ts", delay)
    return rollup(live, agg, by, step_s).select(
        F.lit(metric).alias("metric"), "scope", "ts", "value"
    )
