"""Continuous monitor evaluation.

Two streaming aggregations close the steps (per tag set, then per series group); behind them every
series group has keyed state: the values of its last steps, as many as its longest lookback has,
and a timer at the end of its next step. A group that sends nothing is woken by its timer, so it
is reported with ``No Data`` and its old values leave the lookback in time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.checks import whole
from ..operators.metrics import is_exact, mean, scope_labels, tag_set
from ..operators.monitors import accumulate, chosen, in_scope, probed_spaces, with_series

#: keyed state with timers needs this provider
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: label of the rows that tell the time, and of those that tell that a series has groups
CLOCK, SEEN = "\u0001clock", "\u0001seen"
#: steps evaluated at once
STRETCH = 4096


def stream_monitors(
    points: DataFrame, rules: DataFrame, step_s: int = 60, delay: str = "10 minutes"
) -> DataFrame:
    """States of all rules, of any lookback, at every step as it closes; for append output.

    A group is reported at every step from its first one on, silent steps included: over the
    lookback's steps up to this one, ``No Data`` if they hold nothing. A rule none of whose groups
    was seen so far has ``No Data`` for group ``*`` at every step since the stream's first. A step
    closes once the newest point is ``delay`` past its end; later points are dropped. Rules are
    fixed for the life of a checkpoint. Sets the state store provider that keyed state needs.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    step_s = whole("step_s", step_s, 1)
    rules = with_series(rules, step_s)
    step = f"{step_s} seconds"
    # points no rule names still move the time: one row a step and task
    named = rules.select("metric").distinct().withColumn("_named", F.lit(True))
    no_tags = F.array().cast("array<string>")
    sets = (
        points.withWatermark("ts", delay)
        .join(named, "metric", "left")
        .groupBy(
            F.window("ts", step).alias("w"),
            F.when(F.col("_named"), F.col("metric")).otherwise(CLOCK).alias("metric"),
            F.when(F.col("_named"), tag_set("tags")).otherwise(no_tags).alias("tags"),
        )
        .agg(mean("value", is_exact(points, "value")).alias("value"))
    )
    series = (
        _grouped(sets, rules)
        .groupBy(F.window(F.window_time("w"), step).alias("w"), "series", "space_agg", "group")
        .agg(*accumulate("value"))
        .withColumn("value", chosen("space_agg"))
    )
    cells = _keyed(series, rules)
    rule_type = rules.schema["rule_id"].dataType.simpleString()
    states = cells.groupBy("rules", "group").transformWithStateInPandas(
        statefulProcessor=TrailingStates(step_s),
        outputStructType=f"rule_id {rule_type}, group string, step long, value double, state string",
        outputMode="append",
        timeMode="eventTime",
    )
    return states.select(
        "rule_id", "group", F.timestamp_seconds("step").alias("ts"), "value", "state"
    )


def _grouped(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Tag-set rows by series and group, with rows for the clock and for a series being seen.

    Those rows are many here and few after the partial aggregation that follows.
    """
    spaces = probed_spaces(rules).select("series", "metric", "probe", "scope", "by", "space_agg")
    clock = rules.sparkSession.range(1).select(
        F.lit(CLOCK).alias("series"), F.lit(CLOCK).alias("metric"), F.lit(CLOCK).alias("probe"),
        *(F.array().cast("array<string>").alias(c) for c in ("scope", "by")),
        F.lit("count").alias("space_agg"),
    )
    probe = F.explode(
        F.expr(
            "concat(transform(array_distinct(array_append(tags, '*')),"
            f" t -> struct(metric, t AS probe)), array(struct('{CLOCK}' AS metric, '{CLOCK}' AS probe)))"
        )
    )
    probes = sets.withColumn("_p", probe).select("w", "tags", "value", "_p.metric", "_p.probe")
    # a batch without new files closes most steps, but its source is empty: Spark would take the
    # closed rows for the small side, and send them out through the driver
    spaces = F.broadcast(spaces.unionByName(clock))
    matched = probes.join(spaces, ["metric", "probe"]).filter(in_scope())
    labels = (
        F.when(F.col("series") == CLOCK, F.array(F.lit(CLOCK)))
        .when(F.size("by") == 0, F.array(F.lit("*")))
        .otherwise(F.array_append(scope_labels("tags", "by"), F.lit(SEEN)))
    )
    return matched.withColumn("group", F.explode(labels))


def _keyed(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Closed cells with their rules as key: (rules, group, step, value, kind).

    The clock goes to group ``*`` of every series; that a series was seen goes there too.
    """
    rule = F.struct("rule_id", "time_agg", "lookback_s", "comparator", "threshold")
    held = rules.groupBy("series").agg(
        F.to_json(
            F.struct(
                F.first(F.size("by") == 0).alias("whole"),
                F.array_sort(F.collect_list(rule)).alias("rules"),
            )
        ).alias("rules")
    )
    to = held.withColumn("to", F.col("series")).unionByName(held.withColumn("to", F.lit(CLOCK)))
    kind = F.when(F.col("group") == CLOCK, "clock").when(F.col("group") == SEEN, "seen").otherwise("value")
    # the rules, for the reason given in _grouped
    to = F.broadcast(to)
    return series.join(to.drop("series"), series["series"] == to["to"]).select(
        "rules",
        F.when(kind == "value", F.col("group")).otherwise("*").alias("group"),
        F.unix_timestamp("w.start").alias("step"),
        "value",
        kind.alias("kind"),
        # carries the watermark
        "w",
    )


class TrailingStates(StatefulProcessor):
    """One group of one series: its last values, and the states of its rules at closed steps."""

    def __init__(self, step_s: int):
        self.step = step_s

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "next long, timer long, over boolean, values binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, float] = {}
        start, seen = None, None
        for part in rows:
            for step, value, kind in zip(part["step"], part["value"], part["kind"]):
                step = int(step)
                start = step if start is None else min(start, step)
                if kind == "value":
                    found[step] = float(value)
                elif kind == "seen":
                    seen = step if seen is None else min(seen, step)
        yield from self._move_on(key, timerValues, found, start, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._move_on(key, timerValues, {}, None, None)

    def close(self) -> None:
        pass

    def _move_on(self, key, timer_values, found, start, seen) -> Iterator[pd.DataFrame]:
        """Report the steps that have closed since the last time, and set the timer anew."""
        spec = json.loads(key[0])
        if self.held.exists():
            at, timer, over, packed = self.held.get()
            if over:
                return
            values = np.frombuffer(packed, np.float64)
        elif start is None:
            return
        else:
            at, timer, values = start, None, np.zeros(0)
        # the first step that is still open
        until = timer_values.getCurrentWatermarkInMs() // (1000 * self.step) * self.step
        until = max(until, at, *(s + self.step for s in found))
        over = seen is not None and not spec["whole"]
        if over:
            until = min(until, max(seen, at))
        steps = np.arange(at, until, self.step)
        if len(steps):
            new = np.array([found.get(int(s), np.nan) for s in steps])
            yield from self._judge(spec["rules"], key[1], steps, np.concatenate([values, new]))
            most = max(r["lookback_s"] for r in spec["rules"]) // self.step - 1
            values = np.concatenate([values, new])[max(len(values) + len(new) - most, 0) :]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if over else (until + self.step) * 1000
        if timer is not None:
            self.handle.registerTimer(timer)
        self.held.update((int(until), timer, over, values.tobytes()))

    def _judge(self, rules, group, steps, values) -> Iterator[pd.DataFrame]:
        """``values`` ends with those of ``steps``; what is missing before them is no data."""
        for rule in rules:
            width = rule["lookback_s"] // self.step
            padded = np.concatenate([np.full(width - 1, np.nan), values])
            windows = np.lib.stride_tricks.sliding_window_view(padded, width)[-len(steps) :]
            for low in range(0, len(steps), STRETCH):
                part = windows[low : low + STRETCH]
                value = aggregate(rule["time_agg"], part)
                yield pd.DataFrame(
                    {
                        "rule_id": rule["rule_id"],
                        "group": group,
                        "step": steps[low : low + STRETCH],
                        "value": pd.Series([None if np.isnan(v) else v for v in value], dtype=object),
                        "state": judge(rule["comparator"], rule["threshold"], value),
                    }
                )


def aggregate(kind: str, windows: np.ndarray) -> np.ndarray:
    """One number for each window, over the values in it; NaN where it holds none."""
    held = ~np.isnan(windows)
    count = held.sum(1)
    if kind == "count":
        out = count.astype(float)
    elif kind in ("sum", "avg"):
        out = np.where(held, windows, 0.0).sum(1)
        if kind == "avg":
            out = out / np.maximum(count, 1)
    elif kind == "min":
        out = np.where(held, windows, np.inf).min(1)
    elif kind == "max":
        out = np.where(held, windows, -np.inf).max(1)
    else:
        raise ValueError(f"unknown aggregate {kind}")
    return np.where(count > 0, out, np.nan)


def judge(comparator: str, threshold: float, value: np.ndarray) -> np.ndarray:
    compare = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
    if comparator not in compare:
        raise ValueError(f"unknown comparator {comparator}")
    alert = compare[comparator](value, threshold)
    return np.where(np.isnan(value), "No Data", np.where(alert, "Alert", "OK"))
