"""Threshold rules over metric points.

A rule reads: the time aggregate, over a lookback, of the space aggregate of a metric over a
scope, compared to a threshold. Rules of the same metric, scope, grouping and space aggregate
share one *series*, which is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import whole
from ..functions.times import from_ts, require_utc, seconds_to_ts, ts_lit, ts_type
from .filters import time_range
from .metrics import exact_sum, is_exact, mean, scope_labels, tag_set

#: lookbacks of up to so many steps are read as window frames, longer ones as blocks
FRAME_STEPS = 48
_TICKS = 1_000_000_000


def with_series(rules: DataFrame, step_s: int) -> DataFrame:
    """Rules with a normal scope, a lookback in whole steps, and the key of their series."""
    return rules.withColumns(
        {
            "scope": F.expr(
                "sort_array(array_distinct(filter(coalesce(scope, array()),"
                " t -> t NOT IN ('', '*'))))"
            ),
            "by": F.expr("coalesce(by, array())"),
            "lookback_s": F.expr(
                f"greatest((lookback_s + {step_s - 1}) div {step_s}, 1) * {step_s}"
            ),
        }
    ).withColumn("series", F.expr("to_json(struct(metric, scope, by, space_agg))"))


def average_sets(points: DataFrame, rules: DataFrame, step: Column) -> DataFrame:
    """One row per metric, tag set and step, for the metrics that rules name."""
    return (
        points.join(rules.select("metric"), "metric", "left_semi")
        .groupBy("metric", step.alias("step"), tag_set("tags").alias("tags"))
        .agg(mean("value", is_exact(points, "value")).alias("value"))
    )


def probed_spaces(rules: DataFrame) -> DataFrame:
    """The distinct series of rules with the tag a row has to carry to be looked at.

    That tag is the one of the scope that the fewest series of the metric share: rules of one
    environment and a host each meet the rows of their host. ``*`` for a rule without scope.
    """
    spaces = rules.select("series", "metric", "scope", "by", "space_agg").distinct()
    shared = (
        spaces.select("metric", F.explode("scope").alias("tag"))
        .groupBy("metric", "tag")
        .agg(F.count(F.lit(1)).alias("_many"))
    )
    rarest = (
        spaces.select("series", "metric", F.explode("scope").alias("tag"))
        .join(shared, ["metric", "tag"])
        .groupBy("series")
        .agg(F.min_by("tag", F.struct("_many", "tag")).alias("probe"))
    )
    return spaces.join(rarest, "series", "left").withColumn("probe", F.coalesce("probe", F.lit("*")))


def in_scope() -> Column:
    return F.size(F.array_except("scope", "tags")) == 0


def match_series(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Tag-set rows to the series whose scope they are in, with their group label.

    Joined on the metric and the rarest scope tag (``*`` for a rule without scope) rather than on
    the metric alone: with a rule per host, a row meets the rules of its own host only.
    """
    probes = sets.withColumn(
        "probe", F.explode(F.array_distinct(F.array_append("tags", F.lit("*"))))
    )
    return (
        probes.join(probed_spaces(rules), ["metric", "probe"])
        .filter(in_scope())
        .withColumn("group", F.explode(scope_labels("tags", "by")))
    )


def accumulate(value: str) -> list[Column]:
    """The parts every aggregate is made of, for a rule that names its aggregate in a column."""
    return [
        exact_sum(value).alias("_sum"),
        F.count(value).alias("_n"),
        F.min(value).cast("double").alias("_min"),
        F.max(value).cast("double").alias("_max"),
    ]


def chosen(kind: str) -> Column:
    """The aggregate named by column ``kind`` out of the accumulated parts; null over no values."""
    return F.expr(
        f"""CASE WHEN _n > 0 THEN CASE {kind} WHEN 'avg' THEN _sum / nullif(_n, 0)
          WHEN 'sum' THEN _sum WHEN 'min' THEN _min WHEN 'max' THEN _max
          WHEN 'count' THEN CAST(_n AS DOUBLE)
          ELSE CAST(raise_error(concat('unknown aggregate ', {kind})) AS DOUBLE) END END"""
    )


def state(value: str) -> Column:
    return F.expr(
        f"""CASE WHEN {value} IS NULL THEN 'No Data'
          WHEN CASE comparator WHEN '>' THEN {value} > threshold WHEN '>=' THEN {value} >= threshold
                 WHEN '<' THEN {value} < threshold WHEN '<=' THEN {value} <= threshold
                 ELSE CAST(raise_error(concat('unknown comparator ', comparator)) AS BOOLEAN) END
          THEN 'Alert' ELSE 'OK' END"""
    )


def series_steps(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(series, group, step, value)``, and one empty row for each series never seen.

    Both levels come out of one pass over the rows as grouping sets, so finding the silent
    series does not read the points again.
    """
    columns = ["series", "space_agg", "group", "step", "value"]
    real = match_series(sets, rules).select(*columns)
    # repeated for rules sharing a series, which changes no aggregate of nothing
    blank = rules.select("series", "space_agg").withColumns(
        {
            "group": F.lit(None).cast("string"),
            "step": F.lit(None).cast("long"),
            "value": F.lit(None).cast("double"),
        }
    )
    cells = (
        real.unionByName(blank)
        .groupingSets(
            [["series", "space_agg", "group", "step"], ["series", "space_agg"]],
            "series",
            "space_agg",
            "group",
            "step",
        )
        .agg(F.grouping("group").alias("_total"), *accumulate("value"))
    )
    seen = (F.col("_total") == 0) & F.col("step").isNotNull()
    silent = (F.col("_total") == 1) & (F.col("_n") == 0)
    return cells.filter(seen | silent).select(
        "series",
        F.when(seen, F.col("group")).otherwise("*").alias("group"),
        "step",
        F.when(seen, chosen("space_agg")).alias("value"),
    )


def evaluate_monitors(
    points: DataFrame,
    rules: DataFrame,
    as_of_s: int,
    seen_since_s: float | None = None,
    step_s: int = 60,
) -> DataFrame:
    """The state of every rule and group at one instant.

    Steps are counted back from ``as_of_s``, so a lookback of L covers ``(as_of - L, as_of]``.
    A group seen since ``seen_since_s`` (default: ever) with nothing in the lookback has
    ``No Data``; so has a rule no group of which was seen.
    """
    require_utc(points.sparkSession)
    step_s, as_of_s = whole("step_s", step_s, 1), whole("as_of_s", as_of_s)
    rules = with_series(rules, step_s)
    kind = ts_type(points, "ts")
    read = points.filter(F.col("ts") <= ts_lit(as_of_s, kind))
    if seen_since_s is not None:
        read = read.filter(F.col("ts") > ts_lit(seen_since_s, kind))
    age = F.lit(as_of_s * 1_000_000) - from_ts("ts", "us")
    back = F.call_function("div", age, F.lit(step_s * 1_000_000))
    # whatever is older than every lookback shares one step, so that history comes to one row
    # for each tag set before it is shuffled
    oldest = rules.agg(F.max(F.ceil(F.col("lookback_s") / step_s)).cast("long")).scalar()
    read = read.withColumn("_back", F.least(back, oldest))
    steps = series_steps(average_sets(read, rules, F.col("_back")), rules)
    within = F.when(F.col("step") * step_s < F.col("lookback_s"), F.col("value"))
    return (
        steps.join(rules.drop("metric", "scope", "by", "space_agg"), "series")
        .withColumn("value", within)
        .groupBy("rule_id", "group", "time_agg", "comparator", "threshold")
        .agg(*accumulate("value"))
        .withColumn("value", chosen("time_agg"))
        .select("rule_id", "group", "value", state("value").alias("state"))
    )


def evaluate_monitors_over(
    points: DataFrame,
    rules: DataFrame,
    from_s: int,
    to_s: int,
    step_s: int = 60,
    frame_steps: int = FRAME_STEPS,
) -> DataFrame:
    """The state of every rule and group at every step in ``[from_s, to_s)``.

    The state at a step looks at the last lookback's steps including it. Silent steps of a
    group seen in the range or the lookback before it have a row too. Where no lookback has more
    than ``frame_steps`` steps they are frames of one window, the cheaper way for few steps; else
    they are put together from blocks, so a step never costs more than a frame of that many.
    """
    step_s = whole("step_s", step_s, 1)
    first = from_s - from_s % step_s
    last = (to_s - 1) - (to_s - 1) % step_s
    rules = with_series(rules, step_s)
    # one number: how many steps the longest lookback has
    longest = rules.agg(F.max("lookback_s")).first()[0] or step_s
    base = first - longest + step_s
    kind = ts_type(points, "ts")

    seconds = F.unix_timestamp("ts")
    read = time_range(points, base, to_s)
    sets = average_sets(read, rules, seconds - F.pmod(seconds, F.lit(step_s)))
    cells = (
        series_steps(sets, rules)
        .withColumn("step", F.coalesce("step", F.lit(first)))
        .join(rules.drop("metric", "scope", "by", "space_agg"), "series")
    )

    # One row per step of a group from here on, so a partition is as long as the range at most.
    # The number of tasks is stated: the rows multiply after this shuffle, and sized by what
    # arrives, adaptive execution would merge too many of them into one task.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, "rule_id", "group")
    # Fill the silent steps: each row also stands for the gap up to the next one, the first one
    # for those back to the range, and for blocks to a lookback before it.
    framed = longest <= frame_steps * step_s
    by_step = Window.partitionBy("rule_id", "group").orderBy("step")
    is_first = F.lag("step").over(by_step).isNull()
    until = F.coalesce(F.lead("step").over(by_step) - step_s, F.lit(last))
    filled = (
        cells.withColumns(
            {
                "_from": F.when(
                    is_first, F.least("step", F.lit(first) - (F.lit(0) if framed else F.col("lookback_s")))
                ).otherwise(F.col("step")),
                "_to": until,
            }
        )
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn("at", F.explode(F.sequence("_from", "_to", F.lit(step_s).cast("long"))))
        .withColumn("value", F.when(F.col("at") == F.col("step"), F.col("value")))
    )
    if framed:
        parts = _framed(filled, base, longest, step_s)
    else:
        number = F.expr(f"(at - {base - step_s}) div {step_s}")
        parts = trailing(filled, number, F.expr(f"lookback_s div {step_s}"))
    return (
        parts.filter(F.col("at") >= first)
        .withColumn("value", chosen("time_agg"))
        .select(
            "rule_id",
            "group",
            seconds_to_ts(F.col("at"), kind).alias("ts"),
            "value",
            state("value").alias("state"),
        )
    )


def _framed(filled: DataFrame, base: int, longest: int, step_s: int) -> DataFrame:
    """The parts of ``accumulate`` over each row's lookback, as frames of one window.

    Frames take constant bounds but each rule has its own lookback, so time is measured in
    lookbacks: a frame just short of one holds the current step and those after ``at - lookback``.
    """
    ticks = F.call_function("div", (F.col("at") - F.lit(base)) * F.lit(_TICKS), F.col("lookback_s"))
    slack = _TICKS * step_s // (2 * longest)
    frame = Window.partitionBy("rule_id", "group").orderBy(ticks).rangeBetween(-(_TICKS - slack), 0)
    return filled.withColumns(
        {
            "_sum": F.sum("value").over(frame),
            "_n": F.count("value").over(frame),
            "_min": F.min("value").over(frame),
            "_max": F.max("value").over(frame),
        }
    )


def trailing(filled: DataFrame, number: Column, width: Column) -> DataFrame:
    """Adds the parts of ``accumulate`` over each row's last ``width`` rows of its rule and group.

    ``number`` counts the rows of a group without gaps. The rows are cut into blocks as wide as
    the lookback: a trailing range is the end of one block and the beginning of the next, both of
    which are running aggregates. So a row costs the same for any lookback. All windows share the
    partitioning by rule and group.
    """
    keys = ["rule_id", "group"]
    cut = filled.withColumns({"_i": number, "_k": width}).withColumns(
        {"_block": F.expr("_i div _k"), "_rest": F.expr("_i % _k")}
    )

    def running(order: Column, upto: int) -> Column:
        frame = (
            Window.partitionBy(*keys, "_block")
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, upto)
        )
        return F.struct(
            F.sum("value").over(frame).cast("double").alias("sum"),
            F.count("value").over(frame).alias("n"),
            F.min("value").over(frame).cast("double").alias("min"),
            F.max("value").over(frame).cast("double").alias("max"),
        )

    # what follows a row in its block is still in range one lookback later, at the next row of
    # its residue class
    in_class = Window.partitionBy(*keys, "_rest").orderBy("_i")
    joined = (
        cut.withColumn("_head", running(F.col("_i").asc(), 0))
        .withColumn("_tail", running(F.col("_i").desc(), -1))
        .withColumn("_old", F.lag("_tail").over(in_class))
    )
    head, tail = F.col("_head"), F.col("_old")
    return joined.withColumns(
        {
            "_sum": F.coalesce(head["sum"] + tail["sum"], head["sum"], tail["sum"]),
            "_n": head["n"] + F.coalesce(tail["n"], F.lit(0)),
            "_min": F.least(head["min"], tail["min"]),
            "_max": F.greatest(head["max"], tail["max"]),
        }
    ).drop("_i", "_k", "_block", "_rest", "_head", "_tail", "_old")
