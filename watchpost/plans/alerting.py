"""From points to a report: which monitors alert, and which alerts a downtime covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.downtimes import expand_downtimes, flag_suppressed
from ..operators.monitors import evaluate_monitors_over
from ..session import scratch_root


def rule_alerts(states: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluated states as alert rows: the group's labels are the alert's tags."""
    from_rule = rules.select("rule_id", F.col("scope").alias("monitor_tags"))
    return (
        states.filter(F.col("state") == "Alert")
        .join(from_rule, "rule_id")
        .select(
            F.concat_ws("|", "rule_id", "group", F.unix_timestamp("ts")).alias("alert_id"),
            "ts",
            F.split("group", ",").alias("tags"),
            F.col("rule_id").alias("monitor_id"),
            "monitor_tags",
            "rule_id",
            "group",
            "value",
        )
    )


def alert_report(
    points: DataFrame,
    rules: DataFrame,
    downtimes: DataFrame,
    from_s: int,
    to_s: int,
    step_s: int = 60,
) -> DataFrame:
    """Per rule, how many evaluations alerted and how many of those fell in a downtime."""
    states = evaluate_monitors_over(points, rules, from_s, to_s, step_s)
    # suppression reads the alerts twice; written once, the points are evaluated once
    scratch_root(points.sparkSession)
    alerts = rule_alerts(states, rules).checkpoint()
    flagged = flag_suppressed(alerts, expand_downtimes(downtimes, to_s))
    return flagged.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if("suppressed").alias("suppressed")
    )
