"""Counts and distinct listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.times import ts_lit, ts_type
from ..plans.layout import TOPK_ROWS
from .paging import latest

# The state texts that are counted, and the name of each counter.
STATE_COUNTERS = {
    "Alert": "alert",
    "Warn": "warn",
    "No Data": "noData",
    "OK": "ok",
    "Ignored": "ignored",
    "Skipped": "skipped",
    "Unknown": "unknown",
}


def monitor_summary(df: DataFrame) -> DataFrame:
    """One row of monitor counts by state; null and unrecognised states are not counted."""
    return df.agg(
        *[
            F.count_if(F.col("overall_state") == state).alias(name)
            for state, name in STATE_COUNTERS.items()
        ]
    )


def all_services(logs: DataFrame, limit: int = 1000, topk_rows: int = TOPK_ROWS) -> DataFrame:
    """Distinct service names among the latest ``limit`` logs, in alphabetical order."""
    # only the order key and the service travel to the top-k
    page = latest(logs.select("ts", "id", "service"), limit, topk_rows)
    named = page.filter(F.col("service") != "")
    return named.select("service").distinct().orderBy("service")


def active_hosts(hosts: DataFrame, as_of_s: float, lookback_s: float = 7200) -> DataFrame:
    """Hosts that reported within the lookback, and how many of them are up."""
    since = ts_lit(as_of_s - lookback_s, ts_type(hosts, "last_reported"))
    return hosts.filter(F.col("last_reported") >= since).agg(
        F.count(F.lit(1)).alias("total_active"), F.count_if("up").alias("total_up")
    )
