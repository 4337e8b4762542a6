"""Listings: the columns each kind is shown with. None of them shuffles."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame, functions as F

from ..functions.times import from_ts

# fixed values: units and week days of a recurrence
RECURRENCE_UNITS = ("days", "weeks", "months", "years")
WEEK_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def monitor_listing(df: DataFrame) -> DataFrame:
    """Monitors with defaults for missing fields; an empty state also lists as ``unknown``."""
    state = F.col("overall_state")
    return df.select(
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("id", F.lit(0)).alias("id"),
        F.when(state.isNull() | (state == ""), "unknown").otherwise(state).alias("status"),
        "message",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("query", F.lit("")).alias("query"),
        from_ts("modified", "s").alias("lastUpdatedTs"),
    )


def host_listing(df: DataFrame, base_url: str) -> DataFrame:
    """Hosts under their listing names, each with a link; a nameless host has no link."""
    columns = [
        "name",
        "id",
        "aliases",
        "apps",
        F.col("is_muted").alias("mute"),
        from_ts("last_reported", "s").alias("last_reported"),
        "meta",
        "metrics",
        "sources",
        "up",
        F.concat(F.lit(base_url), "name").alias("url"),
    ]
    if "mute_end" in df.columns:
        columns.append(from_ts("mute_end", "s").alias("mute_end"))
    # hosts read without their metadata columns simply list without them
    have = set(df.columns)
    return df.select(*[c for c in columns if not isinstance(c, str) or c in have])


def dashboard_listing(df: DataFrame, base_url: str) -> DataFrame:
    """Dashboards, all fields kept, each with a link."""
    return df.withColumn("url", F.concat(F.lit(base_url), F.col("id").cast("string")))


def host_details(df: DataFrame, mutes: bool = False, metadata: bool = False) -> DataFrame:
    """Drop the optional column groups that were not asked for, so they are not read."""
    drop = [] if mutes else ["mute_end", "mute_message"]
    if not metadata:
        drop.append("meta")
    return df.drop(*drop)


def normalise_downtimes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Downtime requests as downtime rows, and the rejected requests with a reason.

    The scope becomes a one-element array. ``until`` is kept; expansion honours it.
    """
    units, days = _quoted(RECURRENCE_UNITS), _quoted(WEEK_DAYS)
    # in order of precedence; a null test is not a reason
    reason = F.expr(
        f"""CASE
        WHEN scope IS NULL OR scope = '' THEN 'empty scope'
        WHEN end <= start THEN 'end not after start'
        WHEN recurrence IS NOT NULL AND NOT coalesce(recurrence.type IN ({units}), false)
          THEN 'unknown recurrence type'
        WHEN recurrence IS NOT NULL AND NOT coalesce(recurrence.period >= 1, false)
          THEN 'recurrence period below 1'
        WHEN recurrence.period <> floor(recurrence.period)
          THEN 'recurrence period not a whole number'
        WHEN size(array_except(recurrence.week_days, array({days}))) > 0
          THEN 'unknown week day'
        WHEN NOT {known_zone("timezone")} THEN 'unknown time zone' END"""
    )
    judged = requests.withColumn("reason", reason)
    valid = judged.filter("reason IS NULL").selectExpr(
        "id",
        "array(scope) AS scope",
        "timestamp_seconds(start) AS ts_start",
        "timestamp_seconds(end) AS ts_end",
        "message",
        "timezone",
        "monitor_id",
        "monitor_tags",
        "IF(recurrence IS NULL, NULL, struct(recurrence.type AS type,"
        " CAST(recurrence.period AS INT) AS period, recurrence.week_days AS week_days,"
        " timestamp_seconds(recurrence.until) AS until)) AS recurrence",
        "CAST(NULL AS BOOLEAN) AS active",
        "false AS disabled",
    )
    return valid, judged.filter("reason IS NOT NULL")


def known_zone(column: str) -> str:
    """SQL: whether a time zone is none at all, a region's name, or an offset such as +02:00."""
    names = _quoted(tuple(sorted(available_timezones())))
    return f"coalesce({column} IN ({names}) OR {column} RLIKE '^[+-](0[0-9]|1[0-8]):[0-5][0-9]$', true)"


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)
