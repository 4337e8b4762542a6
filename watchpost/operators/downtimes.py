"""Downtimes: recurrence, suppression of alerts, cancellation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.checks import whole
from ..functions.times import require_utc, ts_sql, ts_type
from ..session import scratch_root
from .projections import WEEK_DAYS, known_zone

HOUR, DAY = 3600, 86_400
# Bin width for downtimes up to the given length: a downtime meets a few dozen bins at most,
# however long it is. Still longer ones take the widest bins; open ones have no bins at all.
TIERS = ((HOUR, DAY), (DAY, 30 * DAY), (30 * DAY, 1000 * DAY), (1000 * DAY, None))
OPEN = len(TIERS)
FOREVER_S = 253_370_764_800  # 9999-01-01, the end of an open downtime
#: alerts of one scope, bin and restriction that go to one task
ROWS_PER_TASK = 200_000


def rejected_downtimes(downtimes: DataFrame) -> DataFrame:
    """Stored downtimes that cannot cover anything, with a ``reason``.

    Expansion and suppression leave these out; reading them here is how one hears of it.
    """
    reason = F.expr(
        f"""CASE WHEN coalesce(size(scope), 0) <= 0 THEN 'empty scope'
        WHEN size(scope) > 1 THEN 'several scopes'
        WHEN ts_end <= ts_start THEN 'end not after start'
        WHEN NOT {known_zone("timezone")} THEN 'unknown time zone' END"""
    )
    return downtimes.withColumn("reason", reason).filter("reason IS NOT NULL")


def expand_downtimes(downtimes: DataFrame, horizon_s: float) -> DataFrame:
    """Every occurrence starting before the horizon or ``until``, whichever is earlier.

    Occurrence i starts ``i * period`` units after the first, in the downtime's own time zone:
    a clock time stays put over daylight saving, and the 31st falls on the last day of shorter
    months without drifting. Weeks start on Monday. A downtime without recurrence, start or end
    has the one occurrence it states. Adds ``occurrence``, numbered from 0 in the recurrence.
    Downtimes of an unknown time zone have none; ``rejected_downtimes`` lists them.
    """
    require_utc(downtimes.sparkSession)
    kind = ts_type(downtimes, "ts_start")
    ts = kind.simpleString()
    days = ", ".join(f"'{d}'" for d in WEEK_DAYS)
    planned = (
        downtimes.filter(known_zone("timezone")).selectExpr(
            "*",
            "coalesce(timezone, 'UTC') AS _zone",
            f"least(CAST(recurrence.until AS {ts}), {ts_sql(horizon_s, kind)}) AS _limit",
            "IF(ts_start IS NULL OR ts_end IS NULL, 'once', coalesce(recurrence.type, 'once'))"
            " AS _unit",
            "coalesce(recurrence.period, 1) AS _period",
        )
        .selectExpr(
            "*",
            "convert_timezone('UTC', _zone, CAST(ts_start AS timestamp_ntz)) AS _first",
            "convert_timezone('UTC', _zone, CAST(_limit AS timestamp_ntz)) AS _stop",
        )
        .selectExpr(
            "*",
            # the highest index that can start before the limit, or one more
            """CASE _unit WHEN 'once' THEN 0
                 WHEN 'days' THEN greatest(date_diff(_stop, _first), 0) div _period
                 WHEN 'weeks' THEN (greatest(date_diff(_stop, _first), 0) + 7) div (7 * _period)
                 ELSE greatest(12 * (year(_stop) - year(_first)) + month(_stop) - month(_first), 0)
                      div (_period * IF(_unit = 'years', 12, 1)) END AS _last""",
            # week days as distances from the first occurrence; none given means its own
            f"""CASE WHEN _unit = 'weeks' AND size(recurrence.week_days) > 0
                 THEN transform(filter(sequence(0, 6), d ->
                        array_contains(recurrence.week_days, array({days})[d])),
                      d -> d - weekday(_first))
                 ELSE array(0) END AS _shifts""",
        )
    )
    runs = f"""filter(
        flatten(transform(sequence(0, CAST(_last AS INT)), i -> transform(_shifts, s -> struct(
          i AS occurrence,
          IF(_unit = 'once', ts_start, CAST(convert_timezone(_zone, 'UTC', _first
            + make_ym_interval(0, CASE _unit WHEN 'months' THEN i * _period
                                  WHEN 'years' THEN 12 * i * _period ELSE 0 END)
            + make_dt_interval(CASE _unit WHEN 'days' THEN i * _period
                               WHEN 'weeks' THEN 7 * i * _period + s ELSE 0 END)) AS {ts})
          ) AS at)))),
        r -> IF(_unit = 'once', coalesce(r.at < _limit, true), r.at < _limit AND r.at >= ts_start))"""
    kept = [c for c in downtimes.columns if c not in ("ts_start", "ts_end")]
    return (
        planned.selectExpr("*", f"explode({runs}) AS _run")
        .selectExpr(
            *[f"`{c}`" for c in kept],
            "_run.occurrence AS occurrence",
            "_run.at AS ts_start",
            "_run.at + (ts_end - ts_start) AS _moved_end",
            "ts_end",
            "_unit",
        )
        .withColumn("ts_end", F.expr("IF(_unit = 'once', ts_end, _moved_end)"))
        .select(*downtimes.columns, "occurrence")
    )


def islands(flat: DataFrame, kind) -> DataFrame:
    """Overlapping and touching intervals of one scope and restriction as one; open if one is.

    Rows are (scope, only, monitor_id, need, start, end), a null end meaning open.
    """
    keys = ["scope", "only", "monitor_id", "need"]
    far = ts_sql(FOREVER_S, kind)
    # of those starting together only the last to end matters
    longest = flat.groupBy(*keys, "start").agg(F.max(F.expr(f"coalesce(end, {far})")).alias("end"))
    by_start = Window.partitionBy(*keys).orderBy("start")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    numbered = longest.withColumn(
        "_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")
    ).withColumn("_island", F.sum("_new").over(by_start))
    merged = numbered.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    return merged.drop("_island").withColumn("end", F.expr(f"IF(end < {far}, end, NULL)"))


def covers(downtimes: DataFrame) -> DataFrame:
    """Downtimes as disjoint intervals, cut into time bins and clipped to them.

    Downtimes of one scope and restriction are merged first, so however many overlap, an instant
    meets one row of a restriction, and open ones come to one row each. Disabled and
    wrong-way-round downtimes cover nothing; so do those with several scopes, which have no
    defined meaning and are listed by ``rejected_downtimes``. A missing start means always begun.

    ``only`` is what an alert must carry besides the scope: its monitor, one of the monitor
    tags, or nothing.
    """
    kind = ts_type(downtimes, "ts_start")
    epoch = ts_sql(0, kind)
    tiers = " ".join(
        f"WHEN _b - _a <= {limit} THEN {n}" for n, (_, limit) in enumerate(TIERS) if limit
    )
    widths = ", ".join(f"{w}L" for w, _ in TIERS)
    flat = (
        downtimes.filter("NOT coalesce(disabled, false) AND size(scope) = 1")
        .selectExpr(
            "scope[0] AS scope",
            "CASE WHEN monitor_id IS NOT NULL THEN concat('m:', monitor_id)"
            " WHEN size(monitor_tags) > 0 THEN concat('t:', monitor_tags[0]) ELSE '-' END AS only",
            "monitor_id",
            "array_sort(coalesce(monitor_tags, array())) AS need",
            f"coalesce(ts_start, {epoch}) AS start",
            "ts_end AS end",
        )
        .filter("end IS NULL OR end > start")
    )
    tiered = islands(flat, kind).selectExpr(
        "*", "unix_timestamp(start) AS _a", "unix_timestamp(end) AS _b"
    ).selectExpr(
        "*",
        f"CASE WHEN end IS NULL THEN {OPEN} {tiers} ELSE {OPEN - 1} END AS tier",
    )
    cut = tiered.selectExpr(
        "*", f"IF(tier = {OPEN}, NULL, element_at(array({widths}, 0L), tier + 1)) AS _w"
    ).selectExpr(
        "*",
        f"""explode(IF(tier = {OPEN}, array(struct(0L AS bin, start, end)),
            transform(sequence({_floor_div('_a', '_w')}, {_floor_div('_b', '_w')}), b -> struct(
              b AS bin,
              greatest(start, {epoch} + make_dt_interval(0, 0, 0, b * _w)) AS start,
              least(end, {epoch} + make_dt_interval(0, 0, 0, (b + 1) * _w)) AS end)))) AS _p""",
    )
    return cut.selectExpr(
        "scope", "only", "monitor_id", "need", "tier",
        "_p.bin AS bin", "_p.start AS start", "_p.end AS end",
    ).filter("end IS NULL OR end > start")


def _floor_div(a: str, b: str) -> str:
    return f"({a} - pmod({a}, {b})) div {b}"


def covered_alerts(
    alerts: DataFrame, downtimes: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The ids of alerts inside a downtime: same scope, time in ``[start, end)``, restrictions.

    An alert comes once for each of its tags that is covered.

    An equi-join on scope, time bin and restriction, so a task looks at the downtimes of one
    bin. The alerts of each such key are counted; those of a key with more than
    ``rows_per_task`` are spread over as many copies of its downtime rows as make that many
    each, so a hot scope is no hot task. Spark broadcasts a side when it measures small enough;
    nothing forces it to.
    """
    spark = alerts.sparkSession
    require_utc(spark)
    rows_per_task = whole("rows_per_task", rows_per_task, 1)
    scratch_root(spark)
    # read several times below, so it is written once
    marks = covers(downtimes).checkpoint()
    # What kinds of downtime a scope has at all, at most 15: alerts are only probed for those,
    # and tags no downtime names go no further.
    kinds = marks.selectExpr("scope", "tier", "left(only, 1) AS how").distinct()
    widths = ", ".join(f"{w}L" for w, _ in TIERS)
    place = _floor_div("unix_timestamp(ts)", f"element_at(array({widths}, 1L), tier + 1)")
    rows = (
        alerts.selectExpr(
            "alert_id",
            "ts",
            "monitor_id AS has_id",
            "coalesce(monitor_tags, array()) AS has",
            "explode(array_distinct(tags)) AS scope",
        )
        .join(kinds, "scope")
        .selectExpr(
            "*",
            f"IF(tier = {OPEN}, 0L, {place}) AS bin",
            "explode(CASE how WHEN '-' THEN array('-') WHEN 'm' THEN array(concat('m:', has_id))"
            " ELSE transform(has, t -> concat('t:', t)) END) AS only",
        )
    )
    keys = ["scope", "tier", "bin", "only"]
    # counted per task before the exchange; one row stays for each ``rows_per_task`` alerts or more
    hot = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .selectExpr(*keys, f"CAST(ceil(_n / {rows_per_task}) AS INT) AS _salts")
        .checkpoint()
    )
    salted = rows.join(hot, keys, "left").selectExpr(
        "*", "CAST(pmod(xxhash64(alert_id), coalesce(_salts, 1)) AS INT) AS salt"
    )
    marks = marks.join(hot, keys, "left").selectExpr(
        "*", "explode(sequence(0, coalesce(_salts, 1) - 1)) AS salt"
    )
    same = " AND ".join(f"r.{k} = m.{k}" for k in [*keys, "salt"])
    covered = F.expr(
        f"""{same} AND r.ts >= m.start AND (m.end IS NULL OR r.ts < m.end)
        AND (m.monitor_id IS NULL OR r.has_id = m.monitor_id)
        AND size(array_except(m.need, r.has)) = 0"""
    )
    hits = salted.alias("r").join(marks.alias("m"), covered, "left_semi")
    return hits.select("alert_id")


def flag_suppressed(
    alerts: DataFrame, downtimes: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Alerts with a ``suppressed`` column.

    The alerts are read three times, twice for their tags: hand in a table, or checkpoint what is
    costly to compute.
    """
    hit = covered_alerts(alerts, downtimes, rows_per_task).distinct().withColumn("_hit", F.lit(True))
    return (
        alerts.join(hit, "alert_id", "left")
        .withColumn("suppressed", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def suppress(
    alerts: DataFrame, downtimes: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> tuple[DataFrame, DataFrame]:
    """The alerts outside all downtimes, and those inside one."""
    hit = covered_alerts(alerts, downtimes, rows_per_task)
    return (
        alerts.join(hit, "alert_id", "left_anti"),
        alerts.join(hit, "alert_id", "left_semi"),
    )


def cancel(downtimes: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The downtimes that remain, and the cancelled ids that no downtime has."""
    asked = cancels.select(F.col("downtime_id").alias("id")).distinct()
    unknown = asked.join(downtimes.select("id"), "id", "left_anti")
    return (
        downtimes.join(asked, "id", "left_anti"),
        unknown.select(F.col("id").alias("downtime_id")),
    )
