import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from watchpost.operators.downtimes import cancel, covers, expand_downtimes, flag_suppressed, rejected_downtimes, suppress

DDL = (
    "id long, scope array<string>, a string, b string, timezone string, monitor_id long,"
    " monitor_tags array<string>, type string, period int, week_days array<string>, until string,"
    " disabled boolean"
)


def downtimes(spark, rows, kind="timestamp_ntz"):
    df = spark.createDataFrame(rows, DDL)
    return df.select(
        "id", "scope", F.col("a").cast(kind).alias("ts_start"), F.col("b").cast(kind).alias("ts_end"),
        "timezone", "monitor_id", "monitor_tags",
        F.when(
            F.col("type").isNotNull(),
            F.struct("type", "period", "week_days", F.col("until").cast("timestamp").alias("until")),
        ).alias("recurrence"),
        "disabled",
    )


def row(id, a, b, type=None, period=None, days=None, until=None, tz=None, scope="host:a",
        monitor=None, tags=None, disabled=False):
    return (id, [scope], a, b, tz, monitor, tags, type, period, days, until, disabled)


def starts(spark, r, horizon, kind="timestamp_ntz"):
    seconds = datetime.fromisoformat(horizon).replace(tzinfo=timezone.utc).timestamp()
    out = expand_downtimes(downtimes(spark, [r], kind), seconds).orderBy("ts_start").collect()
    return [(x["occurrence"], str(x["ts_start"]), str(x["ts_end"])) for x in out]


def test_month_end_returns_to_the_31st(spark):
    got = starts(spark, row(1, "2024-01-31 10:00:00", "2024-01-31 11:00:00", "months", 1), "2024-06-01")
    assert [g[1][:10] for g in got] == ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30", "2024-05-31"]
    assert [g[0] for g in got] == [0, 1, 2, 3, 4]


def test_years_and_until(spark):
    got = starts(spark, row(1, "2024-02-29 00:00:00", "2024-02-29 01:00:00", "years", 2), "2031-01-01")
    assert [g[1][:10] for g in got] == ["2024-02-29", "2026-02-28", "2028-02-29", "2030-02-28"]
    got = starts(
        spark,
        row(1, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "days", 2, until="2024-01-05 00:00:00"),
        "2025-01-01",
    )
    assert [g[1][:10] for g in got] == ["2024-01-01", "2024-01-03"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_clock_time_stays_over_daylight_saving(spark, kind):
    # 09:00 in New York is 14:00 UTC before 2024-03-10 and 13:00 after
    got = starts(
        spark,
        row(1, "2024-03-09 14:00:00", "2024-03-09 15:30:00", "days", 1, tz="America/New_York"),
        "2024-03-12",
        kind,
    )
    assert [g[1] for g in got] == ["2024-03-09 14:00:00", "2024-03-10 13:00:00", "2024-03-11 13:00:00"]
    assert [g[2] for g in got][1] == "2024-03-10 14:30:00"


def test_week_days_follow_local_monday(spark):
    # Wednesday 2024-01-03; every second week on Mon and Fri
    got = starts(
        spark,
        row(1, "2024-01-03 08:00:00", "2024-01-03 09:00:00", "weeks", 2, ["Mon", "Fri"]),
        "2024-02-05",
    )
    assert [g[1][:10] for g in got] == ["2024-01-05", "2024-01-15", "2024-01-19", "2024-01-29", "2024-02-02"]
    plain = starts(spark, row(1, "2024-01-03 08:00:00", "2024-01-03 09:00:00", "weeks", 1), "2024-01-18")
    assert [g[1][:10] for g in plain] == ["2024-01-03", "2024-01-10", "2024-01-17"]


def test_single_occurrences(spark):
    assert starts(spark, row(1, "2024-01-03 08:00:00", None, "days", 1), "2024-02-01") == [
        (0, "2024-01-03 08:00:00", "None")
    ]
    assert starts(spark, row(1, None, "2024-01-03 08:00:00", "days", 1), "2024-02-01") == [
        (0, "None", "2024-01-03 08:00:00")
    ]
    assert starts(spark, row(1, "2024-03-03 08:00:00", "2024-03-03 09:00:00"), "2024-02-01") == []


def test_random_recurrence_against_python(spark):
    rng = random.Random(11)
    rows, want = [], set()
    horizon = datetime(2024, 12, 1)
    for i in range(60):
        tz = rng.choice(["UTC", "America/New_York", "Asia/Kolkata", "Australia/Sydney"])
        start = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(3000))
        kind = rng.choice(["days", "weeks", "months"])
        period = rng.randint(1, 3)
        days = rng.choice([None, ["Mon"], ["Tue", "Sun"], ["Sat"]]) if kind == "weeks" else None
        rows.append(row(i, str(start), str(start + timedelta(hours=2)), kind, period, days, tz=tz))
        zone = ZoneInfo(tz)
        local = start.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
        for k in range(400):
            if kind == "days":
                at = [local + timedelta(days=k * period)]
            elif kind == "weeks":
                names = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
                offs = [names.index(d) for d in days] if days else [local.weekday()]
                at = [local + timedelta(days=7 * k * period + o - local.weekday()) for o in offs]
            else:
                y, m = divmod(local.month - 1 + k * period, 12)
                last = (datetime(local.year + y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
                at = [local.replace(year=local.year + y, month=m + 1, day=min(local.day, last))]
            for a in at:
                # a clock time skipped by daylight saving moves on by the gap
                utc = a.replace(tzinfo=zone).astimezone(timezone.utc).replace(tzinfo=None)
                if start <= utc < horizon:
                    want.add((i, str(utc)))
    got = expand_downtimes(downtimes(spark, rows), horizon.replace(tzinfo=timezone.utc).timestamp())
    assert {(r["id"], str(r["ts_start"])) for r in got.collect()} == want


def naive(alert, ds):
    aid, ts, tags, mid, mtags = alert
    for d in ds:
        (_, scope, a, b, _, monitor, need, *_rest, disabled) = d
        if disabled or len(scope) != 1 or scope[0] not in (tags or []):
            continue
        if a and ts < a or b and ts >= b or a and b and b <= a:
            continue
        if monitor is not None and monitor != mid:
            continue
        if any(t not in (mtags or []) for t in need or []):
            continue
        return True
    return False


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_suppression_equals_nested_loops(spark, kind):
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    ds = []
    for i in range(150):
        start = t0 + timedelta(minutes=rng.randrange(60 * 24 * 30))
        length = rng.choice([1, 59, 60, 600, 60 * 30, 60 * 24 * 40, 60 * 24 * 1200, None])
        end = None if length is None else str(start + timedelta(minutes=length))
        scope = "env:hot" if rng.random() < 0.3 else f"host:h{rng.randrange(60)}"
        ds.append(
            row(i, None if rng.random() < 0.05 else str(start), end, scope=scope,
                monitor=rng.choice([None, None, 1, 2]),
                tags=rng.choice([None, [], ["t:a"], ["t:b", "t:a"]]),
                disabled=rng.random() < 0.1)
        )
    ds.append((999, ["host:h1", "env:x"], str(t0), None, None, None, None, None, None, None, None, False))
    ds.append(row(1000, "2024-01-05 00:00:00", "2024-01-04 00:00:00", scope="env:cold"))
    alerts = []
    for i in range(800):
        ts = t0 + timedelta(minutes=rng.randrange(60 * 24 * 31))
        tags = rng.choice([None, [], [f"host:h{rng.randrange(60)}", rng.choice(["env:hot", "env:cold"])]])
        alerts.append((i, str(ts), tags, rng.choice([None, 1, 2, 3]), rng.choice([None, ["t:a"], ["t:a", "t:b"]])))
    df = spark.createDataFrame(
        alerts, "alert_id long, t string, tags array<string>, monitor_id long, monitor_tags array<string>"
    ).withColumn("ts", F.col("t").cast(kind)).drop("t")
    table = downtimes(spark, ds, kind)
    want = {a[0] for a in alerts if naive(a, ds)}
    kept, hit = suppress(df, table, rows_per_task=7)
    hit_ids = [r["alert_id"] for r in hit.collect()]
    assert sorted(hit_ids) == sorted(want)
    assert sorted(r["alert_id"] for r in kept.collect()) == sorted(set(range(800)) - want)
    flagged = flag_suppressed(df, table)
    assert flagged.count() == 800 and flagged.filter("suppressed").count() == len(want)


def test_nothing_suppressed_without_downtimes(spark):
    alerts = spark.sql(
        "SELECT 1L AS alert_id, timestamp_ntz'2024-01-01' AS ts, array('a:b') AS tags,"
        " 1L AS monitor_id, array('x') AS monitor_tags"
    )
    kept, hit = suppress(alerts, downtimes(spark, []))
    assert kept.count() == 1 and hit.count() == 0


def test_overlapping_downtimes_collapse_in_a_bin(spark):
    # many downtimes of one scope across the same hours leave few rows
    rows = [
        row(i, f"2024-01-01 {i % 3:02d}:{i % 60:02d}:00", f"2024-01-01 20:{i % 60:02d}:00")
        for i in range(500)
    ]
    bins = covers(downtimes(spark, rows))
    per_bin = {r["bin"]: r["count"] for r in bins.groupBy("bin").count().collect()}
    assert max(per_bin.values()) <= 61
    assert sorted(per_bin.values())[len(per_bin) // 2] == 1


def test_cancel(spark):
    table = downtimes(spark, [row(1, None, None), row(2, None, None), row(3, None, None)])
    asked = spark.createDataFrame([(2,), (9,), (9,)], "downtime_id long")
    remaining, unknown = cancel(table, asked)
    assert sorted(r["id"] for r in remaining.collect()) == [1, 3]
    assert [r["downtime_id"] for r in unknown.collect()] == [9]


def test_rejects_are_listed_and_fail_nothing(spark):
    day = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    good = row(1, *day, "days", 1)
    several = list(row(2, *day))
    several[1] = ["host:a", "env:p"]
    none = list(row(5, *day))
    none[1] = None
    rows = [good, tuple(several), row(3, *day, "days", 1, tz="Mars/Base"), row(4, day[1], day[0]), tuple(none)]
    df = downtimes(spark, rows)
    assert {r["id"]: r["reason"] for r in rejected_downtimes(df).collect()} == {
        2: "several scopes", 3: "unknown time zone", 4: "end not after start", 5: "empty scope",
    }
    assert {r["id"] for r in expand_downtimes(df, 1704326400).collect()} >= {1, 2}
    assert 3 not in {r["id"] for r in expand_downtimes(df, 1704326400).collect()}


def test_overlapping_downtimes_become_disjoint_intervals(spark):
    rng = random.Random(9)
    t0 = datetime(2024, 1, 1)
    ds = []
    for i in range(120):
        start = t0 + timedelta(seconds=rng.randrange(40_000))
        end = None if i == 7 else str(start + timedelta(seconds=rng.randrange(1, 900)))
        ds.append(row(i, str(start), end, scope="env:a" if i % 3 else "env:b"))
    parts = covers(downtimes(spark, ds)).collect()
    for scope in ("env:a", "env:b"):
        own = sorted((r["start"], r["end"] or datetime(9999, 1, 1)) for r in parts if r["scope"] == scope and r["tier"] != 4)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert sum(r["end"] is None for r in parts) == 1


def test_a_hot_scope_of_open_downtimes_is_spread(spark):
    """A third of all alerts on one scope, which has hundreds of downtimes without end."""
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    ds = [row(i, str(t0 + timedelta(minutes=10 + i)), None, scope="env:hot") for i in range(300)]
    ds += [row(400 + i, str(t0), str(t0 + timedelta(hours=5)), scope=f"host:h{i}") for i in range(20)]
    alerts = [
        (i, str(t0 + timedelta(minutes=rng.randrange(700))), ["env:hot"] if i % 3 == 0 else [f"host:h{i % 41}"], 1, ["x"])
        for i in range(3000)
    ]
    df = spark.createDataFrame(
        alerts, "alert_id long, t string, tags array<string>, monitor_id long, monitor_tags array<string>"
    ).withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    table = downtimes(spark, ds)
    kept, hit = suppress(df, table, rows_per_task=100)
    want = {a[0] for a in alerts if naive(a, ds)}
    assert sorted(r["alert_id"] for r in hit.collect()) == sorted(want)
    assert kept.count() == 3000 - len(want)
    # a thousand alerts of one key meet ten copies of one downtime row, not one of three hundred
    assert covers(table).filter("scope = 'env:hot'").count() == 1
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert "_salts" in plan
