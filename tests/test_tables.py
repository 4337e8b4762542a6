"""Laid-out tables: what a read by time or by id leaves out, from the plan's own metrics."""

import pytest
from pyspark.sql import functions as F

from watchpost.operators.filters import get_by_id, time_range
from watchpost.sources.entities import read_entity
from watchpost.sources.tables import write_entity

T0 = 1_704_067_200


def scanned(df):
    """(rows out, files read, rows the scan put out) of a query that ran."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, *(scan.metrics().apply(m).value() for m in ("numFiles", "numOutputRows"))


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Ten days of logs with ids in no order, a third of them in one day."""
    path = str(tmp_path_factory.mktemp("laid") / "logs")
    at = F.when(F.col("id") % 3 == 0, 86_400 * 4 + F.col("id") % 86_400).otherwise(F.col("id") * 29 % 864_000)
    rows = spark.range(60_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.timestamp_seconds(at + T0).alias("ts"),
        F.lit("info").alias("status"), F.lit("m").alias("message"), F.lit("web").alias("service"),
        F.lit("h").alias("host"), F.array(F.lit("a:b")).alias("tags"),
    )
    write_entity(rows, "logs", path, files=12, row_group_bytes=256 << 10, distinct_ids=5000)
    return path


def test_an_hour_reads_one_day_and_a_part_of_it(spark, logs):
    table = read_entity(spark, "logs", logs)
    low = T0 + 86_400 * 4 + 3600 * 5
    rows, files, out = scanned(time_range(table, low, low + 3600, day_col="dt"))
    all_rows, all_files, _ = scanned(table)
    assert len(rows) == table.filter(F.unix_timestamp("ts").between(low, low + 3599)).count() > 100
    assert files < all_files / 4 and out < len(all_rows) / 5


def test_an_id_is_found_in_few_row_groups(spark, logs):
    import hashlib

    table = read_entity(spark, "logs", logs)
    wanted = hashlib.sha256(b"777").hexdigest()
    rows, _, out = scanned(get_by_id(table, wanted))
    assert [r["id"] for r in rows] == [wanted] and out < 60_000 / 4
    # an id nobody has, in the middle of all ids: only Bloom filters can tell
    rows, _, out = scanned(get_by_id(table, "7" + "f" * 63))
    assert rows == [] and out == 0


def test_round_trip_and_arguments(spark, tmp_path):
    rows = spark.sql(
        "SELECT 5L AS id, array('a:b') AS scope, timestamp'2024-01-01' AS ts_start, CAST(NULL AS timestamp) AS ts_end,"
        " 'm' AS message, 'UTC' AS timezone, 1L AS monitor_id, array('x') AS monitor_tags,"
        " CAST(NULL AS struct<type: string, period: int, week_days: array<string>, until: timestamp>) AS recurrence,"
        " true AS active, false AS disabled, CAST(NULL AS timestamp) AS created, 1L AS creator_id,"
        " CAST(NULL AS timestamp) AS updated_at"
    )
    path = str(tmp_path / "d")
    write_entity(rows, "downtimes", path, files=1)
    assert read_entity(spark, "downtimes", path).collect() == rows.collect()
    with pytest.raises(ValueError, match="scope"):
        write_entity(rows.drop("scope"), "downtimes", path, mode="overwrite")
    with pytest.raises(ValueError):
        write_entity(rows, "widgets", path)


def test_rows_without_a_time_are_kept(spark, tmp_path):
    rows = spark.sql(
        "SELECT * FROM VALUES ('h', timestamp'2024-01-01 05:00:00', 1L), ('h', CAST(NULL AS timestamp), 2L) AS r(host, ts, seq)"
    ).selectExpr("*", "'mute' AS action", "CAST(NULL AS timestamp) AS mute_end", "false AS override", "'m' AS message")
    path = str(tmp_path / "m")
    write_entity(rows, "mute_commands", path, files=2)
    assert sorted(r["seq"] for r in read_entity(spark, "mute_commands", path).collect()) == [1, 2]
