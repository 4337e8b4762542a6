"""The sample star-schema tables read as telemetry.

Each function maps whole sample tables to one canonical table. Nothing here is sampled or
capped, and the mappings are plain projections, except hosts (last event per user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.projections import normalise_downtimes

START = "1704067200"  # 2024-01-01 in epoch seconds


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "ts",
        "IF(event_type = 'error', 'error', 'info') AS status",
        "concat(event_type, ' ', props) AS message",
        "CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN ''"
        " ELSE concat('svc-', event_id % 7) END AS service",
        "concat('host-', user_id) AS host",
        "array(concat('host:host-', user_id), concat('kind:', event_type)) AS tags",
    )


def points_of(events: DataFrame) -> DataFrame:
    """Shared by batch and stream. The values have two decimals: kept as such, sums are exact."""
    return events.selectExpr(
        "concat('app.', event_type) AS metric",
        "ts",
        "CAST(value AS DECIMAL(18,2)) AS value",
        "array(concat('host:host-', user_id), concat('env:', user_id % 3)) AS tags",
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(_table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a file stream, with the event time type streams need."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def event_batches(spark: SparkSession, sf_dir: str, path: str, batches: int = 4) -> DataFrame:
    """The events as a file stream of ``batches`` micro-batches, in order of time.

    All events are written once more below ``path``, a range of time to a file.
    """
    events = _table(spark, sf_dir, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    for k in range(batches):
        part = events
        if k:
            part = part.filter(F.col("ts") >= F.lit(low + (high - low) * k / batches))
        if k < batches - 1:
            part = part.filter(F.col("ts") < F.lit(low + (high - low) * (k + 1) / batches))
        part.coalesce(1).write.parquet(f"{path}/part-{k}")
    stream = (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{path}/part-*")
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_linenumber AS BIGINT) AS span_id",
        "l_orderkey AS trace_id",
        "IF(l_linenumber > 1, 1L, NULL) AS parent_id",
        "concat('svc-', l_returnflag) AS service",
        "concat('op-', l_linestatus) AS operation",
        "concat('/parts/', l_partkey) AS resource",
        "l_shipdate AS ts",
        "CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 AS duration_ns",
        "IF(l_discount >= 0.09D, 1, 0) AS error",
        "map('http.status_code',"
        " CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN '500' WHEN 1 THEN '404' ELSE '200' END,"
        " 'supplier.id', CAST(l_suppkey AS STRING)) AS meta",
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "concat('Incident ', o_orderkey) AS title",
        "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'active' ELSE 'stable' END"
        " AS status",
        "concat('SEV-', left(o_orderpriority, 1)) AS severity",
        "o_orderdate AS created",
        "o_orderdate + make_dt_interval(0, CAST(o_custkey % 72 AS INT)) AS modified",
        "IF(o_orderkey % 11 <> 0, o_totalprice > 250000, NULL) AS customer_impacted",
    )


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors in all seven states, in one nobody knows, with an empty one and with none."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "IF(p_partkey % 23 <> 0, p_name, NULL) AS name",
        "'metric alert' AS type",
        "IF(p_size >= 5, concat('size ', p_size), NULL) AS message",
        "IF(p_partkey % 29 <> 0, array(concat('brand:', p_brand), concat('type:', p_type)), NULL)"
        " AS tags",
        "IF(p_partkey % 2 = 0, concat('avg:part.price{id:', p_partkey, '}'), NULL) AS query",
        "CASE p_partkey % 10 WHEN 0 THEN 'Alert' WHEN 1 THEN 'Warn' WHEN 2 THEN 'No Data'"
        " WHEN 3 THEN 'OK' WHEN 4 THEN 'Ignored' WHEN 5 THEN 'Skipped' WHEN 6 THEN 'Unknown'"
        " WHEN 7 THEN 'Paused' WHEN 9 THEN '' END AS overall_state",
        "timestamp_ntz'2024-01-01 00:00:00' AS created",
        "IF(p_partkey % 13 <> 0, timestamp_ntz'2024-01-01 00:00:00.5'"
        " + make_dt_interval(0, 0, CAST(p_partkey AS INT)), NULL) AS modified",
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # combined per task before the shuffle: one row per user travels
    seen = (
        _table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.max("ts").alias("last_reported"),
            F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
        )
    )
    customers = _table(spark, sf_dir, "customer")
    return customers.join(seen, customers["c_custkey"] == seen["user_id"], "left").selectExpr(
        "c_custkey AS id",
        "concat('host-', c_custkey) AS name",
        "array(lower(c_name)) AS aliases",
        "array(lower(c_mktsegment)) AS apps",
        "false AS is_muted",
        "last_reported",
        "map('platform', lower(c_mktsegment)) AS meta",
        "map('load', c_acctbal) AS metrics",
        "array('agent') AS sources",
        "coalesce(last_type <> 'error', false) AS up",
        "array(concat('nation:', c_nationkey)) AS tags",
    )


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "IF(doc_id % 17 <> 0, text, NULL) AS title",
        "IF(doc_id % 19 <> 0, concat(lang, ',', source), NULL) AS description",
        "'custom_timeboard' AS type",
        "IF(doc_id % 2 = 0, 'ordered', 'free') AS layout_type",
    )


def downtime_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as callers write them, some of them invalid."""
    start = f"{START} + s_suppkey * 37 % 600 * 3600"
    asked = _table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "CASE WHEN s_suppkey % 13 = 12 THEN ''"
        " WHEN s_suppkey % 5 = 0 THEN concat('env:', s_suppkey % 3)"
        " ELSE concat('host:host-', s_suppkey) END AS scope",
        f"IF(s_suppkey % 31 <> 30, {start}, NULL) AS start",
        f"IF(s_suppkey % 10 <> 3, {start} + s_suppkey % 48 * 3600, NULL) AS end",
        "IF(s_suppkey % 2 = 0, concat('maintenance ', s_suppkey), NULL) AS message",
        "CASE s_suppkey % 6 WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/Paris'"
        " WHEN 3 THEN 'UTC' END AS timezone",
        "IF(s_suppkey % 7 = 4, s_suppkey % 8, NULL) AS monitor_id",
        "IF(s_suppkey % 9 = 5, array(concat('env:', s_suppkey % 3)), NULL) AS monitor_tags",
        "CASE WHEN s_suppkey % 16 IN (1, 5, 9) THEN 'days' WHEN s_suppkey % 16 IN (2, 6, 10)"
        " THEN 'weeks' WHEN s_suppkey % 16 IN (3, 11) THEN 'months'"
        " WHEN s_suppkey % 16 = 7 THEN 'years' WHEN s_suppkey % 16 = 14 THEN 'hours' END AS unit",
        "IF(s_suppkey % 27 = 26, 0.5D, CAST(1 + s_suppkey % 3 AS DOUBLE)) AS period",
        "IF(s_suppkey % 8 = 2, array('Mon', 'Thu'), NULL) AS week_days",
        f"IF(s_suppkey % 5 = 2, {start} + 45 * 86400, NULL) AS until",
    )
    return asked.withColumn(
        "recurrence",
        F.expr(
            "IF(unit IS NOT NULL, struct(unit AS type, period, week_days, until), NULL)"
        ),
    ).drop("unit", "period", "week_days", "until")


def downtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid requests as downtimes with the timestamp type of the sample tables."""
    valid, _ = normalise_downtimes(downtime_requests(spark, sf_dir))
    return valid.withColumns(
        {
            "ts_start": F.col("ts_start").cast("timestamp_ntz"),
            "ts_end": F.col("ts_end").cast("timestamp_ntz"),
            "disabled": F.expr("id % 11 = 0"),
        }
    )


def downtime_cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh downtime, and for every fiftieth supplier an id nobody has."""
    return (
        _table(spark, sf_dir, "supplier")
        .selectExpr(
            "CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey WHEN s_suppkey % 50 = 1 THEN -s_suppkey"
            " END AS downtime_id"
        )
        .filter("downtime_id IS NOT NULL")
    )


def mute_commands_of(events: DataFrame) -> DataFrame:
    """Sign-ups mute, clicks unmute; shared by batch and stream."""
    return events.filter("event_type IN ('signup', 'click')").selectExpr(
        "concat('host-', user_id) AS host",
        "ts",
        "event_id AS seq",
        "IF(event_type = 'signup', 'mute', 'unmute') AS action",
        "IF(event_type = 'signup' AND event_id % 48 <> 0,"
        " ts + make_dt_interval(0, CAST(event_id % 48 * 4 AS INT)), NULL) AS mute_end",
        "event_type = 'signup' AND event_id % 3 = 0 AS override",
        "IF(event_type = 'signup', concat('muted by ', event_id), NULL) AS message",
    )


def mute_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mute_commands_of(_table(spark, sf_dir, "events"))


def error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as alerts of eight monitors."""
    return (
        _table(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .selectExpr(
            "event_id AS alert_id",
            "ts",
            "array(concat('host:host-', user_id), concat('env:', user_id % 3)) AS tags",
            "event_id % 8 AS monitor_id",
            "array(concat('env:', user_id % 3), 'team:ops') AS monitor_tags",
        )
    )


def monitor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules; the last is on a metric nobody sends."""
    return spark.sql(
        """
        SELECT CAST(id AS BIGINT) AS rule_id, metric, scope, by, space_agg, time_agg,
               CAST(lookback_s AS BIGINT) AS lookback_s, comparator,
               CAST(threshold AS DOUBLE) AS threshold
        FROM VALUES
          (1, 'app.error', array('*'), array('env'), 'avg', 'avg', 7200, '>', 52.13),
          (2, 'app.error', array('env:1'), array('host'), 'max', 'max', 14400, '>', 120.07),
          (3, 'app.purchase', CAST(array() AS ARRAY<STRING>), CAST(array() AS ARRAY<STRING>),
           'sum', 'min', 10800, '<', 90.11),
          (4, 'app.view', array('*'), array('env'), 'count', 'sum', 7200, '>=', 5),
          (5, 'app.click', array('env:2'), CAST(array() AS ARRAY<STRING>),
           'min', 'avg', 3600, '<=', 8.21),
          (6, 'app.absent', array('*'), array('host'), 'avg', 'avg', 3600, '>', 1)
          AS r(id, metric, scope, by, space_agg, time_agg, lookback_s, comparator, threshold)
        """
    )
