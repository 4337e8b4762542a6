"""The named questions, each over whole sample tables.

Arrays and maps are shown as text here so that results compare as plain values; the operators
themselves keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.times import from_ts, to_ts
from .operators import aggregates, downtimes, filters, metrics, monitors, mutes, paging, projections
from .plans.alerting import alert_report
from .session import scratch_path, shuffles_removed
from .sources import samples
from .sources.entities import land_entity, ndjson_lines, read_entity
from .sources.tables import write_entity
from .streaming.metrics import stream_metric
from .streaming.monitors import stream_monitors
from .streaming.mutes import read_mute_state, stream_mutes

DAY = 86_400
JAN_1 = 1_704_067_200  # 2024-01-01T00:00:00Z
FROM, TO = JAN_1 + DAY, JAN_1 + 29 * DAY
AS_OF = JAN_1 + 15 * DAY + 12 * 3600
MONTH_END = JAN_1 + 31 * DAY
JULY_1 = JAN_1 + 182 * DAY
SPANS_FROM, SPANS_TO = 820_454_400, 978_307_200  # 1996-01-01, 2001-01-01
LINK = "https://telemetry.example"
SPAN_TIES = (
    "trace_id", "span_id", "resource", "supplier", "http_status", "duration_ns", "service",
    "operation", "error",
)
STREAM_WAIT_S = 900
FILE_DOCUMENTS = 2000
PASS_BYTES = 1 << 30


# logs


def get_logs(spark: SparkSession, d: str) -> DataFrame:
    found = filters.time_range(samples.logs(spark, d), FROM, TO)
    return paging.latest(filters.search_rows(found, {"service": "svc-3"})).drop("tags")


def get_logs_text(spark: SparkSession, d: str) -> DataFrame:
    found = filters.time_range(samples.logs(spark, d), FROM, TO)
    found = filters.search_rows(
        found, {"status": "error", "kind": "error"}, ("*", "ERROR", '"k": 9')
    )
    return paging.latest(found, 200).drop("tags")


def get_all_services(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.all_services(filters.time_range(samples.logs(spark, d), FROM, TO))


def _land(records: DataFrame, group: str, label: str, envelope: str | None) -> str:
    """Write JSON texts (column ``record``) as documents of one ``group`` each; returns the path."""
    path = scratch_path(records.sparkSession, label)
    held = F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]"))
    text = "held" if envelope is None else f"concat('{{\"{envelope}\":', held, '}}')"
    # compressed files cannot be read in parts, so none gets too many documents
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_DOCUMENTS}
    # large tables in several passes over their groups, so that only a part is in shuffle files at once
    passes = 1 + _bytes_read(records) // PASS_BYTES
    for k in range(passes):
        part = records if passes == 1 else records.filter(f"pmod(xxhash64({group}), {passes}) = {k}")
        docs = part.groupBy(F.expr(group)).agg(held.alias("held"))
        with shuffles_removed(records.sparkSession):
            docs.select(F.expr(text).alias("value")).write.mode("append").options(**packed).text(path)
    return path


def _bytes_read(df: DataFrame) -> int:
    """The size of the files that are read for the rows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size())]
    return sum(int(str(n)) for n in sizes)


def _log_records(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct(
            from_ts("ts", "ms").alias("timestamp"), "status", "message", "service", "host", "tags"
        ).alias("attributes"),
    )
    return samples.logs(spark, d).select("id", F.to_json(record).alias("record"))


def read_landed_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs landed as response documents of up to 100 records each, read back."""
    path = _land(_log_records(spark, d), "id div 100", "landed-logs", "data")
    read = read_entity(spark, "logs", path, "json")
    return read.select(
        "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "message", "service",
        "host", F.array_join("tags", "|").alias("tags"),
    )


def landed_rejects(spark: SparkSession, d: str) -> DataFrame:
    """What cannot be read of logs some of which have a word for a time, or a text for tags."""
    broken = _log_records(spark, d).withColumn(
        "record",
        F.expr(
            """CASE WHEN id % 97 = 0 THEN regexp_replace(record, '"timestamp":[0-9]+', '"timestamp":"soon"')
            WHEN id % 89 = 0 THEN regexp_replace(record, '"tags":.[^]]*.', '"tags":"none"')
            ELSE record END"""
        ),
    )
    rows, rejects = land_entity(spark, "logs", _land(broken, "id div 100", "landed-broken", "data"))
    return rejects.select(
        F.get_json_object("text", "$.id").alias("id"), "field", "reason"
    ).unionByName(rows.select("id", F.lit("").alias("field"), F.lit("read").alias("reason")))


def read_landed_spans(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    record = F.struct(
        F.concat_ws("-", "trace_id", "span_id").alias("id"),
        F.struct(
            "service", F.col("operation").alias("name"), "resource", text("trace_id"),
            text("span_id"), text("parent_id"), (from_ts("ts", "us") * 1000).alias("start"),
            F.col("duration_ns").alias("duration"), "error", "meta",
        ).alias("attributes"),
    )
    records = samples.spans(spark, d).select("trace_id", F.to_json(record).alias("record"))
    read = read_entity(spark, "spans", _land(records, "trace_id div 25", "landed-spans", "data"), "json")
    return _span_rows(read).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def read_landed_points(spark: SparkSession, d: str) -> DataFrame:
    """Points as series of a metric, scope and day, in documents of up to 20 hosts and a day each."""
    points = samples.metric_points(spark, d)
    series = points.groupBy(
        "metric", F.array_join("tags", ",").alias("scope"), F.expr("unix_timestamp(ts) div 86400").alias("day")
    ).agg(
        F.collect_list(
            F.array(from_ts("ts", "ms").cast("double"), F.col("value").cast("double"))
        ).alias("pointlist")
    )
    record = F.to_json(F.struct("metric", "scope", "pointlist", F.lit("raw").alias("expression")))
    # a day of all hosts in one document would grow with the hosts
    hosts = F.expr("CAST(regexp_extract(scope, 'host:host-([0-9]+)', 1) AS BIGINT) div 20").alias("hosts")
    records = series.select("day", hosts, record.alias("record"))
    path = _land(records, "struct(day, hosts)", "landed-points", "series")
    return read_entity(spark, "metric_points", path, "json").select(
        "metric", F.col("ts").cast("timestamp_ntz").alias("ts"), "value",
        F.array_join("tags", "|").alias("tags"), "expression",
    )


def read_landed_monitors(spark: SparkSession, d: str) -> DataFrame:
    iso = {c: from_ts(c, "iso") for c in ("created", "modified")}
    made = samples.monitors(spark, d).withColumns(iso)
    records = made.select("id", F.to_json(F.struct("*")).alias("record"))
    read = read_entity(spark, "monitors", _land(records, "id div 100", "landed-monitors", None), "json")
    return read.select(
        "id", "name", "type", "message", F.array_join("tags", "|").alias("tags"), "query",
        "overall_state", *[F.col(c).cast("timestamp_ntz").alias(c) for c in iso],
    )


def read_landed_hosts(spark: SparkSession, d: str) -> DataFrame:
    seconds = (from_ts("last_reported", "us").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)")
    made = samples.hosts(spark, d).withColumn("last_reported_time", seconds).drop("last_reported")
    records = made.select("id", F.to_json(F.struct("*")).alias("record"))
    read = read_entity(spark, "hosts", _land(records, "id div 100", "landed-hosts", "host_list"), "json")
    return read.select(
        "id", "name", F.array_join("aliases", "|").alias("aliases"),
        F.array_join("apps", "|").alias("apps"), "is_muted",
        F.col("last_reported").cast("timestamp_ntz").alias("last_reported"),
        F.col("meta").getItem("platform").alias("platform"),
        F.col("metrics").getItem("load").alias("load"), "up",
        F.array_join("tags", "|").alias("tags"),
    )


def read_landed_dashboards(spark: SparkSession, d: str) -> DataFrame:
    made = samples.dashboards(spark, d).withColumn("key", F.col("id")).withColumn("id", F.col("id").cast("string"))
    records = made.select("key", F.to_json(F.struct(*made.drop("key").columns)).alias("record"))
    path = _land(records, "key div 20", "landed-dashboards", "dashboards")
    return read_entity(spark, "dashboards", path, "json")


def read_landed_incidents(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct(
            "title", "status", "severity", "customer_impacted",
            *[from_ts(c, "iso").alias(c) for c in ("created", "modified")],
        ).alias("attributes"),
    )
    records = samples.incidents(spark, d).select("id", F.to_json(record).alias("record"))
    read = read_entity(spark, "incidents", _land(records, "id div 100", "landed-incidents", "data"), "json")
    return read.select(
        "id", "title", "status", "severity",
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created", "modified")], "customer_impacted",
    )


def read_landed_downtimes(spark: SparkSession, d: str) -> DataFrame:
    until = F.col("recurrence").withField("until", F.unix_timestamp("recurrence.until"))
    record = F.struct(
        "id", "scope", from_ts("ts_start", "s").alias("start"), from_ts("ts_end", "s").alias("end"),
        "message", "timezone", "monitor_id", "monitor_tags", until.alias("recurrence"), "disabled",
    )
    records = samples.downtimes(spark, d).select("id", F.to_json(record).alias("record"))
    read = read_entity(spark, "downtimes", _land(records, "id div 100", "landed-downtimes", None), "json")
    return _downtime_rows(
        read.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts_start", "ts_end")})
    )


def _canonical_logs(spark: SparkSession, d: str) -> DataFrame:
    return samples.logs(spark, d).withColumns(
        {"id": F.col("id").cast("string"), "ts": F.col("ts").cast("timestamp")}
    )


def laid_out_logs_hours(spark: SparkSession, d: str) -> DataFrame:
    """All logs written by day and in order of time, and twelve hours of one day read back."""
    path = scratch_path(spark, "laid-out-logs")
    write_entity(_canonical_logs(spark, d), "logs", path)
    read = read_entity(spark, "logs", path)
    found = filters.time_range(read, AS_OF, AS_OF + 12 * 3600, day_col="dt")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("tags", "dt")


def laid_out_log(spark: SparkSession, d: str) -> DataFrame:
    """One log by its id from the table laid out with Bloom filters."""
    path = scratch_path(spark, "laid-out-log")
    write_entity(_canonical_logs(spark, d), "logs", path)
    found = filters.get_by_id(read_entity(spark, "logs", path), "77")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("tags", "dt")


def get_latest_services(spark: SparkSession, d: str) -> DataFrame:
    """Services of the latest five logs; most services have older logs only."""
    return aggregates.all_services(filters.time_range(samples.logs(spark, d), FROM, TO), 5)


def convert_time_units(spark: SparkSession, d: str) -> DataFrame:
    """Event times as seconds, milliseconds and ISO text, and back from three units."""
    e = samples.logs(spark, d).select(
        "id", "ts", from_ts("ts", "s").alias("s"), from_ts("ts", "ms").alias("ms"),
        from_ts("ts", "iso").alias("iso"), (from_ts("ts", "us") * 1000 + 999).alias("ns"),
    )
    back = {f"from_{u}": to_ts(u, u).cast("timestamp_ntz") for u in ("s", "ms", "ns", "iso")}
    return e.withColumns(back)


# spans


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_range(samples.spans(spark, d), SPANS_FROM, SPANS_TO)


def _span_rows(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "http_status": F.col("meta").getItem("http.status_code"),
            "supplier": F.col("meta").getItem("supplier.id"),
        }
    ).drop("meta")


def list_traces_desc(spark: SparkSession, d: str) -> DataFrame:
    return paging.spans_page(_span_rows(_spans(spark, d)), ties=SPAN_TIES)


def list_traces_asc(spark: SparkSession, d: str) -> DataFrame:
    return paging.spans_page(_span_rows(_spans(spark, d)), 250, "timestamp", SPAN_TIES)


def list_traces_facets(spark: SparkSession, d: str) -> DataFrame:
    found = filters.span_facets(_spans(spark, d), "svc-R", "op-F")
    found = filters.search_rows(found, {"http.status_code": "500", "error": "true"})
    return paging.spans_page(_span_rows(found), ties=SPAN_TIES)


def trace_page_count(spark: SparkSession, d: str) -> DataFrame:
    found = filters.search_rows(_spans(spark, d), {"http.status_code": "404", "error": "true"})
    return paging.page_count(paging.spans_page(_span_rows(found), 10_000, ties=SPAN_TIES))


def trace_page_count_full(spark: SparkSession, d: str) -> DataFrame:
    """A full page of fewer rows than match: the page is counted, not the matches."""
    found = filters.search_rows(_spans(spark, d), {"error": "true"})
    return paging.page_count(paging.spans_page(_span_rows(found), 40, ties=SPAN_TIES))


# metrics


def _series(spark: SparkSession, d: str, metric: str, **kw) -> DataFrame:
    return metrics.query_metric(samples.metric_points(spark, d), metric, FROM, TO, **kw)


def query_metric_by_host(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, "app.error", by=["host"], step_s=3600)


def query_metric_scope(spark: SparkSession, d: str) -> DataFrame:
    found = _series(spark, d, "app.purchase", scope={"env": "1"}, by=["env"], step_s=900)
    return found.withColumn("value", F.round("value", 6))


def query_metric_sum(spark: SparkSession, d: str) -> DataFrame:
    found = _series(spark, d, "app.view", agg="sum", step_s=60)
    return found.withColumn("value", F.round("value", 6))


def metric_pointlist(spark: SparkSession, d: str) -> DataFrame:
    series = _series(spark, d, "app.click", agg="max", by=["env"], step_s=3600)
    series = series.withColumn("value", F.round("value", 6).cast("decimal(18,6)"))
    lists = metrics.to_pointlist(series, FROM, 3600, max_points=200)
    points = F.transform(
        "pointlist",
        lambda p: F.concat(F.unix_timestamp(p["ts"]).cast("string"), F.lit("="), p["value"].cast("string")),
    )
    return lists.select(
        "metric", "scope", "part", F.size("pointlist").alias("points"),
        F.array_join(points, " ").alias("pointlist"),
    )


# incidents


def list_incidents_deep_page(spark: SparkSession, d: str) -> DataFrame:
    return paging.incidents_page(samples.incidents(spark, d), 50, 12_000)


def list_incidents_page(spark: SparkSession, d: str) -> DataFrame:
    return paging.incidents_page(samples.incidents(spark, d), 100, 250)


def get_incident(spark: SparkSession, d: str) -> DataFrame:
    return filters.get_by_id(samples.incidents(spark, d), "1234")


def incidents_ndjson(spark: SparkSession, d: str) -> DataFrame:
    return ndjson_lines(samples.incidents(spark, d))


# monitors


def _monitor_rows(df: DataFrame) -> DataFrame:
    return projections.monitor_listing(df).withColumn("tags", F.array_join("tags", "|"))


def list_monitors(spark: SparkSession, d: str) -> DataFrame:
    return _monitor_rows(samples.monitors(spark, d))


def filter_monitors(spark: SparkSession, d: str) -> DataFrame:
    found = filters.filter_monitors(
        samples.monitors(spark, d), ["alert", "no data", "ok"], "RED", ["type:ECONOMY"]
    )
    return _monitor_rows(found)


def monitor_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.monitor_summary(samples.monitors(spark, d))


def evaluate_monitors(spark: SparkSession, d: str) -> DataFrame:
    states = monitors.evaluate_monitors(
        samples.metric_points(spark, d), samples.monitor_rules(spark, d), AS_OF
    )
    return states.withColumn("value", F.round("value", 6))


def evaluate_monitors_grid(spark: SparkSession, d: str) -> DataFrame:
    states = monitors.evaluate_monitors_over(
        samples.metric_points(spark, d), samples.monitor_rules(spark, d), FROM, TO, 1800
    )
    return states.withColumn("value", F.round("value", 6))


# hosts


def list_hosts_page(spark: SparkSession, d: str) -> DataFrame:
    page = paging.hosts_page(samples.hosts(spark, d), "last_reported", "desc", 20, 500)
    page = projections.host_details(page, metadata=True)
    shown = projections.host_listing(page, f"{LINK}/hosts?host=")
    return shown.select(
        "name", "id", F.array_join("aliases", "|").alias("aliases"),
        F.array_join("apps", "|").alias("apps"), "mute", "last_reported",
        F.col("meta").getItem("platform").alias("platform"),
        F.col("metrics").getItem("load").alias("load"),
        F.array_join("sources", "|").alias("sources"), "up", "url",
    )


def list_hosts_deep_page(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by name from half-way on, the page found among names and ids alone."""
    hosts = samples.hosts(spark, d).select("id", "name", "last_reported", "up", "meta")
    half = hosts.count() // 2
    page = paging.hosts_page(hosts, "name", "asc", half, 300, topk_rows=50)
    return page.select("id", "name", "last_reported", "up", F.col("meta").getItem("platform").alias("platform"))


def export_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Three pages read one behind the other, each from the cursor its predecessor left."""
    incidents = samples.incidents(spark, d)
    order, last, pages = [("created", "desc"), ("id", "asc")], None, None
    for n in range(3):
        page = paging.after_cursor(incidents, order, last, 400).withColumn("page", F.lit(n))
        end = page.orderBy(F.col("created").asc(), F.col("id").desc()).select("created", "id").first()
        pages = page if pages is None else pages.unionByName(page)
        if end is None:
            break
        last = (end["created"], end["id"])
    return pages


def filter_hosts(spark: SparkSession, d: str) -> DataFrame:
    """By a tag, and by a piece of an alias, each with a lower bound on the last report."""
    hosts = projections.host_details(samples.hosts(spark, d))
    tag = filters.filter_hosts(hosts, "nation:7", AS_OF)
    alias = filters.filter_hosts(hosts, "R#00000001", AS_OF)
    shown = [
        projections.host_listing(found, f"{LINK}/hosts?host=").select(
            F.lit(how).alias("how"), "name", "id", "last_reported", "up", "url"
        )
        for how, found in (("tag", tag), ("alias", alias))
    ]
    return shown[0].unionByName(shown[1])


def active_hosts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.active_hosts(samples.hosts(spark, d), JAN_1 + 30 * DAY, 12 * 3600)


def host_mute_state(spark: SparkSession, d: str) -> DataFrame:
    return mutes.fold_mutes(samples.mute_commands(spark, d), AS_OF)


def host_mute_state_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """The same log, every host resolved the way hosts of any size are."""
    return mutes.fold_mutes(samples.mute_commands(spark, d), AS_OF, fold_rows=0)


def hosts_with_mute(spark: SparkSession, d: str) -> DataFrame:
    state = mutes.fold_mutes(samples.mute_commands(spark, d), AS_OF)
    joined = mutes.with_mute(samples.hosts(spark, d), state)
    shown = projections.host_listing(
        projections.host_details(joined, mutes=True), f"{LINK}/hosts?host="
    )
    return shown.select("name", "id", "mute", "mute_end", "last_reported", "up", "url")


def mutes_of_unlisted_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with mute commands that are not among the hosts listed as up."""
    state = mutes.fold_mutes(samples.mute_commands(spark, d), AS_OF)
    return mutes.unknown_hosts(samples.hosts(spark, d).filter("up"), state)


# dashboards


def _dashboard_rows(df: DataFrame) -> DataFrame:
    return projections.dashboard_listing(df, f"{LINK}/dashboard/")


def list_dashboards_name(spark: SparkSession, d: str) -> DataFrame:
    return _dashboard_rows(filters.title_contains(samples.dashboards(spark, d), "HERON"))


def list_dashboards_tags(spark: SparkSession, d: str) -> DataFrame:
    return _dashboard_rows(filters.csv_tags_all(samples.dashboards(spark, d), ["en", "src7"]))


def get_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return filters.get_by_id(samples.dashboards(spark, d), "42")


# downtimes


def _downtime_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "id", F.array_join("scope", "|").alias("scope"), "ts_start", "ts_end", "message",
        "timezone", "monitor_id", F.array_join("monitor_tags", "|").alias("monitor_tags"),
        F.col("recurrence.type").alias("unit"), F.col("recurrence.period").alias("period"),
        F.array_join("recurrence.week_days", "|").alias("week_days"),
        F.unix_timestamp("recurrence.until").alias("until"), "disabled", *more,
    )


def current_downtimes(spark: SparkSession, d: str) -> DataFrame:
    return _downtime_rows(filters.current_downtimes(samples.downtimes(spark, d), AS_OF, True))


def schedule_downtimes(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and rejected requests, the latter with their reason."""
    valid, rejected = projections.normalise_downtimes(samples.downtime_requests(spark, d))
    return valid.select(
        "id", F.array_join("scope", "|").alias("scope"),
        F.unix_timestamp("ts_start").alias("start"), F.unix_timestamp("ts_end").alias("end"),
        F.col("recurrence.type").alias("unit"), F.lit(None).cast("string").alias("reason"),
    ).unionByName(
        rejected.select("id", "scope", "start", "end", F.col("recurrence.type").alias("unit"), "reason")
    )


def expand_downtimes(spark: SparkSession, d: str) -> DataFrame:
    found = downtimes.expand_downtimes(samples.downtimes(spark, d), JULY_1)
    return found.select(
        "id", F.array_join("scope", "|").alias("scope"), "occurrence", "ts_start", "ts_end"
    )


def rejected_downtimes(spark: SparkSession, d: str) -> DataFrame:
    """Stored downtimes that cover nothing: of requests that were stored as they came."""
    stored = samples.downtime_requests(spark, d).select(
        "id", F.expr("filter(array(scope), s -> s <> '')").alias("scope"),
        to_ts("start", "s").alias("ts_start"), to_ts("end", "s").alias("ts_end"),
        F.expr("IF(id % 17 = 3, 'Nowhere/Land', timezone)").alias("timezone"),
    )
    found = downtimes.rejected_downtimes(stored)
    return found.select("id", F.array_join("scope", "|").alias("scope"), "timezone", "reason")


def cancel_downtimes(spark: SparkSession, d: str) -> DataFrame:
    remaining, unknown = downtimes.cancel(
        samples.downtimes(spark, d), samples.downtime_cancels(spark, d)
    )
    return remaining.select("id", F.lit("remaining").alias("outcome")).unionByName(
        unknown.select(F.col("downtime_id").alias("id"), F.lit("unknown").alias("outcome"))
    )


def _alert_rows(df: DataFrame) -> DataFrame:
    return df.select("alert_id", "ts", F.array_join("tags", "|").alias("tags"), "monitor_id")


def _suppression(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    occurrences = downtimes.expand_downtimes(samples.downtimes(spark, d), MONTH_END)
    return downtimes.suppress(samples.error_alerts(spark, d), occurrences)


def suppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _alert_rows(_suppression(spark, d)[1])


def unsuppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _alert_rows(_suppression(spark, d)[0])


def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    """Points to states to alerts to suppression to counts."""
    return alert_report(
        samples.metric_points(spark, d), samples.monitor_rules(spark, d),
        samples.downtimes(spark, d), FROM, TO, 1800,
    )


# streams


def _drain(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now, into a table, and read the table."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    if not query.awaitTermination(STREAM_WAIT_S):
        query.stop()
        raise TimeoutError(f"stream {label} did not finish in {STREAM_WAIT_S} s")
    rows = spark.read.schema(df.schema).parquet(f"{out}/rows")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    points = samples.points_of(samples.event_stream(spark, d))
    rows = _drain(stream_metric(points, "app.error", 3600, ["env"], "max"), "metric-rollup")
    return rows.withColumn("value", F.round("value", 6))


def stream_monitor_eval(spark: SparkSession, d: str) -> DataFrame:
    points = samples.points_of(samples.event_stream(spark, d))
    rules = samples.monitor_rules(spark, d)
    rows = _drain(stream_monitors(points, rules, 1800), "monitor-eval")
    return rows.withColumn("value", F.round("value", 6))


def stream_mute_state(spark: SparkSession, d: str) -> DataFrame:
    """The mute log in four micro-batches, a command at most ten minutes late."""
    out = scratch_path(spark, "mute-state")
    commands = samples.mute_commands_of(samples.event_batches(spark, d, f"{out}/events"))
    query = stream_mutes(
        commands, f"{out}/state", f"{out}/checkpoint", trigger={"availableNow": True}
    )
    if not query.awaitTermination(STREAM_WAIT_S):
        query.stop()
        raise TimeoutError("stream mute-state did not finish")
    done = query.lastProgress.batchId if query.lastProgress else 0
    state = read_mute_state(spark, f"{out}/state", done, MONTH_END)
    return state.withColumn("mute_end", F.col("mute_end").cast("timestamp_ntz"))


_ALL = (
    get_logs, get_logs_text, laid_out_logs_hours, laid_out_log, get_all_services,
    get_latest_services, read_landed_logs,
    read_landed_spans, read_landed_points, read_landed_monitors, read_landed_hosts,
    read_landed_dashboards, read_landed_incidents, read_landed_downtimes, landed_rejects,
    convert_time_units, list_traces_desc, list_traces_asc,
    list_traces_facets, trace_page_count, trace_page_count_full, rejected_downtimes, query_metric_by_host, query_metric_scope,
    query_metric_sum, metric_pointlist, list_incidents_page, list_incidents_deep_page, get_incident,
    incidents_ndjson,
    list_monitors, filter_monitors, monitor_summary, evaluate_monitors, evaluate_monitors_grid,
    list_hosts_page, list_hosts_deep_page, export_incidents, filter_hosts, active_hosts, host_mute_state,
    host_mute_state_by_joins, hosts_with_mute, mutes_of_unlisted_hosts,
    list_dashboards_name, list_dashboards_tags, get_dashboard, current_downtimes,
    schedule_downtimes, expand_downtimes, cancel_downtimes, suppressed_alerts,
    unsuppressed_alerts, alert_summary, stream_metric_rollup, stream_monitor_eval,
    stream_mute_state,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _ALL}
