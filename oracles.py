"""The same questions in SQL, for a second engine reading the same tables."""

from __future__ import annotations

LINK = "https://telemetry.example"
JAN = "timestamp '2024-01-01'"
FROM, TO = "timestamp '2024-01-02'", "timestamp '2024-01-30'"
AS_OF = "timestamp '2024-01-16 12:00:00'"
MONTH_END, JULY_1 = "timestamp '2024-02-01'", "timestamp '2024-07-01'"

LOGS = """logs AS (
  SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS status,
         event_type || ' ' || props AS message,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ''
              ELSE 'svc-' || (event_id % 7) END AS service,
         'host-' || user_id AS host, event_type AS kind
  FROM events)"""

SPANS = """spans AS (
  SELECT CAST(l_linenumber AS BIGINT) AS span_id, l_orderkey AS trace_id,
         CASE WHEN l_linenumber > 1 THEN CAST(1 AS BIGINT) END AS parent_id,
         'svc-' || l_returnflag AS service, 'op-' || l_linestatus AS operation,
         '/parts/' || l_partkey AS resource, l_shipdate AS ts,
         CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 AS duration_ns,
         CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS error,
         CASE CAST(l_quantity AS INTEGER) % 10 WHEN 0 THEN '500' WHEN 1 THEN '404' ELSE '200' END AS http_status,
         CAST(l_suppkey AS VARCHAR) AS supplier
  FROM lineitem
  WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '2001-01-01')"""

_TIES = ("ts", "trace_id", "span_id", "resource", "supplier", "http_status", "duration_ns",
         "service", "operation", "error")
SPANS_DESC = ", ".join(f"{c} DESC" for c in _TIES)
SPANS_ASC = ", ".join(_TIES)

POINTS = """points AS (
  SELECT 'app.' || event_type AS metric, ts, CAST(value AS DECIMAL(18,2)) AS value,
         'host:host-' || user_id AS host, 'env:' || (user_id % 3) AS env
  FROM events)"""

INCIDENTS = """incidents AS (
  SELECT o_orderkey AS id, 'Incident ' || o_orderkey AS title,
         CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'active' ELSE 'stable' END AS status,
         'SEV-' || left(o_orderpriority, 1) AS severity, o_orderdate AS created,
         o_orderdate + to_hours(o_custkey % 72) AS modified,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice > 250000 END AS customer_impacted
  FROM orders)"""

MONITORS = """monitors AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 23 <> 0 THEN p_name END AS name,
         CASE WHEN p_size >= 5 THEN 'size ' || p_size END AS message,
         'brand:' || p_brand AS brand, 'type:' || p_type AS kind, p_partkey % 29 <> 0 AS tagged,
         CASE WHEN p_partkey % 2 = 0 THEN 'avg:part.price{id:' || p_partkey || '}' END AS query,
         CASE p_partkey % 10 WHEN 0 THEN 'Alert' WHEN 1 THEN 'Warn' WHEN 2 THEN 'No Data'
              WHEN 3 THEN 'OK' WHEN 4 THEN 'Ignored' WHEN 5 THEN 'Skipped' WHEN 6 THEN 'Unknown'
              WHEN 7 THEN 'Paused' WHEN 9 THEN '' END AS state,
         CASE WHEN p_partkey % 13 <> 0 THEN 1704067200 + p_partkey * 60 END AS modified_s
  FROM part)"""

MONITOR_COLUMNS = """coalesce(name, '') AS name, coalesce(id, 0) AS id,
         CASE WHEN state IS NULL OR state = '' THEN 'unknown' ELSE state END AS status, message,
         CASE WHEN tagged THEN brand || '|' || kind ELSE '' END AS tags,
         coalesce(query, '') AS query, modified_s AS "lastUpdatedTs" """

HOSTS = """seen AS (
  SELECT user_id, max(ts) AS last_reported,
         arg_max(event_type, {'a': ts, 'b': event_id}) AS last_type
  FROM events GROUP BY user_id),
hosts AS (
  SELECT c_custkey AS id, 'host-' || c_custkey AS name, lower(c_name) AS alias,
         lower(c_mktsegment) AS segment, last_reported, c_acctbal AS load,
         coalesce(last_type <> 'error', false) AS up, 'nation:' || c_nationkey AS tag
  FROM customer LEFT JOIN seen ON c_custkey = user_id)"""

DASHBOARDS = """dashboards AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN text END AS title,
         CASE WHEN doc_id % 19 <> 0 THEN lang || ',' || source END AS description,
         'custom_timeboard' AS type,
         CASE WHEN doc_id % 2 = 0 THEN 'ordered' ELSE 'free' END AS layout_type
  FROM documents)"""

REQUESTS = """requests AS (
  SELECT s_suppkey AS id,
         CASE WHEN s_suppkey % 13 = 12 THEN '' WHEN s_suppkey % 5 = 0 THEN 'env:' || (s_suppkey % 3)
              ELSE 'host:host-' || s_suppkey END AS scope,
         CASE WHEN s_suppkey % 31 <> 30 THEN 1704067200 + (s_suppkey * 37 % 600) * 3600 END AS start_s,
         CASE WHEN s_suppkey % 10 <> 3
              THEN 1704067200 + (s_suppkey * 37 % 600) * 3600 + (s_suppkey % 48) * 3600 END AS end_s,
         CASE WHEN s_suppkey % 2 = 0 THEN 'maintenance ' || s_suppkey END AS message,
         CASE s_suppkey % 6 WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/Paris'
              WHEN 3 THEN 'UTC' END AS timezone,
         CASE WHEN s_suppkey % 7 = 4 THEN s_suppkey % 8 END AS monitor_id,
         CASE WHEN s_suppkey % 9 = 5 THEN 'env:' || (s_suppkey % 3) END AS monitor_tag,
         CASE WHEN s_suppkey % 16 IN (1, 5, 9) THEN 'days' WHEN s_suppkey % 16 IN (2, 6, 10) THEN 'weeks'
              WHEN s_suppkey % 16 IN (3, 11) THEN 'months' WHEN s_suppkey % 16 = 7 THEN 'years'
              WHEN s_suppkey % 16 = 14 THEN 'hours' END AS unit,
         CASE WHEN s_suppkey % 27 = 26 THEN 0.5 ELSE 1 + s_suppkey % 3 END AS period,
         s_suppkey % 8 = 2 AS mon_thu,
         CASE WHEN s_suppkey % 5 = 2
              THEN 1704067200 + (s_suppkey * 37 % 600) * 3600 + 45 * 86400 END AS until_s,
         s_suppkey % 11 = 0 AS disabled
  FROM supplier),
judged AS (
  SELECT *, CASE WHEN scope = '' THEN 'empty scope'
                 WHEN end_s <= start_s THEN 'end not after start'
                 WHEN unit = 'hours' THEN 'unknown recurrence type'
                 WHEN unit IS NOT NULL AND period < 1 THEN 'recurrence period below 1' END AS reason
  FROM requests),
downtimes AS (
  SELECT id, scope, make_timestamp(start_s * 1000000) AS ts_start,
         make_timestamp(end_s * 1000000) AS ts_end, message, timezone, monitor_id, monitor_tag,
         unit, CASE WHEN unit IS NOT NULL THEN CAST(period AS INTEGER) END AS period,
         unit IS NOT NULL AND mon_thu AS mon_thu,
         CASE WHEN unit IS NOT NULL THEN until_s END AS until_s, disabled
  FROM judged WHERE reason IS NULL)"""


def occurrences(horizon: str) -> str:
    return f"""planned AS (
  SELECT *, coalesce(timezone, 'UTC') AS zone,
         least(coalesce(make_timestamp(until_s * 1000000), {horizon}), {horizon}) AS lim,
         unit IS NOT NULL AND ts_start IS NOT NULL AND ts_end IS NOT NULL AS repeats
  FROM downtimes),
localised AS (
  SELECT *, timezone(zone, timezone('UTC', ts_start)) AS local_start FROM planned),
tried AS (
  SELECT *, unnest(range(0, CASE WHEN repeats THEN 400 ELSE 1 END)) AS i FROM localised),
shifted AS (
  SELECT *, unnest(CASE WHEN repeats AND unit = 'weeks' AND mon_thu
                        THEN [0 - (isodow(local_start) - 1), 3 - (isodow(local_start) - 1)]
                        ELSE [0] END) AS shift FROM tried),
placed AS (
  SELECT *, CASE WHEN NOT repeats THEN ts_start ELSE timezone('UTC', timezone(zone,
      local_start
      + to_months(CAST(CASE unit WHEN 'months' THEN i * period WHEN 'years' THEN i * period * 12 ELSE 0 END AS INTEGER))
      + to_days(CAST(CASE unit WHEN 'days' THEN i * period WHEN 'weeks' THEN i * period * 7 + shift ELSE 0 END AS INTEGER))
    )) END AS moment
  FROM shifted),
occurrences AS (
  SELECT id, scope, monitor_id, monitor_tag, disabled, CAST(i AS INTEGER) AS occurrence, moment AS ts_start,
         CASE WHEN repeats THEN moment + (ts_end - ts_start) ELSE ts_end END AS ts_end
  FROM placed
  WHERE (moment IS NULL OR moment < lim) AND (NOT repeats OR moment >= ts_start))"""


MUTES = """commands AS (
  SELECT 'host-' || user_id AS host, ts, event_id AS seq, event_type = 'signup' AS mute,
         CASE WHEN event_type = 'signup' AND event_id % 48 <> 0
              THEN ts + to_hours(event_id % 48 * 4) END AS mute_end,
         event_type = 'signup' AND event_id % 3 = 0 AS override,
         CASE WHEN event_type = 'signup' THEN 'muted by ' || event_id END AS message
  FROM events WHERE event_type IN ('signup', 'click'))"""


def fold(as_of: str) -> str:
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS n
  FROM commands WHERE ts <= {as_of}),
fold AS (
  SELECT DISTINCT host, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS until,
         CAST(NULL AS VARCHAR) AS message, CAST(0 AS BIGINT) AS rejected FROM numbered
  UNION ALL
  SELECT c.host, c.n,
         CASE WHEN refused THEN f.until WHEN NOT c.mute THEN NULL
              ELSE coalesce(c.mute_end, timestamp '9999-01-01') END,
         CASE WHEN refused THEN f.message WHEN NOT c.mute THEN NULL ELSE c.message END,
         f.rejected + CASE WHEN refused THEN 1 ELSE 0 END
  FROM fold f JOIN numbered c ON c.host = f.host AND c.n = f.n + 1,
       LATERAL (SELECT coalesce(f.until > c.ts, false) AS live),
       LATERAL (SELECT CASE WHEN c.mute THEN live AND NOT c.override ELSE NOT live END AS refused)),
ended AS (
  SELECT host, arg_max(CASE WHEN until > {as_of} THEN until ELSE timestamp '1970-01-01' END, n) AS until,
         arg_max(coalesce(message, ''), n) AS message, max(n) AS commands,
         arg_max(rejected, n) AS rejected
  FROM fold GROUP BY host),
muted AS (
  SELECT host, until > {as_of} AS muted,
         CASE WHEN until > {as_of} AND until < timestamp '9999-01-01' THEN until END AS mute_end,
         CASE WHEN until > {as_of} THEN message END AS message, commands, rejected
  FROM ended)"""


ALERTS = """alerts AS (
  SELECT event_id AS alert_id, ts, 'host:host-' || user_id AS host, 'env:' || (user_id % 3) AS env,
         event_id % 8 AS monitor_id
  FROM events WHERE event_type = 'error')"""

HIT = """EXISTS (
    SELECT 1 FROM occurrences o
    WHERE (o.scope = a.host OR o.scope = a.env)
      AND (o.ts_start IS NULL OR a.ts >= o.ts_start) AND (o.ts_end IS NULL OR a.ts < o.ts_end)
      AND (o.monitor_id IS NULL OR o.monitor_id = a.monitor_id)
      AND (o.monitor_tag IS NULL OR o.monitor_tag = a.env OR o.monitor_tag = 'team:ops')
      AND NOT o.disabled)"""

RULES = """rules(rule_id, metric, env, by_key, space_agg, time_agg, lookback_s, how, threshold) AS (
  VALUES (1, 'app.error', NULL, 'env', 'avg', 'avg', 7200, '>', 52.13),
         (2, 'app.error', 'env:1', 'host', 'max', 'max', 14400, '>', 120.07),
         (3, 'app.purchase', NULL, NULL, 'sum', 'min', 10800, '<', 90.11),
         (4, 'app.view', NULL, 'env', 'count', 'sum', 7200, '>=', 5.0),
         (5, 'app.click', 'env:2', NULL, 'min', 'avg', 3600, '<=', 8.21),
         (6, 'app.absent', NULL, 'host', 'avg', 'avg', 3600, '>', 1.0))"""


def steps(step_expr: str, where: str) -> str:
    """Per rule, group and step: the space aggregate of the tag sets' averages."""
    return f"""sets AS (
  SELECT metric, host, env, {step_expr} AS step,
         CAST(sum(value) AS DOUBLE) / count(value) AS value
  FROM points WHERE {where} GROUP BY ALL),
cells AS (
  SELECT r.rule_id, CASE r.by_key WHEN 'env' THEN s.env WHEN 'host' THEN s.host ELSE '*' END AS grp,
         s.step, CASE r.space_agg WHEN 'avg' THEN avg(s.value) WHEN 'max' THEN max(s.value)
                      WHEN 'min' THEN min(s.value) WHEN 'sum' THEN sum(s.value)
                      ELSE CAST(count(s.value) AS DOUBLE) END AS value
  FROM sets s JOIN rules r ON r.metric = s.metric AND (r.env IS NULL OR r.env = s.env)
  GROUP BY r.rule_id, r.space_agg, grp, s.step),
expected AS (
  SELECT r.rule_id, coalesce(c.grp, '*') AS grp
  FROM rules r LEFT JOIN (SELECT DISTINCT rule_id, grp FROM cells) c USING (rule_id))"""


def time_agg(v: str, extra: str = "") -> str:
    return f"""CASE r.time_agg WHEN 'avg' THEN avg({v}){extra} WHEN 'max' THEN max({v}){extra}
              WHEN 'min' THEN min({v}){extra} ELSE sum({v}){extra} END"""


STATE = """CASE WHEN v IS NULL THEN 'No Data'
              WHEN (how = '>' AND v > threshold) OR (how = '>=' AND v >= threshold)
                OR (how = '<' AND v < threshold) OR (how = '<=' AND v <= threshold)
              THEN 'Alert' ELSE 'OK' END"""

GRID = steps(
    "CAST(epoch(time_bucket(INTERVAL 30 MINUTE, ts, timestamp '1970-01-01')) AS BIGINT)",
    f"ts >= {FROM} - INTERVAL 14400 SECOND + INTERVAL 1800 SECOND AND ts < {TO}",
) + f""",
axis AS (SELECT unnest(range(1704153600, 1706572800, 1800)) AS moment),
evaluated AS (
  SELECT r.rule_id, e.grp, x.moment, r.how, r.threshold, r.time_agg, {time_agg("c.value")} AS v
  FROM expected e JOIN rules r ON r.rule_id = e.rule_id CROSS JOIN axis x
  LEFT JOIN cells c ON c.rule_id = e.rule_id AND c.grp = e.grp
       AND c.step <= x.moment AND c.step > x.moment - r.lookback_s
  GROUP BY r.rule_id, e.grp, x.moment, r.how, r.threshold, r.time_agg),
states AS (
  SELECT rule_id, grp, make_timestamp(moment * 1000000) AS ts, v, {STATE} AS state FROM evaluated)"""


def series(
    metric: str, step: str, agg: str, scope: str, where: str = "true", value: str = "v",
    low: str = FROM, high: str = TO,
) -> str:
    return f"""sets AS (
  SELECT host, env, time_bucket(INTERVAL {step}, ts, timestamp '1970-01-01') AS ts,
         CAST(sum(value) AS DOUBLE) / count(value) AS v
  FROM points WHERE metric = '{metric}' AND ts >= {low} AND ts < {high} AND {where} GROUP BY ALL),
series AS (
  SELECT '{metric}' AS metric, {scope} AS scope, ts, {value.replace('v', f'CAST({agg}(v) AS DOUBLE)')} AS value
  FROM sets GROUP BY ALL)"""


def _q(parts: list[str], select: str, recursive: bool = False) -> str:
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {', '.join(parts)} {select}"


DOWNTIME_COLUMNS = """id, scope, ts_start, ts_end, message, timezone, monitor_id,
         monitor_tag AS monitor_tags, unit, period,
         CASE WHEN mon_thu AND unit = 'weeks' THEN 'Mon|Thu' END AS week_days, until_s AS until, disabled"""
LOG_COLUMNS = "id, ts, status, message, service, host"

ALL_SPANS = SPANS[: SPANS.index("  WHERE")] + ")"

ORACLES: dict[str, str] = {
    "list_hosts_deep_page": _q([HOSTS], """SELECT id, name, last_reported, up, segment AS platform
        FROM (SELECT *, row_number() OVER (ORDER BY name, id) AS n, count(*) OVER () AS total FROM hosts)
        WHERE n > total // 2 AND n <= total // 2 + 300"""),
    "export_incidents": _q([INCIDENTS], """SELECT * EXCLUDE (n), CAST((n - 1) // 400 AS INTEGER) AS page
        FROM (SELECT *, row_number() OVER (ORDER BY created DESC, id) AS n FROM incidents) WHERE n <= 1200"""),
    "laid_out_logs_hours": _q([LOGS], f"""SELECT CAST(id AS VARCHAR) AS id, ts, status, message, service, host
        FROM logs WHERE ts >= {AS_OF} AND ts < {AS_OF} + INTERVAL 12 HOUR"""),
    "laid_out_log": _q([LOGS], """SELECT CAST(id AS VARCHAR) AS id, ts, status, message, service, host
        FROM logs WHERE id = 77"""),
    "get_latest_services": _q([LOGS], f"""SELECT DISTINCT service FROM (
        SELECT service FROM logs WHERE ts >= {FROM} AND ts < {TO} ORDER BY ts DESC, id DESC LIMIT 5)
        WHERE service IS NOT NULL AND service <> ''"""),
    "trace_page_count_full": _q([SPANS], """SELECT count(*) AS count FROM (
        SELECT 1 FROM spans WHERE error <> 0 LIMIT 40)"""),
    "landed_rejects": """SELECT CAST(event_id AS VARCHAR) AS id,
        CASE WHEN event_id % 97 = 0 THEN 'attributes.timestamp' WHEN event_id % 89 = 0 THEN 'attributes.tags'
             ELSE '' END AS field,
        CASE WHEN event_id % 97 = 0 THEN 'not decimal(20,6)' WHEN event_id % 89 = 0 THEN 'not a list of texts'
             ELSE 'read' END AS reason FROM events""",
    "read_landed_spans": _q([ALL_SPANS], """SELECT CAST(span_id AS VARCHAR) AS span_id,
        CAST(trace_id AS VARCHAR) AS trace_id, CAST(parent_id AS VARCHAR) AS parent_id, service, operation,
        resource, ts, duration_ns, error, http_status, supplier FROM spans"""),
    "read_landed_points": _q([POINTS], """SELECT metric, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts,
        CAST(value AS DOUBLE) AS value, host || '|' || env AS tags, 'raw' AS expression FROM points"""),
    "read_landed_monitors": _q([MONITORS], """SELECT id, name, 'metric alert' AS type, message,
        CASE WHEN tagged THEN brand || '|' || kind END AS tags, query, state AS overall_state,
        timestamp '2024-01-01' AS created,
        make_timestamp(modified_s * 1000000 + 500000) AS modified FROM monitors"""),
    "read_landed_hosts": _q([HOSTS], """SELECT id, name, alias AS aliases, segment AS apps, false AS is_muted,
        last_reported, segment AS platform, load, up, tag AS tags FROM hosts"""),
    "read_landed_dashboards": _q([DASHBOARDS], """SELECT CAST(id AS VARCHAR) AS id, title, description, type,
        layout_type FROM dashboards"""),
    "read_landed_incidents": _q([INCIDENTS], """SELECT CAST(id AS VARCHAR) AS id, title, status, severity, created,
        modified, customer_impacted FROM incidents"""),
    "read_landed_downtimes": _q([REQUESTS], f"SELECT {DOWNTIME_COLUMNS} FROM downtimes"),
    "rejected_downtimes": _q([REQUESTS], """SELECT id, scope, timezone, reason FROM (
        SELECT id, scope, CASE WHEN id % 17 = 3 THEN 'Nowhere/Land' ELSE timezone END AS timezone,
               CASE WHEN scope = '' THEN 'empty scope' WHEN end_s <= start_s THEN 'end not after start'
                    WHEN id % 17 = 3 THEN 'unknown time zone' END AS reason FROM requests)
        WHERE reason IS NOT NULL"""),
    "get_logs": _q([LOGS], f"""SELECT {LOG_COLUMNS} FROM logs
        WHERE ts >= {FROM} AND ts < {TO} AND service = 'svc-3' ORDER BY ts DESC, id DESC LIMIT 100"""),
    "get_logs_text": _q([LOGS], f"""SELECT {LOG_COLUMNS} FROM logs
        WHERE ts >= {FROM} AND ts < {TO} AND status = 'error' AND kind = 'error'
          AND contains(lower(message), 'error') AND contains(lower(message), '"k": 9')
        ORDER BY ts DESC, id DESC LIMIT 200"""),
    "get_all_services": _q([LOGS], f"""SELECT DISTINCT service FROM (
        SELECT service FROM logs WHERE ts >= {FROM} AND ts < {TO} ORDER BY ts DESC, id DESC LIMIT 1000)
        WHERE service IS NOT NULL AND service <> ''"""),
    "read_landed_logs": _q([LOGS], """SELECT CAST(id AS VARCHAR) AS id,
        make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, status, message, service, host,
        'host:' || host || '|kind:' || kind AS tags FROM logs"""),
    "convert_time_units": _q([LOGS], """SELECT id, ts, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, epoch_us(ts) * 1000 + 999 AS ns,
        make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS from_s,
        make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_ms, ts AS from_ns,
        make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_iso FROM logs"""),
    "list_traces_desc": _q([SPANS], f"SELECT * FROM spans ORDER BY {SPANS_DESC} LIMIT 100"),
    "list_traces_asc": _q([SPANS], f"SELECT * FROM spans ORDER BY {SPANS_ASC} LIMIT 250"),
    "list_traces_facets": _q([SPANS], f"""SELECT * FROM spans
        WHERE service = 'svc-R' AND operation = 'op-F' AND http_status = '500' AND error <> 0
        ORDER BY {SPANS_DESC} LIMIT 100"""),
    "trace_page_count": _q([SPANS], """SELECT count(*) AS count FROM (
        SELECT 1 FROM spans WHERE http_status = '404' AND error <> 0 LIMIT 10000)"""),
    "query_metric_by_host": _q([POINTS, series("app.error", "1 HOUR", "avg", "host")],
        "SELECT * FROM series"),
    "query_metric_scope": _q([POINTS, series("app.purchase", "15 MINUTE", "avg", "env",
        "env = 'env:1'", "ROUND(v, 6)")], "SELECT * FROM series"),
    "query_metric_sum": _q([POINTS, series("app.view", "1 MINUTE", "sum", "'*'", value="ROUND(v, 6)")],
        "SELECT * FROM series"),
    "metric_pointlist": _q([POINTS, series("app.click", "1 HOUR", "max", "env", value="ROUND(v, 6)")],
        f"""SELECT metric, scope, CAST(floor(epoch(ts - {FROM}) / (3600 * 200)) AS BIGINT) AS part,
        CAST(count(*) AS INTEGER) AS points,
        string_agg(CAST(epoch(ts) AS BIGINT) || '=' || CAST(value AS DECIMAL(18,6)), ' ' ORDER BY ts) AS pointlist
        FROM series GROUP BY ALL"""),
    "list_incidents_page": _q([INCIDENTS], "SELECT * FROM incidents ORDER BY created DESC, id LIMIT 100 OFFSET 250"),
    "list_incidents_deep_page": _q([INCIDENTS], "SELECT * FROM incidents ORDER BY created DESC, id LIMIT 50 OFFSET 12000"),
    "get_incident": _q([INCIDENTS], "SELECT * FROM incidents WHERE id = 1234"),
    "incidents_ndjson": _q([INCIDENTS], """SELECT '{"id":' || id || ',"title":"' || title || '","status":"' || status
        || '","severity":"' || severity || '","created":"' || strftime(created, '%Y-%m-%dT%H:%M:%S.%gZ')
        || '","modified":"' || strftime(modified, '%Y-%m-%dT%H:%M:%S.%gZ') || '"'
        || coalesce(',"customer_impacted":' || customer_impacted, '') || '}' AS value FROM incidents"""),
    "list_monitors": _q([MONITORS], f"SELECT {MONITOR_COLUMNS} FROM monitors"),
    "filter_monitors": _q([MONITORS], f"""SELECT {MONITOR_COLUMNS} FROM monitors
        WHERE lower(state) IN ('alert', 'no data', 'ok') AND contains(lower(name), 'red')
          AND tagged AND kind = 'type:ECONOMY'"""),
    "monitor_summary": _q([MONITORS], """SELECT
        count(*) FILTER (state = 'Alert') AS alert, count(*) FILTER (state = 'Warn') AS warn,
        count(*) FILTER (state = 'No Data') AS "noData", count(*) FILTER (state = 'OK') AS ok,
        count(*) FILTER (state = 'Ignored') AS ignored, count(*) FILTER (state = 'Skipped') AS skipped,
        count(*) FILTER (state = 'Unknown') AS unknown FROM monitors"""),
    "evaluate_monitors": _q([RULES, POINTS, steps(
        f"CAST(epoch_us({AS_OF} - ts) AS BIGINT) // 60000000", f"ts <= {AS_OF}"), f"""evaluated AS (
          SELECT r.rule_id, e.grp, r.how, r.threshold, r.time_agg, {time_agg("c.value")} AS v
          FROM expected e JOIN rules r ON r.rule_id = e.rule_id
          LEFT JOIN cells c ON c.rule_id = e.rule_id AND c.grp = e.grp AND c.step * 60 < r.lookback_s
          GROUP BY r.rule_id, e.grp, r.how, r.threshold, r.time_agg)"""],
        f"""SELECT CAST(rule_id AS BIGINT) AS rule_id, grp AS "group", round(v, 6) AS value, {STATE} AS state FROM evaluated"""),
    "evaluate_monitors_grid": _q([RULES, POINTS, GRID],
        """SELECT CAST(rule_id AS BIGINT) AS rule_id, grp AS "group", ts, round(v, 6) AS value, state FROM states"""),
    "list_hosts_page": _q([HOSTS], f"""SELECT name, id, alias AS aliases, segment AS apps, false AS mute,
        CAST(floor(epoch(last_reported)) AS BIGINT) AS last_reported, segment AS platform, load,
        'agent' AS sources, up, '{LINK}/hosts?host=' || name AS url
        FROM hosts ORDER BY hosts.last_reported DESC NULLS LAST, id LIMIT 500 OFFSET 20"""),
    "filter_hosts": _q([HOSTS], f"""SELECT how, name, id, CAST(floor(epoch(last_reported)) AS BIGINT) AS last_reported,
        up, '{LINK}/hosts?host=' || name AS url
        FROM hosts, (VALUES ('tag'), ('alias')) h(how)
        WHERE hosts.last_reported >= {AS_OF}
          AND CASE how WHEN 'tag' THEN tag = 'nation:7' OR contains(name, 'nation:7')
                   ELSE contains(alias, 'r#00000001') OR contains(name, 'r#00000001') END"""),
    "active_hosts": _q([HOSTS], f"""SELECT count(*) AS total_active, count(*) FILTER (up) AS total_up
        FROM hosts WHERE last_reported >= {JAN} + INTERVAL 30 DAY - INTERVAL 12 HOUR"""),
    "host_mute_state": _q([MUTES, fold(AS_OF)], "SELECT * FROM muted", True),
    "host_mute_state_by_joins": _q([MUTES, fold(AS_OF)], "SELECT * FROM muted", True),
    "hosts_with_mute": _q([MUTES, fold(AS_OF), HOSTS], f"""SELECT name, id, coalesce(muted, false) AS mute,
        CAST(floor(epoch(mute_end)) AS BIGINT) AS mute_end, CAST(floor(epoch(last_reported)) AS BIGINT) AS last_reported,
        up, '{LINK}/hosts?host=' || name AS url
        FROM hosts LEFT JOIN muted ON name = host""", True),
    "mutes_of_unlisted_hosts": _q([MUTES, HOSTS], f"""SELECT DISTINCT host FROM commands
        WHERE ts <= {AS_OF} AND host NOT IN (SELECT name FROM hosts WHERE up)"""),
    "list_dashboards_name": _q([DASHBOARDS], f"""SELECT *, '{LINK}/dashboard/' || id AS url FROM dashboards
        WHERE contains(lower(title), 'heron')"""),
    "list_dashboards_tags": _q([DASHBOARDS], f"""SELECT *, '{LINK}/dashboard/' || id AS url FROM dashboards
        WHERE list_has_all(string_split(description, ','), ['en', 'src7'])"""),
    "get_dashboard": _q([DASHBOARDS], "SELECT * FROM dashboards WHERE id = 42"),
    "current_downtimes": _q([REQUESTS], f"""SELECT {DOWNTIME_COLUMNS} FROM downtimes
        WHERE NOT disabled AND (ts_start IS NULL OR ts_start <= {AS_OF}) AND (ts_end IS NULL OR ts_end > {AS_OF})"""),
    "schedule_downtimes": _q([REQUESTS], """SELECT id, scope, start_s AS "start", end_s AS "end", unit, reason FROM judged"""),
    "expand_downtimes": _q([REQUESTS, occurrences(JULY_1)],
        "SELECT id, scope, occurrence, ts_start, ts_end FROM occurrences"),
    "cancel_downtimes": _q([REQUESTS, """cancels AS (
        SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey WHEN s_suppkey % 50 = 1 THEN -s_suppkey END AS id
        FROM supplier)"""], """SELECT id, 'remaining' AS outcome FROM downtimes
        WHERE id NOT IN (SELECT id FROM cancels WHERE id IS NOT NULL)
        UNION ALL SELECT DISTINCT id, 'unknown' FROM cancels
        WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM downtimes)"""),
    "suppressed_alerts": _q([REQUESTS, occurrences(MONTH_END), ALERTS],
        f"SELECT alert_id, ts, host || '|' || env AS tags, monitor_id FROM alerts a WHERE {HIT}"),
    "unsuppressed_alerts": _q([REQUESTS, occurrences(MONTH_END), ALERTS],
        f"SELECT alert_id, ts, host || '|' || env AS tags, monitor_id FROM alerts a WHERE NOT {HIT}"),
    "alert_summary": _q([RULES, POINTS, GRID, REQUESTS, occurrences("timestamp '2024-01-30'"), """flagged AS (
        SELECT s.rule_id, EXISTS (
            SELECT 1 FROM occurrences o
            WHERE o.scope = s.grp AND NOT o.disabled
              AND (o.ts_start IS NULL OR s.ts >= o.ts_start) AND (o.ts_end IS NULL OR s.ts < o.ts_end)
              AND (o.monitor_id IS NULL OR o.monitor_id = s.rule_id)
              AND (o.monitor_tag IS NULL OR o.monitor_tag = r.env)) AS suppressed
        FROM states s JOIN rules r ON r.rule_id = s.rule_id WHERE s.state = 'Alert')"""],
        """SELECT CAST(rule_id AS BIGINT) AS rule_id, count(*) AS alerts,
        count(*) FILTER (suppressed) AS suppressed FROM flagged GROUP BY rule_id"""),
    # closed windows only: those the watermark has passed
    "stream_metric_rollup": _q([POINTS, series("app.error", "1 HOUR", "max", "env", value="ROUND(v, 6)",
        low=JAN, high=MONTH_END)], """SELECT * FROM series
        WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM points WHERE metric = 'app.error') - INTERVAL 10 MINUTE"""),
    "stream_monitor_eval": _q([RULES, POINTS, steps(
        "CAST(epoch(time_bucket(INTERVAL 30 MINUTE, ts, timestamp '1970-01-01')) AS BIGINT)", "true"), f"""bounds AS (
          SELECT CAST(epoch(time_bucket(INTERVAL 30 MINUTE, min(ts), timestamp '1970-01-01')) AS BIGINT) AS low,
                 max(ts) - INTERVAL 10 MINUTE AS mark FROM points),
        axis AS (
          SELECT moment FROM (SELECT unnest(range(low, CAST(epoch(mark) AS BIGINT), 1800)) AS moment, mark FROM bounds)
          WHERE make_timestamp((moment + 1800) * 1000000) <= mark),
        firsts AS (SELECT rule_id, grp, min(step) AS f FROM cells GROUP BY ALL),
        spans AS (
          SELECT rule_id, '*' AS grp, low AS f, CAST(NULL AS BIGINT) AS until FROM rules, bounds WHERE by_key IS NULL
          UNION ALL SELECT rule_id, grp, f, NULL FROM firsts JOIN rules USING (rule_id) WHERE by_key IS NOT NULL
          UNION ALL SELECT r.rule_id, '*', any_value(low), min(f) FROM rules r CROSS JOIN bounds
            LEFT JOIN firsts USING (rule_id) WHERE by_key IS NOT NULL GROUP BY r.rule_id),
        evaluated AS (
          SELECT r.rule_id, e.grp, x.moment, r.how, r.threshold, r.time_agg, {time_agg("c.value")} AS v
          FROM spans e JOIN rules r USING (rule_id)
          JOIN axis x ON x.moment >= e.f AND (e.until IS NULL OR x.moment < e.until)
          LEFT JOIN cells c ON c.rule_id = e.rule_id AND c.grp = e.grp
               AND c.step <= x.moment AND c.step > x.moment - r.lookback_s
          GROUP BY r.rule_id, e.grp, x.moment, r.how, r.threshold, r.time_agg)"""],
        f"""SELECT CAST(rule_id AS BIGINT) AS rule_id, grp AS "group", make_timestamp(moment * 1000000) AS ts,
        round(v, 6) AS value, {STATE} AS state FROM evaluated"""),
    "stream_mute_state": _q([MUTES, fold(MONTH_END)], "SELECT * FROM muted", True),
}
