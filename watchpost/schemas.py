"""Column types (as DDL) of the canonical tables, and of the documents they are landed from."""

from __future__ import annotations

_RECURRENCE = "struct<type: string, period: int, week_days: array<string>, until: timestamp>"

CANONICAL: dict[str, str] = {
    "logs": (
        "id string, ts timestamp, status string, message string, service string, host string,"
        " tags array<string>"
    ),
    "spans": (
        "span_id string, trace_id string, parent_id string, service string, operation string,"
        " resource string, ts timestamp, duration_ns bigint, error int, meta map<string,string>"
    ),
    "metric_points": (
        "metric string, ts timestamp, value double, tags array<string>, display_name string,"
        " expression string, unit array<struct<family: string, scale_factor: double, name: string,"
        " short_name: string>>"
    ),
    "monitors": (
        "id bigint, name string, type string, message string, tags array<string>, query string,"
        " overall_state string, created timestamp, modified timestamp"
    ),
    "hosts": (
        "id bigint, name string, aliases array<string>, apps array<string>, is_muted boolean,"
        " last_reported timestamp, meta map<string,string>, metrics map<string,double>,"
        " sources array<string>, up boolean, tags array<string>"
    ),
    "dashboards": (
        "id string, title string, description string, type string, layout_type string"
    ),
    "incidents": (
        "id string, title string, status string, severity string, created timestamp,"
        " modified timestamp, customer_impacted boolean, customer_impact_scope string,"
        " customer_impact_start timestamp, customer_impact_end timestamp,"
        " fields struct<summary: string, root_cause: string, detection_method: string,"
        " services: array<string>, teams: array<string>>,"
        " timeline array<struct<ts: timestamp, content: string, type: string>>,"
        " created_by string, commander string"
    ),
    "downtimes": (
        "id bigint, scope array<string>, ts_start timestamp, ts_end timestamp, message string,"
        " timezone string, monitor_id bigint, monitor_tags array<string>,"
        f" recurrence {_RECURRENCE}, active boolean, disabled boolean, created timestamp,"
        " creator_id bigint, updated_at timestamp"
    ),
    "mute_commands": (
        "host string, ts timestamp, seq bigint, action string, mute_end timestamp,"
        " override boolean, message string"
    ),
    "downtime_cancels": ("downtime_id bigint"),
    "downtime_requests": (
        "id bigint, scope string, start bigint, end bigint, message string, timezone string,"
        " monitor_id bigint, monitor_tags array<string>,"
        " recurrence struct<type: string, period: double, week_days: array<string>, until: bigint>"
    ),
    "monitor_rules": (
        "rule_id bigint, metric string, scope array<string>, by array<string>, space_agg string,"
        " time_agg string, lookback_s bigint, comparator string, threshold double"
    ),
}

# One landed document per line (or file). ``envelope`` is the key the records sit under; None
# means the document is the array itself. ``required`` documents without records are an error.
# Texts under ``iso`` have to be times.
RAW: dict[str, dict] = {
    "logs": dict(
        envelope="data",
        required="the document has no logs",
        record="struct<id: string, type: string, attributes: struct<timestamp: decimal(20,6),"
        " status: string, message: string, service: string, host: string, tags: array<string>>>",
    ),
    "spans": dict(
        envelope="data",
        required="the document has no spans",
        record="struct<id: string, type: string, attributes: struct<service: string,"
        " name: string, resource: string, trace_id: string, span_id: string, parent_id: string,"
        " start: bigint, duration: bigint, error: int, meta: map<string,string>>>",
    ),
    "metric_points": dict(
        envelope="series",
        required=None,
        record="struct<metric: string, display_name: string,"
        " pointlist: array<array<double>>, scope: string, expression: string,"
        " unit: array<struct<family: string, scale_factor: double, name: string,"
        " short_name: string>>>",
    ),
    "monitors": dict(
        envelope=None,
        required="the document has no monitors",
        record="struct<id: bigint, name: string, type: string, message: string,"
        " tags: array<string>, query: string, overall_state: string, created: string,"
        " modified: string>",
        iso=("created", "modified"),
    ),
    "hosts": dict(
        envelope="host_list",
        required="the document has no hosts",
        record="struct<id: bigint, name: string, aliases: array<string>, apps: array<string>,"
        " is_muted: boolean, last_reported_time: decimal(20,6), meta: map<string,string>,"
        " metrics: map<string,double>, sources: array<string>, up: boolean,"
        " tags: array<string>>",
    ),
    "dashboards": dict(
        envelope="dashboards",
        required="the document has no dashboards",
        record="struct<id: string, title: string, description: string, type: string,"
        " layout_type: string>",
    ),
    "incidents": dict(
        envelope="data",
        required="the document has no incidents",
        record="struct<id: string, type: string, attributes: struct<title: string,"
        " created: string, modified: string, status: string, severity: string,"
        " customer_impact_scope: string, customer_impact_start: string,"
        " customer_impact_end: string, customer_impacted: boolean, fields: struct<"
        "summary: string, root_cause: string, detection_method: string,"
        " services: array<string>, teams: array<string>>, timeline: struct<entries: array<struct<"
        "timestamp: string, content: string, type: string>>>>,"
        " relationships: struct<created_by: struct<data: struct<id: string, type: string>>,"
        " commander: struct<data: struct<id: string, type: string>>>>",
        iso=(
            "attributes.created", "attributes.modified", "attributes.customer_impact_start",
            "attributes.customer_impact_end", "attributes.timeline.entries[].timestamp",
        ),
    ),
    "downtimes": dict(
        envelope=None,
        required=None,
        record="struct<id: bigint, active: boolean, disabled: boolean, start: decimal(20,6),"
        " end: decimal(20,6), scope: array<string>, message: string, monitor_id: bigint,"
        " monitor_tags: array<string>, timezone: string, recurrence: struct<type: string,"
        " period: int, week_days: array<string>, until: decimal(20,6)>, created: decimal(20,6),"
        " creator_id: bigint, updated_at: decimal(20,6)>",
    ),
}
# A single incident is the same record, not wrapped in an array.
RAW["incident"] = dict(
    RAW["incidents"], required="the document has no incident", single=True
)
