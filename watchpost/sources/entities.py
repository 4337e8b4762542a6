"""Reading telemetry kinds and writing record listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import one_of
from ..functions.times import to_ts
from ..schemas import CANONICAL, RAW
from . import landing


def read_entity(
    spark: SparkSession,
    kind: str,
    path: str,
    fmt: str = "parquet",
    whole_files: bool = False,
) -> DataFrame:
    """One telemetry kind as its canonical table.

    ``parquet`` paths hold canonical tables, read with their declared schema (date-partitioned
    folders keep their ``dt`` column for pruning). ``json`` paths hold landed response
    documents, one per line, or one per file with ``whole_files``; the envelope is opened and time
    units are normalised. A document without its envelope fails the read, as does a value that is
    there and cannot be read, while an empty list is simply no rows; ``land_entity`` keeps what
    cannot be read apart instead.
    """
    one_of("fmt", fmt, ("parquet", "json"))
    if fmt == "parquet":
        one_of("kind", kind, CANONICAL)
        return spark.read.schema(CANONICAL[kind]).parquet(path)
    one_of("kind", kind, RAW)
    docs = landing.documents(spark, path, whole_files)
    return _NORMALISE[kind](landing.all_readable(landing.parsed(docs, kind)))


def land_entity(
    spark: SparkSession, kind: str, path: str, whole_files: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The canonical rows of landed documents, and what could not be read.

    Rejects are (file, text, field, reason). A record with a reject has no row; of a metric
    series only the points that cannot be read are left out, unless more is wrong with it.
    """
    one_of("kind", kind, RAW)
    records = landing.parsed(landing.documents(spark, path, whole_files), kind)
    return _NORMALISE[kind](landing.readable(records)), landing.rejects(records)


def _logs(df: DataFrame) -> DataFrame:
    a = "r.attributes."
    return df.select(
        F.col("r.id").alias("id"),
        to_ts(a + "timestamp", "ms").alias("ts"),
        a + "status",
        a + "message",
        a + "service",
        a + "host",
        a + "tags",
    )


def _spans(df: DataFrame) -> DataFrame:
    a = "r.attributes."
    return df.select(
        # sparse records carry only the outer id
        F.coalesce(a + "span_id", "r.id").alias("span_id"),
        a + "trace_id",
        a + "parent_id",
        a + "service",
        F.col(a + "name").alias("operation"),
        a + "resource",
        to_ts(a + "start", "ns").alias("ts"),
        F.col(a + "duration").alias("duration_ns"),
        a + "error",
        a + "meta",
    )


def _points(df: DataFrame) -> DataFrame:
    tags = F.when(F.col("r.scope").isin("", "*"), F.array().cast("array<string>")).otherwise(
        F.split("r.scope", ",")
    )
    about = ("display_name", "expression", "unit")
    return (
        df.select(
            F.col("r.metric").alias("metric"),
            tags.alias("tags"),
            F.explode("r.pointlist").alias("p"),
            *[f"r.{c}" for c in about],
        )
        .filter(F.col("p").isNotNull())
        .select(
            "metric", to_ts(F.col("p")[0], "ms").alias("ts"), F.col("p")[1].alias("value"), "tags", *about
        )
    )


def _monitors(df: DataFrame) -> DataFrame:
    return df.select("r.*").withColumns(
        {"created": to_ts("created", "iso"), "modified": to_ts("modified", "iso")}
    )


def _hosts(df: DataFrame) -> DataFrame:
    return df.select("r.*").select(
        "id",
        "name",
        "aliases",
        "apps",
        "is_muted",
        to_ts("last_reported_time", "s").alias("last_reported"),
        "meta",
        "metrics",
        "sources",
        "up",
        "tags",
    )


def _dashboards(df: DataFrame) -> DataFrame:
    return df.select("r.*")


def _incidents(df: DataFrame) -> DataFrame:
    a = "r.attributes."

    def iso(name: str) -> Column:
        return to_ts(a + name, "iso").alias(name)

    timeline = F.transform(
        F.col(a + "timeline.entries"),
        lambda e: F.struct(
            to_ts(e["timestamp"], "iso").alias("ts"), e["content"].alias("content"),
            e["type"].alias("type"),
        ),
    )
    return df.select(
        F.col("r.id").alias("id"),
        a + "title",
        a + "status",
        a + "severity",
        iso("created"),
        iso("modified"),
        a + "customer_impacted",
        a + "customer_impact_scope",
        iso("customer_impact_start"),
        iso("customer_impact_end"),
        a + "fields",
        timeline.alias("timeline"),
        F.col("r.relationships.created_by.data.id").alias("created_by"),
        F.col("r.relationships.commander.data.id").alias("commander"),
    )


def _downtimes(df: DataFrame) -> DataFrame:
    rec = F.col("r.recurrence")
    recurrence = F.when(
        rec.isNotNull(),
        F.struct(
            rec["type"].alias("type"),
            rec["period"].alias("period"),
            rec["week_days"].alias("week_days"),
            to_ts(rec["until"], "s").alias("until"),
        ),
    )
    return df.select(
        F.col("r.id").alias("id"),
        "r.scope",
        to_ts("r.start", "s").alias("ts_start"),
        to_ts("r.end", "s").alias("ts_end"),
        "r.message",
        "r.timezone",
        "r.monitor_id",
        "r.monitor_tags",
        recurrence.alias("recurrence"),
        "r.active",
        "r.disabled",
        to_ts("r.created", "s").alias("created"),
        "r.creator_id",
        to_ts("r.updated_at", "s").alias("updated_at"),
    )


_NORMALISE = {
    "logs": _logs,
    "spans": _spans,
    "metric_points": _points,
    "monitors": _monitors,
    "hosts": _hosts,
    "dashboards": _dashboards,
    "incidents": _incidents,
    "incident": _incidents,
    "downtimes": _downtimes,
}


def ndjson_lines(df: DataFrame) -> DataFrame:
    """Each record as one JSON text in column ``value``; null fields are left out."""
    return df.select(
        F.to_json(
            F.struct("*"),
            {
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
                "timeZone": "UTC",
            },
        ).alias("value")
    )


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records as newline-delimited JSON, one file per partition."""
    ndjson_lines(df).write.mode(mode).text(path)
