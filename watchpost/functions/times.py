"""Time units: telemetry arrives in four of them, tables hold one timestamp type.

Canonical tables may store ``TIMESTAMP`` or ``TIMESTAMP_NTZ`` (UTC wall clock). Every helper
here accepts both, and range bounds are built as literals of the column's own type so the
comparison reaches the Parquet reader.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_EPOCH = datetime(1970, 1, 1)
_UTC_NAMES = {"UTC", "Etc/UTC", "Z", "GMT", "+00:00"}


def to_ts(c: Column | str, unit: str) -> Column:
    """A number or ISO text in ``unit`` (s, ms, ns, iso) as TIMESTAMP."""
    c = F.col(c) if isinstance(c, str) else c
    if unit == "s":
        return F.timestamp_seconds(c)
    if unit == "ms":
        # a part of a millisecond is kept down to the microsecond
        return F.timestamp_micros((c * 1000).cast("long"))
    if unit == "ns":
        # integer division: nanoseconds since 1970 do not fit a double
        whole = c - F.pmod(c, F.lit(1000))
        return F.timestamp_micros(F.call_function("div", whole, F.lit(1000)))
    if unit == "iso":
        return F.try_to_timestamp(c)
    raise ValueError(f"unknown time unit {unit!r}")


def _utc_micros(c: Column) -> Column:
    """Microseconds since 1970 of either timestamp type, whatever the session's time zone."""
    since = c.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    wall = (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.when(F.typeof(c) == "timestamp_ntz", wall).otherwise(
        F.unix_micros(c.cast("timestamp"))
    )


def from_ts(c: Column | str, unit: str) -> Column:
    """A timestamp as whole seconds (floor), milliseconds (floor), microseconds or ISO text.

    All are UTC, whatever the session's time zone; a TIMESTAMP_NTZ holds the UTC wall clock.
    """
    c = F.col(c) if isinstance(c, str) else c
    micros = _utc_micros(c)
    if unit == "us":
        return micros
    if unit in ("s", "ms"):
        part = F.lit(1_000_000 if unit == "s" else 1000)
        return F.call_function("div", micros - F.pmod(micros, part), part)
    if unit == "iso":
        seconds = micros.cast("decimal(20,0)") / 1_000_000
        none = F.lit(0)
        wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
            none, none, none, seconds.cast("decimal(18,6)")
        )
        return F.date_format(wall, ISO_MILLIS)
    raise ValueError(f"unknown time unit {unit!r}")


def utc_day(seconds: float) -> date:
    return (_EPOCH + timedelta(seconds=seconds)).date()


def ts_type(df: DataFrame, col: str) -> T.DataType:
    kind = df.schema[col].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{col} must be a timestamp, found {kind.simpleString()}")
    return kind


def ts_sql(seconds: float, kind: T.DataType) -> str:
    """Epoch seconds as a SQL literal of the column's own timestamp type."""
    micros = int((Decimal(str(seconds)) * 1_000_000).to_integral_value())
    text = (_EPOCH + timedelta(microseconds=micros)).isoformat(sep=" ")
    if isinstance(kind, T.TimestampNTZType):
        return f"timestamp_ntz'{text}'"
    return f"timestamp'{text}Z'"


def ts_lit(seconds: float, kind: T.DataType) -> Column:
    return F.expr(ts_sql(seconds, kind))


def seconds_to_ts(c: Column, kind: T.DataType) -> Column:
    """Whole epoch seconds held in a column, as a timestamp of type ``kind``."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)")
        )
    return F.timestamp_seconds(c)


def require_utc(spark: SparkSession) -> None:
    """Casts between the two timestamp types mean UTC only when the session says so."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in _UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone!r})")
