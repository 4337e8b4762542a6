"""Writing canonical tables so that reads by time and by id skip most of them.

A kind with a time is laid out in folders by UTC day, its files in order of time; one without is
in order of its id. Either way a file and a row group hold a narrow range, which their statistics
tell a reader. Ids that follow no order have Parquet Bloom filters: a row group without an id is
left out although the id lies between its least and its greatest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.checks import one_of
from ..functions.times import require_utc
from ..schemas import CANONICAL

#: kind -> (time column, columns looked up by value)
LAYOUT: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "logs": ("ts", ("id",)),
    "spans": ("ts", ("trace_id", "span_id")),
    "metric_points": ("ts", ("metric",)),
    "incidents": ("created", ("id",)),
    "mute_commands": ("ts", ("host",)),
    "monitors": (None, ("id",)),
    "hosts": (None, ("id", "name")),
    "dashboards": (None, ("id",)),
    "downtimes": (None, ("id",)),
}
DAY_COL = "dt"


def write_entity(
    df: DataFrame,
    kind: str,
    path: str,
    mode: str = "errorifexists",
    files: int | None = None,
    row_group_bytes: int | None = None,
    distinct_ids: int = 1_000_000,
) -> None:
    """Write a canonical table laid out for ``read_entity``, ``time_range`` and ``get_by_id``.

    Rows are dealt out by ranges of time (or id) into ``files`` (default: the session's shuffle
    partitions) and sorted there; a busy day is many files and a quiet one a part of one.
    ``distinct_ids`` sizes the Bloom filters, by row group. Rows without a time are in the folder
    of no day. Columns have to be the canonical ones.
    """
    one_of("kind", kind, LAYOUT)
    require_utc(df.sparkSession)
    time, ids = LAYOUT[kind]
    wanted = T.StructType.fromDDL(CANONICAL[kind])
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{kind} needs the columns {', '.join(missing)}")
    rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])
    order = [c for c in (time, *ids) if c]
    by_range = [F.col(c) for c in order]
    ranged = rows.repartitionByRange(files, *by_range) if files else rows.repartitionByRange(*by_range)
    if time:
        ranged = ranged.withColumn(DAY_COL, F.to_date(time))
        order = [DAY_COL, *order]
    writer = ranged.sortWithinPartitions(*order).write.mode(mode)
    if time:
        writer = writer.partitionBy(DAY_COL)
    for column in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(distinct_ids)
        )
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    # the default type of timestamps, INT96, has no statistics to skip by
    conf, key = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    before = conf.get(key)
    conf.set(key, "TIMESTAMP_MICROS")
    try:
        writer.parquet(path)
    finally:
        conf.set(key, before)
