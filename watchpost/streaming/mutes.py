"""Continuous host mute state.

Every micro-batch reruns the batch fold on what it adds to the stored state. State lies in one
shared directory by hash of the host: a batch writes the buckets whose hosts have commands due and
takes over the others from its predecessor, so its work follows the commands and not the hosts.
A batch that is run again after a failure starts from the same predecessor and the same clock, and
writes the same rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.checks import whole
from ..operators.mutes import fold_mutes
from ..schemas import CANONICAL

COMMAND_COLUMNS = ("host", "ts", "seq", "action", "mute_end", "override", "message")
STATE_DDL = (
    "host string, muted boolean, mute_end timestamp, message string, commands bigint,"
    " rejected bigint"
)
#: rows of a finished batch: which batch wrote a bucket last; bucket -1 holds no state
DONE_DDL = "applied_to bigint, buckets int, bucket int, batch bigint"
BUCKETS = 64


def stream_mutes(
    commands: DataFrame,
    state_dir: str,
    checkpoint_dir: str,
    delay_s: int = 600,
    trigger: dict | None = None,
    not_after_s: float | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the mute state of every host in ``state_dir``.

    Commands are held back until the newest one seen is ``delay_s`` past them, so they are
    applied in order although they arrive out of it. A command arriving later than that is
    kept in ``late`` and not applied. Times past ``not_after_s`` (default: the wall clock when a
    batch first runs, kept with the batch) move nothing on. ``read_mute_state`` answers from the
    folder, for the last two batches; what only older ones used is removed. ``buckets`` holds for
    the life of the folder; choose it so that a bucket of hosts is a few files' worth.
    """
    whole("buckets", buckets, 1)
    query = commands.writeStream.foreachBatch(
        lambda df, n: _apply(df, n, state_dir, delay_s, not_after_s, buckets)
    ).option("checkpointLocation", checkpoint_dir)
    return query.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _apply(
    batch: DataFrame,
    batch_id: int,
    state_dir: str,
    delay_s: int,
    not_after_s: float | None,
    buckets: int = BUCKETS,
) -> None:
    # several answers are taken from the batch; it is read from its source once
    fresh = batch.select(*COMMAND_COLUMNS).persist()
    try:
        now = _clock(batch.sparkSession, f"{state_dir}/{batch_id}/clock", not_after_s)
        _advance(fresh, batch_id, state_dir, delay_s, now, buckets)
    finally:
        fresh.unpersist()


def _clock(spark: SparkSession, path: str, not_after_s: float | None) -> int:
    """The batch's own now in microseconds: set when it first runs, read when it runs again."""
    kept = spark.read.schema("now bigint").parquet(path).first() if _exists(spark, f"{path}/_SUCCESS") else None
    if kept is not None:
        return kept["now"]
    now = int((time.time() if not_after_s is None else not_after_s) * 1_000_000)
    spark.range(1).select(F.lit(now).alias("now")).coalesce(1).write.mode("overwrite").parquet(path)
    return now


def _advance(
    fresh: DataFrame, batch_id: int, state_dir: str, delay_s: int, now: int, buckets: int
) -> None:
    spark = fresh.sparkSession
    applied_to, written, buckets = _done(spark, state_dir, batch_id - 1, buckets)
    pending = _pending(spark, state_dir, batch_id - 1)
    at = F.unix_micros("ts")
    late = fresh.filter(at <= applied_to)
    waiting = pending.unionByName(fresh.filter(at > applied_to))
    newest = waiting.filter(at <= now).agg(F.max(at)).first()[0]
    up_to = max(applied_to, newest - delay_s * 1_000_000) if newest is not None else applied_to
    folder = f"{state_dir}/{batch_id}"
    waiting.filter(at > up_to).write.mode("overwrite").parquet(f"{folder}/pending")
    late.write.mode("overwrite").parquet(f"{folder}/late")
    due = waiting.filter(at <= up_to).withColumn("bucket", _bucket(buckets))
    touched = sorted(r["bucket"] for r in due.select("bucket").distinct().collect())
    if touched:
        known = _known(spark, state_dir, {b: n for b, n in written.items() if b in set(touched)})
        state = _merge(known, due.drop("bucket"), up_to / 1e6)
        state.withColumn("bucket", _bucket(buckets)).repartition(
            min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket"
        ).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state")
    written = written | {b: batch_id for b in touched}
    # written last: its presence says the folder is complete
    rows = [(up_to, buckets, b, n) for b, n in sorted(written.items())] or [(up_to, buckets, -1, -1)]
    spark.createDataFrame(rows, DONE_DDL).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done")
    _forget(spark, state_dir, batch_id, written)


def _forget(spark: SparkSession, state_dir: str, batch_id: int, written: dict[int, int]) -> None:
    """Remove what only batches before the last one used; their late commands stay."""
    before = f"{state_dir}/{batch_id - 2}"
    if batch_id < 2 or not _exists(spark, f"{before}/done/_SUCCESS"):
        return
    kept = set(written.items()) | set(_done(spark, state_dir, batch_id - 1, 0)[1].items())
    for bucket, n in set(_done(spark, state_dir, batch_id - 2, 0)[1].items()) - kept:
        _delete(spark, f"{state_dir}/{n}/state/bucket={bucket}")
    # done goes last, so that a run that ends halfway is taken up by the next batch's rerun
    for name in ("pending", "clock", "done"):
        _delete(spark, f"{before}/{name}")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def _exists(spark: SparkSession, path: str) -> bool:
    system, found = _path(spark, path)
    return system.exists(found)


def _delete(spark: SparkSession, path: str) -> None:
    system, found = _path(spark, path)
    system.delete(found, True)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int")


def _merge(known: DataFrame, due: DataFrame, as_of_s: float) -> DataFrame:
    """Known states moved on by the due commands; counters add up."""
    # before the first command there is no instant to speak of
    folded = fold_mutes(due, max(as_of_s, 0), initial=known).select(
        "host", "muted", "mute_end", "message", "commands", "rejected"
    )
    before = known.select(
        "host", F.col("commands").alias("_commands"), F.col("rejected").alias("_rejected")
    )
    return folded.join(before, "host", "full").select(
        "host",
        F.coalesce("muted", F.lit(False)).alias("muted"),
        "mute_end",
        "message",
        (F.coalesce("commands", F.lit(0)) + F.coalesce("_commands", F.lit(0))).alias("commands"),
        (F.coalesce("rejected", F.lit(0)) + F.coalesce("_rejected", F.lit(0))).alias("rejected"),
    )


def _done(
    spark: SparkSession, state_dir: str, batch_id: int, buckets: int
) -> tuple[int, dict[int, int], int]:
    """How far a batch has applied commands, which batch wrote each bucket, how many there are."""
    if batch_id < 0:
        return -(2**62), {}, buckets
    rows = spark.read.schema(DONE_DDL).parquet(f"{state_dir}/{batch_id}/done").collect()
    written = {r["bucket"]: r["batch"] for r in rows if r["bucket"] >= 0}
    return rows[0]["applied_to"], written, rows[0]["buckets"]


def _known(spark: SparkSession, state_dir: str, written: dict[int, int]) -> DataFrame:
    if not written:
        return spark.createDataFrame([], STATE_DDL)
    folders = [f"{state_dir}/{n}/state/bucket={b}" for b, n in sorted(written.items())]
    return spark.read.schema(STATE_DDL).parquet(*folders)


def _pending(spark: SparkSession, state_dir: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], CANONICAL["mute_commands"])
    return spark.read.schema(CANONICAL["mute_commands"]).parquet(f"{state_dir}/{batch_id}/pending")


def read_mute_state(
    spark: SparkSession, state_dir: str, batch_id: int, as_of_s: float
) -> DataFrame:
    """The state after a batch: what was applied, moved on by the commands still held back."""
    known = _known(spark, state_dir, _done(spark, state_dir, batch_id, 0)[1])
    pending = _pending(spark, state_dir, batch_id)
    return _merge(known, pending.filter(F.col("ts") <= F.timestamp_seconds(F.lit(as_of_s))), as_of_s)
