"""Reading tables, scratch tables and numpy pieces shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path, scratch_root, setting

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: lower-cases A-Z in UTF-8 bytes and leaves every other byte alone
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared scratch folder and read back.

    A lost executor then costs a read, not a second run of what made the rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``stored`` and the path, for tables that ``removed`` takes away before the session ends."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


def small_batches(spark: SparkSession, size: int = 8 << 20):
    """Jobs run meanwhile send Python Arrow batches of about ``size`` bytes.

    The JVM holds a batch outside its heap, in buffers that double as they grow.
    """
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def cut_lineage(df: DataFrame) -> DataFrame:
    scratch_root(df.sparkSession)
    return df.checkpoint()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sum_before(df: DataFrame, order: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over the rows with a smaller integer ``order``.

    Sums within blocks of ``block`` rows, then over one row for each block, so that no task
    holds more than ``block`` rows or one thousandth of them.
    """
    cut = df.withColumn("_block", F.expr(f"{order} div {block}"))
    blocks = cut.groupBy("_block").agg(F.sum(value).alias("_sum")).select(
        "_block",
        F.coalesce(
            F.sum("_sum").over(
                Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_earlier"),
    )
    within = F.coalesce(
        F.sum(value).over(
            Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return (
        cut.withColumn(name, within)
        .join(blocks, "_block")
        .withColumn(name, F.col(name) + F.col("_earlier"))
        .drop("_block", "_earlier")
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts as 64-bit hashes, cut and hashed by array operations.

    ``hashes`` holds a hash for each word, text after text, and ``ends[i]`` the number of words
    up to the end of text ``i``. ``starts`` and ``stops`` are byte positions in ``data``, the
    lower-cased UTF-8 texts with a line end after each. The hash is the polynomial of the bytes
    to an odd base modulo 2**64, scrambled together with the length.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, texts: list[str | None], is_word: np.ndarray, between: bytes = b"\n"):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = between.join(parts) + between
        self.data = LOWER_BYTES[np.frombuffer(raw, np.uint8)]
        flags = is_word[self.data]
        edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
        self.starts, self.stops = edges[::2], edges[1::2]
        text_ends = np.cumsum([len(p) + len(between) for p in parts]) if parts else []
        self.ends = np.searchsorted(self.starts, np.asarray(text_ends, np.int64), "left")
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        """Horner's rule over all words at once, the longest words staying to the end."""
        length = self.stops - self.starts
        h = length.astype(np.uint64)
        if not len(length):
            return h
        base = np.uint64(self.BASE)
        most = int(min(length.max(), 24))
        for k in range(most):
            if k < 2:
                live = np.flatnonzero(length > k) if k else slice(None)
            else:
                live = live[length[live] > k]
            at = self.starts[live] + k
            h[live] = h[live] * base + self.data[at] + np.uint64(1)
        for i in np.flatnonzero(length > most).tolist():
            value = int(h[i])
            for b in self.data[self.starts[i] + most : self.stops[i]].tolist():
                value = (value * self.BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
            h[i] = value
        return mix(h)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.stops[i]].tobytes().decode("utf-8", "replace")


def byte_class(keep) -> np.ndarray:
    """A table of 256 flags: which bytes belong to words."""
    return np.array([bool(keep(b)) for b in range(256)])


#: words between spaces, tabs and line ends
SPACED = byte_class(lambda b: b not in (0x20, *range(0x09, 0x0E)))
#: words of digits, letters and whatever is not ASCII, in lower-cased text
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
