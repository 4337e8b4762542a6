"""Ordered work over groups that may be too large for one task.

``Window.partitionBy(key)`` puts all rows of a key in one task, and a deep ``offset`` puts all
rows before the page in one. The helpers here cut the sorted data into range blocks instead:
Spark samples the sort key, so a hot key is spread over as many blocks as its rows need, and
only one summary row per (key, block) has to be looked at across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import scratch_root

TOPK_ROWS = 10_000
#: rows of the sample that bounds a deep page
SAMPLE = 4096
BLOCK = "_block"


def range_blocks(df: DataFrame, order: Sequence[Column], blocks: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and number the partitions in ``_block``.

    Written to the checkpoint folder: block numbers depend on sampled bounds, so every later
    reader, also one replacing a lost executor, has to see the same ones.
    """
    scratch_root(df.sparkSession)
    ranged = (
        df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    )
    return ranged.withColumn(BLOCK, F.spark_partition_id()).checkpoint()


def next_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
    blocks: int | None = None,
) -> DataFrame:
    """For each row, the first non-null value of a column among the later rows of its key.

    ``values`` maps new column -> source column. Equal to a window over the key with frame
    ``1 following .. unbounded following``, without gathering the key in one task: a window
    within the block, then the answer of the nearest later block from the block summaries.
    """
    cut = range_blocks(df, [F.col(c) for c in (*keys, *order)], blocks)
    # looking back over the reversed order keeps the frame growing, which Spark evaluates in
    # one pass; a frame shrinking from the front would be re-read for every row
    backwards = [F.col(c).desc() for c in order]
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*backwards).rowsBetween(
        Window.unboundedPreceding, -1
    )
    position = F.struct(*order)
    heads = cut.groupBy(*keys, BLOCK).agg(
        *[
            F.min_by(src, F.when(F.col(src).isNotNull(), position)).alias(f"_head_{out}")
            for out, src in values.items()
        ]
    )
    later = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = heads.select(
        *keys,
        BLOCK,
        *[F.last(f"_head_{out}", True).over(later).alias(f"_carry_{out}") for out in values],
    )
    within = cut.withColumns(
        {out: F.last(src, True).over(inner) for out, src in values.items()}
    )
    return (
        within.join(carried, [*keys, BLOCK], "left")
        .withColumns({out: F.coalesce(out, f"_carry_{out}") for out in values})
        .drop(BLOCK, *[f"_carry_{out}" for out in values])
    )


def slice_sorted(
    df: DataFrame,
    order: Sequence[tuple[str, str]],
    offset: int,
    n: int,
    topk_rows: int = TOPK_ROWS,
) -> DataFrame:
    """Rows ``offset .. offset+n-1`` in sort order, given as ``(column, direction)`` pairs.

    Up to ``topk_rows`` the built-in top-k does it: each task keeps its best rows and one task
    merges them. Deeper pages would gather everything before their end in that task. There, a
    bottom-k sample of the leading column, of any type, gives values between which the page is
    all but sure to lie; rows before and between them are counted, which makes it sure. Within
    them the order columns alone are cut into range blocks to find the first and the last row of
    the page, and the table is read between those two. The driver sees the sample, two rows and
    a count for each block.
    """
    by = [getattr(F.col(name), way)() for name, way in order]
    if offset + n <= topk_rows:
        return _top(df, by, offset, n)
    near, offset = _near(df, order, offset, n)
    if offset + n <= topk_rows:
        return _top(near, by, offset, n)
    return _between(near, order, by, offset, n)


def _top(df: DataFrame, by: list[Column], offset: int, n: int) -> DataFrame:
    top = df.orderBy(*by)
    return (top.offset(offset) if offset else top).limit(n)


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def _nulls_first(way: str) -> bool:
    return way == "asc" or way.endswith("nulls_first")


def _precedes(col: str, way: str, value, kind: T.DataType) -> Column:
    """Whether the column sorts strictly before a value; never null."""
    first = _nulls_first(way)
    if value is None:
        return F.lit(False) if first else F.col(col).isNotNull()
    lit = _literal(value, kind)
    less = F.col(col) > lit if way.startswith("desc") else F.col(col) < lit
    return F.coalesce(less, F.lit(first))


def _same(col: str, value, kind: T.DataType) -> Column:
    return F.col(col).isNull() if value is None else F.col(col).eqNullSafe(_literal(value, kind))


def _reaches(col: str, low, high, way: str, kind: T.DataType) -> Column:
    """A plain condition on the leading column for the files' statistics, true for all in range."""
    if low is None or high is None:
        return F.lit(True)
    least, most = (high, low) if way.startswith("desc") else (low, high)
    return (F.col(col) >= _literal(least, kind)) & (F.col(col) <= _literal(most, kind))


def behind(df: DataFrame, order: Sequence[tuple[str, str]], row: Sequence) -> Column:
    """Rows that sort after a row given by its order columns."""
    kinds = [df.schema[c].dataType for c, _ in order]
    upto = F.lit(True)
    for (c, way), value, kind in reversed(list(zip(order, row, kinds))):
        upto = _precedes(c, way, value, kind) | (_same(c, value, kind) & upto)
    (lead, way), value, kind = order[0], row[0], kinds[0]
    if value is None:
        return ~upto
    lit = _literal(value, kind)
    reaches = F.col(lead) <= lit if way.startswith("desc") else F.col(lead) >= lit
    if not _nulls_first(way):
        reaches = reaches | F.col(lead).isNull()
    return reaches & ~upto


def _near(
    df: DataFrame, order: Sequence[tuple[str, str]], offset: int, n: int
) -> tuple[DataFrame, int]:
    """The rows whose leading value is near the page's, and the offset among them."""
    col, way = order[0]
    kind = df.schema[col].dataType
    # the rows of least hash are a sample of all, whatever the partitioning
    chance = F.xxhash64(*[F.col(c) for c, _ in order])
    sample = df.select(col, chance.alias("_h")).orderBy("_h").limit(SAMPLE)
    values = [r[0] for r in sample.orderBy(getattr(F.col(col), way)()).select(col).collect()]
    total = df.count()
    if len(values) < SAMPLE or total <= offset:
        return df, offset
    # five standard deviations of a sampled rank
    margin = 5 * 0.5 / len(values) ** 0.5
    low_at = int(((offset / total) - margin) * len(values))
    high_at = int((((offset + n) / total) + margin) * len(values)) + 1
    low = values[low_at] if low_at > 0 else _EDGE
    high = values[high_at] if high_at < len(values) else _EDGE
    before = F.lit(False) if low is _EDGE else _precedes(col, way, low, kind)
    upto = F.lit(True)
    if high is not _EDGE:
        upto = _precedes(col, way, high, kind) | _same(col, high, kind)
    counted = df.agg(F.count_if(before).alias("before"), F.count_if(~before & upto).alias("in")).first()
    if counted["before"] > offset or counted["before"] + counted["in"] < min(offset + n, total):
        return df, offset
    keep = ~before & upto
    if low is not _EDGE and high is not _EDGE:
        keep = _reaches(col, low, high, way, kind) & keep
    return df.filter(keep), offset - counted["before"]


_EDGE = object()


def _between(
    df: DataFrame, order: Sequence[tuple[str, str]], by: list[Column], offset: int, n: int
) -> DataFrame:
    """The page from its first and last row, which are found among the order columns alone."""
    names = [c for c, _ in order]
    cut = range_blocks(df.select(*names), by)
    counts = {r[BLOCK]: r["count"] for r in cut.groupBy(BLOCK).count().collect()}
    total = sum(counts.values())
    last = min(offset + n, total) - 1
    if last < offset:
        return df.limit(0)

    def row_at(place: int) -> dict:
        """The order columns of a row, and how many equal rows come before it."""
        before = 0
        for block in sorted(counts):
            if place < before + counts[block]:
                break
            before += counts[block]
        numbered = cut.filter(F.col(BLOCK) == block).withColumn(
            "_row", F.row_number().over(Window.partitionBy(BLOCK).orderBy(*by))
        )
        found = numbered.filter(F.col("_row") == place - before + 1)
        return found.select(*names).first().asDict()

    low, high = row_at(offset), row_at(last)
    kinds = {c: df.schema[c].dataType for c in names}

    def before_row(row: dict) -> Column:
        out = F.lit(False)
        for c, way in reversed(order):
            out = _precedes(c, way, row[c], kinds[c]) | (_same(c, row[c], kinds[c]) & out)
        return out

    def same_row(row: dict) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & _same(c, row[c], kinds[c])
        return out

    within = ~before_row(low) & (before_row(high) | same_row(high))
    lead, way = order[0]
    page = df.filter(_reaches(lead, low[lead], high[lead], way, kinds[lead]) & within)
    # rows that agree in all order columns stand in no order: of those at the edges as many are
    # taken as the page has room for
    ties = cut.agg(
        F.count_if(before_row(low)).alias("before"),
        F.count_if(same_row(low)).alias("low"),
        F.count_if(before_row(high)).alias("ahead"),
        F.count_if(same_row(high)).alias("high"),
    ).first()
    if low == high:
        return page.limit(last - offset + 1)
    skip, room = offset - ties["before"], last + 1 - ties["ahead"]
    if skip or ties["high"] > room:
        page = (
            page.filter(~same_row(low) & ~same_row(high))
            .unionByName(page.filter(same_row(low)).limit(ties["low"] - skip))
            .unionByName(page.filter(same_row(high)).limit(room))
        )
    return page.orderBy(*by)
