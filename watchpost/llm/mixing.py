"""Mixing sources to target weights: a shuffled corpus of fixed-length blocks of words.

The words of a source, document after document in an order that depends on rows alone, are packed
into blocks of ``BLOCK`` words. The mix is a row of shards of ``SLOTS`` slots; every shard draws
how many slots each source gets, multinomially given the sources' totals, and a slot's place in
its source goes through a pseudorandom permutation of that source's blocks, a new one for each
pass over them. Blocks meet their slots in an equi-join by index.

A shard's draw needs no other shard: shards are the leaves of a binary tree, every node splits
its counts over its two halves by a hypergeometric draw seeded with the node, and a task walks
from the root to its leaves. What a source had before a shard comes out of the same walk.

A source's target is reached to the word: its last draw takes the first words of its block only.
No target is above ``MOST`` times the source's size, so no block is drawn more often.

Contract for odd input. A null text has no words; a document without words takes none. A null
source is a source of its own, after all others. Null and repeated ids are kept, a row each; equal
rows (same id, text and source) are told apart by nothing, so which of them gets what is arbitrary.
No documents, or none with words, give an empty mix. Texts of any length are cut into pieces as
they are read. Other columns are not read. The names and sizes of sources are held by the driver
and by every task that draws: ``MAX_SOURCES`` is a stated limit of the mix, and more are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SPACED, mix as scramble, stored

BLOCK, SLOTS = 512, 512
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
MAX_SOURCES = 65_536
#: bytes of text of a group of documents, within which places are counted in one task, about
GROUP_BYTES = 4 << 20
#: numpy draws from urns of fewer balls; above, the normal law of the same mean and variance
URN = 500_000_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words due from each source: ``share`` of all words dealt by weight, none above its cap.

    What a cap cuts off is dealt again by weight among the sources below theirs.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if unit * weight[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


class Permutation:
    """A one-to-one map of 0..n-1 onto itself: a Feistel network, walked until it lands inside."""

    ROUNDS = 4

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        seeds = np.arange(1, self.ROUNDS + 1, dtype=np.uint64) + np.uint64(key % (1 << 48) << 8)
        self.keys = scramble(seeds)
        self.mask = np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for k in keys:
            left, right = right, left ^ (scramble(right + k) & self.mask)
        # halves swapped, so that the keys backwards undo it
        return right << shift | left

    def _walk(self, x, keys) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def undo(self, x) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


class Plan:
    """What the driver knows: for each source its words, blocks, draws and last cut."""

    def __init__(self, sizes: list[int], due: list[float], seed: int, block: int, slots: int):
        self.seed, self.block, self.slots = seed, block, slots
        self.sizes = sizes
        self.blocks = [-(-s // block) for s in sizes]
        self.draws, self.cuts = [], []
        for i, words in enumerate(due):
            draws, cut = self._draws(i, min(round(words), int(MOST * sizes[i])))
            self.draws.append(draws)
            self.cuts.append(cut)
        self.shards = -(-sum(self.draws) // slots)

    def permutation(self, source: int, turn: int) -> Permutation:
        return Permutation(self.blocks[source], (self.seed * 1_000_003 + source) * 64 + turn)

    def length(self, source: int, block: int) -> int:
        """Words of a block: the last one of a source may be short."""
        return min(self.block, self.sizes[source] - block * self.block)

    def _draws(self, i: int, words: int) -> tuple[int, tuple[int, int] | None]:
        """How many blocks make ``words``, and the (block, words of it) of a cut last draw."""
        if not words:
            return 0, None
        turns, rest = divmod(words, self.sizes[i])
        if not rest:
            return turns * self.blocks[i], None
        last = self.blocks[i] - 1
        missing = self.block - self.length(i, last)
        order = self.permutation(i, turns)
        # the draws before the short block are full, those from it on have that much less
        count = -(-rest // self.block)
        if int(order.undo([last])[0]) < count:
            count = -(-(rest + missing) // self.block)
            before = count * self.block - missing
        else:
            before = count * self.block
        block = int(order([count - 1])[0])
        cut = self.length(i, block) - (before - rest)
        return turns * self.blocks[i] + count, (block, cut) if before > rest else None


def split_counts(counts: np.ndarray, take: int, seed: tuple) -> np.ndarray:
    """How many of ``take`` slots drawn from ``counts`` slots each source has.

    The multinomial law given the totals: one hypergeometric draw a source.
    """
    rng = np.random.default_rng(seed)
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, have in enumerate(counts.tolist()):
        rest -= have
        if rest + have < URN:
            got = int(rng.hypergeometric(have, rest, take)) if have and take else 0
        else:
            total = have + rest
            mean = take * (have / total)
            spread = math.sqrt(mean * (rest / total) * ((total - take) / max(total - 1, 1)))
            got = round(rng.normal(mean, spread))
        out[i] = got = min(max(got, take - rest, 0), have, take)
        take -= int(got)
    return out


class Drawing:
    """The counts of shards, and what each source had before them, by walks down the tree."""

    def __init__(self, plan: Plan):
        self.plan = plan
        draws = np.array(plan.draws, np.int64)
        self.path = [(0, plan.shards, draws, np.zeros_like(draws))]

    def shard(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts by source, and the counts of all earlier shards together."""
        while not self.path[-1][0] <= number < self.path[-1][1]:
            self.path.pop()
        low, high, counts, before = self.path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            left = split_counts(
                counts, (middle - low) * self.plan.slots, (self.plan.seed, low, high)
            )
            if number < middle:
                high, counts = middle, left
            else:
                low, counts, before = middle, counts - left, before + left
            self.path.append((low, high, counts, before))
        return counts, before


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """Every slot of the mix: (shard, slot, number, block, take); ``take`` is null for whole blocks."""
    schema = "shard long, slot int, number int, block long, take int"
    if not plan.shards:
        return spark.createDataFrame([], schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawing, orders = Drawing(plan), {}
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = drawing.shard(shard)
                numbers = np.repeat(np.arange(len(counts)), counts)
                blocks = np.empty(len(numbers), np.int64)
                takes = np.full(len(numbers), -1, np.int32)
                at = 0
                for i in np.flatnonzero(counts).tolist():
                    draw = before[i] + np.arange(counts[i])
                    turn, place = np.divmod(draw, plan.blocks[i])
                    found = blocks[at : at + counts[i]]
                    for t in np.unique(turn).tolist():
                        if (i, t) not in orders:
                            orders[i, t] = plan.permutation(i, t)
                        found[turn == t] = orders[i, t](place[turn == t])
                    if plan.cuts[i] and draw[-1] == plan.draws[i] - 1:
                        takes[at + counts[i] - 1] = plan.cuts[i][1]
                    at += counts[i]
                order = np.random.default_rng((plan.seed, shard)).permutation(len(numbers))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": np.full(len(numbers), shard),
                        "slot": np.arange(len(numbers), dtype=np.int32),
                        "number": numbers[order].astype(np.int32),
                        "block": blocks[order],
                        "take": pa.array(takes[order], mask=takes[order] < 0),
                    }
                )

    tasks = max(1, min(plan.shards, -(-sum(plan.draws) // 500_000)))
    return spark.range(0, plan.shards, 1, tasks).mapInArrow(fill, schema)


def word_starts(text: bytes) -> np.ndarray:
    flags = SPACED[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(np.diff(flags.view(np.int8), prepend=0) == 1)


def cut_pieces(placed: DataFrame, plan: Plan) -> DataFrame:
    """Documents at their place in their source's words, cut into pieces at the ends of blocks.

    The pieces of a document put together are its text: white space goes with the word before it,
    or with the first word. Where a source's last draw is cut, its block is cut into two pieces.
    """
    cuts = {i: block * plan.block + words for i, c in enumerate(plan.cuts) if c for block, words in [c]}
    kind, size = placed.schema["id"].dataType.simpleString(), plan.block
    schema = (
        f"id {kind}, size long, number int, start long, block long, first int, words int, piece string"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], {"block": [], "first": [], "words": [], "piece": []}
            for row, (number, start, words, text) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("number", "start", "size", "text")))
            ):
                ends = np.arange(start // size * size + size, start + words, size).tolist()
                if number in cuts and start < cuts[number] < start + words:
                    ends = sorted({*ends, cuts[number]})
                edges = [start, *ends, start + words]
                if ends:
                    raw = text.encode()
                    at = word_starts(raw)
                    breaks = [0, *(int(at[e - start]) for e in ends), len(raw)]
                    pieces = [raw[a:b].decode() for a, b in zip(breaks, breaks[1:])]
                else:
                    pieces = [text]
                for low, high, piece in zip(edges, edges[1:], pieces):
                    rows.append(row)
                    columns["block"].append(low // size)
                    columns["first"].append(low % size)
                    columns["words"].append(high - low)
                    columns["piece"].append(piece)
            taken = pa.array(rows, pa.int64())
            whole = [batch.column(c).take(taken) for c in ("id", "size", "number", "start")]
            yield pa.RecordBatch.from_arrays(
                [
                    *whole,
                    pa.array(columns["block"], pa.int64()),
                    pa.array(columns["first"], pa.int32()),
                    pa.array(columns["words"], pa.int32()),
                    pa.array(columns["piece"], pa.string()),
                ],
                names=["id", "size", "number", "start", "block", "first", "words", "piece"],
            )

    return placed.select("id", "size", "number", "start", "text").mapInArrow(cut, schema)


class Mix:
    """A mix of documents; see the module's text for its rules and ``WEIGHTS`` for their default.

    ``sources``: a row each, (source, number, source_size, target). ``pieces``: every piece of
    every document that has words, once for each slot it has in the mix, and once with a null
    shard where the mix leaves it out.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights=WEIGHTS,
        share: float = SHARE,
        seed: int = 0,
        block: int = BLOCK,
        slots_per_shard: int = SLOTS,
        id_col: str = "doc_id",
    ):
        if share > MOST:
            raise ValueError(f"share must not exceed {MOST}, the most that a source gives")
        spark = docs.sparkSession
        rows = docs.select(
            F.col(id_col).alias("id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )
        counted = rows.withColumns(
            {
                "size": F.regexp_count("text", F.lit(WORD)).cast("long"),
                "key": F.xxhash64("source"),
                "hash": F.xxhash64("id", "text", "source"),
            }
        )
        narrow = stored(
            counted.select("source", "key", "size", "hash", F.octet_length("text").alias("bytes")),
            "mix-sizes",
        )
        listed = (
            narrow.groupBy("source", "key")
            .agg(F.sum("size").alias("words"), F.sum("bytes").alias("bytes"))
            .limit(MAX_SOURCES + 1)
            .collect()
        )
        if len(listed) > MAX_SOURCES:
            raise ValueError(f"documents have more than {MAX_SOURCES} sources")
        if len({r["key"] for r in listed}) < len(listed):
            raise ValueError("two sources have one hash; rename one of them")
        listed.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
        sizes = [r["words"] for r in listed]
        due = targets(sizes, weights, share)
        self.plan = Plan(sizes, due, seed, block, slots_per_shard)
        self.sources = spark.createDataFrame(
            [(r["source"], i, r["words"], float(due[i])) for i, r in enumerate(listed)],
            "source string, number int, source_size long, target double",
        )
        # groups of a source: a power of two of ranges of the hash
        groups = [(max(1, -(-r["bytes"] // GROUP_BYTES)) - 1).bit_length() for r in listed]
        numbers = spark.createDataFrame(
            [(r["key"], i, groups[i]) for i, r in enumerate(listed)], "key long, number int, bits int"
        )
        group = F.expr("IF(bits = 0, 0L, shiftrightunsigned(hash, 64 - bits))")

        def grouped(df: DataFrame) -> DataFrame:
            # at most MAX_SOURCES rows of 16 bytes
            return df.join(F.broadcast(numbers), "key").withColumn("group", group)

        named = grouped(counted).select("id", "number", "text", "size", "hash", "group")
        self.rows = named.filter("size > 0")
        self.empty = named.filter("size = 0").select("id", "number")
        within = Window.partitionBy("number", "group").orderBy("hash")
        running = self.rows.withColumn(
            "ahead", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1))
        )
        sums = grouped(narrow).groupBy("number", "group").agg(F.sum("size").alias("words"))
        earlier = Window.partitionBy("number").orderBy("group").rowsBetween(
            Window.unboundedPreceding, -1
        )
        bases = sums.select(
            "number", "group", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
        )
        placed = running.join(bases, ["number", "group"]).withColumn(
            "start", F.col("base") + F.coalesce("ahead", F.lit(0))
        )
        pieces = cut_pieces(placed, self.plan)
        drawn = slots(spark, self.plan)
        self.pieces = (
            pieces.join(drawn, ["number", "block"], "left")
            .withColumn("used", F.expr("shard IS NOT NULL AND (take IS NULL OR first < take)"))
            .withColumns({c: F.when(F.col("used"), F.col(c)) for c in ("shard", "slot")})
            .drop("take")
        )

    def blocks(self) -> DataFrame:
        """The mix itself: a row for each slot, (shard, slot, source, block, words, spans, text)."""
        return (
            self.pieces.filter("used")
            .groupBy("shard", "slot", "number", "block")
            .agg(
                F.sum("words").alias("words"),
                F.sort_array(
                    F.collect_list(F.struct("first", "words", "id", "start", "piece"))
                ).alias("held"),
            )
            .join(self.sources.select("number", "source"), "number")
            .select(
                "shard", "slot", "source", "block", "words",
                F.transform(
                    "held", lambda p: F.struct(p["id"].alias("id"), p["first"].alias("first"), p["words"].alias("words"))
                ).alias("spans"),
                # a line end between documents
                F.expr(
                    "array_join(transform(held, (p, i) -> concat(IF(i > 0 AND p.start <>"
                    " get(held, i - 1).start, '\\n', ''), p.piece)), '')"
                ).alias("text"),
            )
        )

    def write(self, path: str) -> None:
        """The mix as Parquet files, a shard's slots in order and together."""
        blocks = self.blocks()
        blocks.repartition("shard").sortWithinPartitions("shard", "slot").write.parquet(path)

    def report(self, id_col: str = "doc_id") -> DataFrame:
        """A row for each document: the words that the mix took, counted in the mix's own pieces."""
        words = F.regexp_count("piece", F.lit(WORD))
        held = self.pieces.groupBy("number", "start", "size", "id").agg(
            F.sum(F.when(F.col("used"), words).otherwise(0)).cast("long").alias("taken")
        )
        none = self.empty.select("number", F.lit(0).cast("long").alias("size"), "id", F.lit(0).cast("long").alias("taken"))
        return (
            held.select("number", "size", "id", "taken")
            .unionByName(none)
            # at most MAX_SOURCES rows of 20 bytes
            .join(F.broadcast(self.sources.drop("source")), "number")
            .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
        )
