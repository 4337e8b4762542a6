"""Packing documents into fixed-length sequences by patterns of lengths.

Documents are encoded once; only those longer than a sequence are cut, into pieces of the full
length and a rest. What is left of the packing is a histogram of at most ``capacity`` lengths.
Patterns of one to three lengths that fill a sequence are enumerated, repeat counts are
fitted to the histogram by non-negative least squares (multiplicative updates), rounded to what the
histogram holds, and the residual pieces are packed best fit first, longest first. Every step
works on counts, so the plan has the same bounded size for any corpus.

A piece finds its place by its length and its number among the pieces of that length, which is
its number within its task plus the count in earlier tasks.

Cases: a null text is an empty one (the end id alone). Rows are packed one by one, so repeated rows
and null or equal ids give pieces each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .encode import encoder

CAPACITY = 2048
FIT_ROUNDS = 120
RICH = 10
PIECES = (
    "part int, nth int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
)
PLACED = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint"
)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Encoded pieces; ``nth`` numbers the pieces of one length within a task ``part``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                cols: list[list] = [[] for _ in range(7)]
                for key, packed in zip(
                    some["doc_id"].to_pylist(), enc.encode(some["text"].to_pylist())
                ):
                    ids = np.frombuffer(packed, enc.dtype).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        row = (part, seen[len(own)], key, piece, start, len(own), zlib.crc32(own))
                        seen[len(own)] += 1
                        for col, value in zip(cols, row):
                            col.append(value)
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def few_piece_patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Triples of lengths of the histogram, 0 for none, that fill a sequence.

    They fill it exactly if there are at least ``RICH`` such patterns for each length. A sparse
    histogram has fewer; then gaps are let in, one token wider at a time up to a sixteenth.
    """
    present = present.copy()
    present[0] = True
    lengths = np.flatnonzero(present)
    found, total = [np.zeros((0, 3), np.int64)], 0
    for filled in range(capacity, capacity - capacity // 16 - 1, -1):
        for a in lengths[(lengths > 0) & (lengths <= filled)].tolist():
            # a >= b >= c with a + b + c = filled
            b = lengths[
                (lengths <= a) & (lengths <= filled - a) & (2 * lengths >= filled - a)
            ]
            c = filled - a - b
            keep = present[c]
            found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
            total += int(keep.sum())
        if total >= RICH * len(lengths):
            break
    return np.concatenate(found)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts whose pieces come closest to the histogram in squares."""
    used = patterns > 0

    def pieces(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts))
        for k in range(3):
            out += np.bincount(patterns[:, k], x * used[:, k], len(counts))
        return out

    def back(values: np.ndarray) -> np.ndarray:
        return (values[patterns] * used).sum(1)

    x = np.full(len(patterns), counts.sum() / max(len(patterns), 1) / 3)
    goal = back(counts.astype(float))
    for _ in range(rounds):
        x *= goal / np.maximum(back(pieces(x)), 1e-12)
    return x


def plan_patterns(
    counts: np.ndarray, capacity: int = CAPACITY, rounds: int = FIT_ROUNDS
) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = few_piece_patterns(capacity, left > 0)
    if len(patterns):
        fitted = fit_counts(patterns, left, rounds)
        for p in np.argsort(-fitted, kind="stable").tolist():
            repeats = int(fitted[p] + 0.5)
            if not repeats:
                break
            lengths = tuple(n for n in patterns[p].tolist() if n)
            for n in set(lengths):
                repeats = min(repeats, int(left[n]) // lengths.count(n))
            if repeats:
                plan.append((lengths, repeats))
                for n in lengths:
                    left[n] -= repeats
    return plan + best_fit(left, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on groups of sequences that look alike."""
    left = counts.tolist()
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = [r for r in room if r >= length and room[r]]
            if fits:
                best = min(fits)
                lengths, n = next(iter(room[best].items()))
            else:
                # as many new sequences as this length alone would fill
                best, lengths = capacity, ()
                n = -(-left[length] // (capacity // length))
            used = min(n, left[length])
            if lengths:
                del room[best][lengths]
                if n > used:
                    room[best][lengths] = n - used
            grown = (*lengths, length)
            rest = room[best - length]
            rest[grown] = rest.get(grown, 0) + used
            left[length] -= used
    return [(lengths, n) for groups in room.values() for lengths, n in groups.items()]


class Slots:
    """For each length, the places that the plan has for its pieces, in order."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], capacity: int):
        by_length: dict[int, list] = defaultdict(list)
        ahead, base = [0] * (capacity + 1), 0
        for lengths, repeats in plan:
            offsets: dict[int, list[int]] = defaultdict(list)
            at = 0
            for n in lengths:
                offsets[n].append(at)
                at += n
            for n, places in offsets.items():
                by_length[n].append((ahead[n], base, places))
                ahead[n] += len(places) * repeats
            base += repeats
        self.tables = {
            n: (
                np.array([r[0] for r in rows], np.int64),
                np.array([r[1] for r in rows], np.int64),
                np.array([len(r[2]) for r in rows], np.int64),
                np.cumsum([0, *(len(r[2]) for r in rows)]),
                np.array([o for r in rows for o in r[2]], np.int64),
            )
            for n, rows in by_length.items()
        }

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            own = lengths == n
            firsts, bases, copies, starts, places = self.tables[n]
            row = np.searchsorted(firsts, numbers[own], "right") - 1
            k = numbers[own] - firsts[row]
            sequence[own] = bases[row] + k // copies[row]
            offset[own] = places[starts[row] + k % copies[row]]
        return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rounds: int = FIT_ROUNDS
) -> DataFrame:
    """One row per piece: its place in the document, in a sequence, and a checksum of its ids."""
    # written once: the numbers within a task must not change when a task runs again
    pieces = stored(cut_documents(docs, tokenizer, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = Slots(plan_patterns(counts, capacity, rounds), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = by_part.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.place(
                batch["length"].to_numpy(), batch["number"].to_numpy(zero_copy_only=False)
            )
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[
                    "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                ],
            )

    return (
        pieces.join(before, ["part", "length"])
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("before") + F.col("nth")).alias("number"),
        )
        .mapInArrow(place, PLACED)
    )
