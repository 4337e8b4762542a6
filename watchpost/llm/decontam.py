"""Benchmark passages in training documents, by a distributed positional inverted index.

The documents are indexed where they lie, in segments of about ``SEGMENT_BYTES`` of text and at
least one whole document. A segment is one stored row: its term dictionary (ordered by hash, with
the terms' bytes), and for each term the ascending word positions at which it stands. Queries visit
every segment on their own; nothing is shuffled. A segment is a row group by itself, so tasks that
write or search many of them hold one after another.

An exact phrase is found by intersecting its terms' lists, each moved back by the term's offset in
the phrase, from the rarest term in the segment upwards, until the list is empty or all terms
have been used. Proximity matches take the positions of the rarest term that have every other term
within a distance.

Queries are sent out in blocks of at most ``BLOCK_CHARS`` characters of benchmark text, so the size
of what is broadcast is bounded; with several blocks their matches are united by document.

Cases: a null or empty text has no words, and items without words never match. Documents are
judged row by row, so repeated rows and null or equal ids give a row each. Repeated items count
once for each ``item_id``; an item with a null id can hit words but is left out of the digest.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import ALNUM, Words, mix, removed, small_batches, stored

SEGMENT_BYTES = 6 << 20
#: documents of an Arrow batch that are Python objects at a time
AT_ONCE = 256
BLOCK_CHARS = 16 << 20
PHRASE = 10

SEGMENT = (
    "part int, segment int, doc_ids array<bigint>, keys array<bigint>, doc_ends binary, "
    "terms binary, term_bytes binary, term_ends binary, list_ends binary, steps binary"
)
MATCHED = (
    "part int, segment int, nth int, doc_id bigint, key bigint, n_words bigint, hits array<int>, "
    "items array<string>"
)


def _next_key(h):
    """Where a term goes on whose hash is taken by another term."""
    return mix(np.asarray(h, np.uint64) + np.uint64(1))


def _same_bytes(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` have the same bytes, pair by pair."""
    size = w.stops[a] - w.starts[a]
    same = size == w.stops[b] - w.starts[b]
    todo = np.flatnonzero(same & (a != b))
    size = size[todo]
    for k in range(int(size.max(initial=0))):
        live = size > k
        if not live.all():
            todo, size = todo[live], size[live]
        equal = w.data[w.starts[a[todo]] + k] == w.data[w.starts[b[todo]] + k]
        if not equal.all():
            same[todo[~equal]] = False
            todo, size = todo[equal], size[equal]
    return same


def _planes(values: np.ndarray) -> bytes:
    """32-bit values by byte planes, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(packed: bytes) -> np.ndarray:
    flat = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").ravel().astype(np.int64)


def index_segment(texts: list[str | None]) -> dict[str, bytes]:
    w = Words(texts, ALNUM)
    h = w.hashes
    while True:
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(h) else np.zeros(0, bool)
        firsts = order[new]
        of_term = np.cumsum(new) - 1
        other = ~_same_bytes(w, order, firsts[of_term]) if len(h) else new
        if not other.any():
            break
        h[order[other]] = _next_key(h[order[other]])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(h)]]) if len(h) else np.zeros(0, int)
    steps = np.diff(order, prepend=0)
    steps[new] = firsts
    sizes = w.stops[firsts] - w.starts[firsts]
    return {
        "doc_ends": w.ends.astype("<i4").tobytes(),
        "terms": ranked[new].astype("<u8").tobytes(),
        "term_bytes": b"".join(
            [w.data[a:b].tobytes() for a, b in zip(w.starts[firsts].tolist(), w.stops[firsts].tolist())]
        ),
        "term_ends": _planes(np.cumsum(sizes)),
        "list_ends": _planes(ends),
        "steps": _planes(steps),
    }


def build_index(docs: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Store the segments of all documents at ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SEGMENT))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        ids, keys, texts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            one = {"part": part, "segment": segment, "doc_ids": ids, "keys": keys}
            return pa.RecordBatch.from_pylist([one | index_segment(texts)], schema)

        for part_of in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            columns = [part_of[c].to_pylist() for c in ("doc_id", "key", "text")]
            for doc_id, key, text, n in zip(*columns, pc.binary_length(part_of["text"]).to_pylist()):
                ids.append(doc_id)
                keys.append(key)
                texts.append(text)
                size += n or 0
                if size >= segment_bytes:
                    yield row()
                    ids, keys, texts, size, segment = [], [], [], 0, segment + 1
        if ids:
            yield row()

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    # a row group for each segment: the writer would hold 100 of them before it first looks at
    # their size, and readers hold a whole group
    keyed.mapInArrow(index, SEGMENT).write.options(
        **{"compression": "zstd", "parquet.block.row.count.limit": "1"}
    ).parquet(path)


class Segment:
    """A stored segment, opened for lookups."""

    def __init__(self, row: dict):
        self.doc_ends = np.frombuffer(row["doc_ends"], "<i4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.bytes, self.term_ends = row["term_bytes"], _unplanes(row["term_ends"])
        self.list_ends, self.steps = _unplanes(row["list_ends"]), _unplanes(row["steps"])

    def number(self, term: bytes, h: np.uint64) -> int:
        """The term's place in the dictionary, -1 if it is not there."""
        while True:
            at = int(np.searchsorted(self.terms, h))
            if at == len(self.terms) or self.terms[at] != h:
                return -1
            low = int(self.term_ends[at - 1]) if at else 0
            if self.bytes[low : int(self.term_ends[at])] == term:
                return at
            h = np.uint64(_next_key(h))

    def numbers(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        out = np.full(len(terms), -1, np.int64)
        if len(self.terms):
            for i in np.flatnonzero(self.terms[at] == hashes).tolist():
                out[i] = self.number(terms[i], hashes[i])
        return out

    def frequency(self, numbers: np.ndarray) -> np.ndarray:
        return self.list_ends[numbers] - np.where(numbers > 0, self.list_ends[numbers - 1], 0)

    def positions(self, number: int) -> np.ndarray:
        low = int(self.list_ends[number - 1]) if number else 0
        return np.cumsum(self.steps[low : int(self.list_ends[number])])

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, positions, "right")

    def phrase(self, numbers: list[int], lists: dict[int, np.ndarray]) -> np.ndarray:
        """Positions at which the terms stand one after another within one document."""
        at = None
        for k in np.argsort(self.frequency(np.array(numbers)), kind="stable").tolist():
            n = numbers[k]
            if n not in lists:
                lists[n] = self.positions(n)
            moved = lists[n]
            if at is None:
                at = moved - k
            else:
                found = np.minimum(np.searchsorted(moved, at + k), len(moved) - 1)
                at = at[moved[found] == at + k]
            if not len(at):
                return at
        return at[self.doc_of(at) == self.doc_of(at + len(numbers) - 1)]

    def near(self, numbers: list[int], distance: int) -> np.ndarray:
        """Positions of the rarest term with every other within ``distance`` words, same document."""
        ranked = sorted(set(numbers), key=lambda n: int(self.frequency(np.array([n]))[0]))
        at = self.positions(ranked[0])
        for n in ranked[1:]:
            other = self.positions(n)
            after = np.searchsorted(other, at)
            ok = np.zeros(len(at), bool)
            for side in (after - 1, after):
                inside = (side >= 0) & (side < len(other))
                q = other[np.clip(side, 0, len(other) - 1)]
                ok |= inside & (np.abs(q - at) <= distance) & (self.doc_of(q) == self.doc_of(at))
            at = at[ok]
        return at


class Phrases:
    """Windows of ``length`` words of each item; an item of fewer words is one window."""

    def __init__(self, items: list[tuple[int | None, str | None]], length: int = PHRASE):
        w = Words([text for _, text in items], ALNUM)
        known: dict[bytes, int] = {}
        raw = w.data.tobytes()
        spans = zip(w.starts.tolist(), w.stops.tolist())
        words = [known.setdefault(raw[a:b], len(known)) for a, b in spans]
        self.terms = list(known)
        self.hashes = np.zeros(len(known), np.uint64)
        self.hashes[words] = w.hashes
        self.windows: dict[tuple[int, ...], set[str | None]] = {}
        low = 0
        for (item, _), high in zip(items, w.ends.tolist()):
            own = words[low:high]
            for k in range(max(len(own) - length, 0) + 1 if own else 0):
                window = tuple(own[k : k + length])
                self.windows.setdefault(window, set()).add(None if item is None else str(item))
            low = high


def _search(phrases, distance: int | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Phrases = phrases.value
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                segment = Segment(row)
                numbers = segment.numbers(asked.terms, asked.hashes)
                n_words = np.diff(segment.doc_ends, prepend=0)
                hit = np.zeros(int(n_words.sum()), bool)
                items: dict[int, set] = {}
                lists: dict[int, np.ndarray] = {}
                for window, names in asked.windows.items():
                    own = numbers[list(window)].tolist()
                    if min(own) < 0:
                        continue
                    if distance is None:
                        at, size = segment.phrase(own, lists), len(own)
                    else:
                        at, size = segment.near(own, distance), 1
                    for k in range(size):
                        hit[at + k] = True
                    for doc in np.unique(segment.doc_of(at)).tolist():
                        items.setdefault(doc, set()).update(names)
                starts = (segment.doc_ends - n_words).tolist()
                hits = [
                    np.flatnonzero(hit[a:b]) if d in items else []
                    for d, (a, b) in enumerate(zip(starts, segment.doc_ends.tolist()))
                ]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(range(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["keys"], pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array(hits, pa.list_(pa.int32())),
                        pa.array(
                            [sorted(items.get(d, ()), key=lambda x: (x is None, x)) for d in range(n)],
                            pa.list_(pa.string()),
                        ),
                    ],
                    names=[
                        "part", "segment", "nth", "doc_id", "key", "n_words", "hits", "items",
                    ],
                )

    return search


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = PHRASE,
    distance: int | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: doc_id, key (hash of its text), n_words, hit word positions, item ids.

    With ``distance`` the windows match wherever their words stand that close, in any order.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "positional-index")
    with small_batches(spark):
        build_index(docs, path)
    items = benchmark.select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * chars / block_chars)) if chars > block_chars else 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.filter(block == b).collect()]
        phrases = spark.sparkContext.broadcast(Phrases(own, length))
        part = spark.read.schema(SEGMENT).parquet(path).mapInArrow(
            _search(phrases, distance), MATCHED
        )
        with small_batches(spark):
            part = stored(part, "passages")
        phrases.unpersist()
        found = part if found is None else found.unionByName(part)
    removed(spark, path)
    if blocks == 1:
        return found
    return found.groupBy("part", "segment", "nth", "doc_id", "key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without a benchmark passage; rows of one id and text go or stay together."""
    found = find_passages(docs, benchmark, **params).filter(F.size("hits") > 0)
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    clean = rows.join(
        bad,
        F.col("_row")["doc_id"].eqNullSafe(F.col("_doc"))
        & (F.xxhash64(F.col("_row")["text"]) == F.col("_key")),
        "left_anti",
    )
    return clean.select("_row.*")
