"""Language-model scores of whole texts by a hierarchical Pitman-Yor model.

A word is drawn in the restaurant of the word before it; the end token of the text before stands
before a text's first word. All these restaurants, one for every word there is, share one parent,
the restaurant of words alone, and its parent spells new words byte by byte, with a restaurant for
every context of up to four bytes. The tables of a restaurant are the customers of its parent.
Seating is sampled by Gibbs sweeps, and predictive probabilities are averaged over sweeps. The
probabilities of all byte strings sum to one, so unseen words need no special case.

1. Chunks: each task stores its documents as numbers into a list of their words, in the order of
   the words' hashes.
2. Vocabulary: each chunk deals its words out by ranges of hashes into packed lists, as many as the
   words ask for. A bucket numbers its words, adds the counts up and keeps what each chunk asked for.
3. Pairs: each chunk deals its distinct (word before, word) out by a hash of both into packed
   lists, as many as the tokens ask for, so that no frequent word lands in one task. A bucket adds
   the counts up and keeps what each chunk asked for. A pair seen once has one table; the others
   are seated, given their words' probabilities and tables by a join on the word's number.
4. Spelling: grams of all words, weighted by the words' tables, are dealt out by the last two bytes
   of the context; there the contexts of four, three and two bytes are seated. Shorter ones, at
   most 65,536 dishes, are seated on the driver. Blocks of words ask for the grams they have.
   ``ROUNDS`` times spelling, pairs and words take turns.
5. Each chunk gets counts and probabilities of its own words and pairs.

Lists are packed and compressed, and a stored table or a shuffle goes when nothing reads it any
more, so that disk holds little more than the chunks, the pairs and the step that runs.

Words are split at spaces, tabs and line ends after lower-casing A-Z; every text ends with one end
token, the empty word. Training documents are those with crc32(doc_id as text) mod 7 other than 2.

Cases: a null text is an empty one (the end token alone). Rows are scored one by one, so repeated
rows and null or equal ids give a row each; a null id counts as a training document. Without
training documents the base and the model are those of no counts. Other columns are ignored. More
than 2**32 word numbers are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, shuffles_removed
from .common import SPACED, Words, mix, removed
from .pitman_yor import (
    DISCOUNTS,
    ORDER,
    STRENGTH,
    SYMBOLS,
    ByteTree,
    Level,
    SpellingModel,
    byte_grams,
    seat,
)

FOLDS, HELD_FOLD = 7, 2
CHUNK_BYTES = 8 << 20
ROUNDS, SWEEPS, KEPT = 2, 4, 2
#: tokens to a bucket of pairs, rows of the spelling model and words to a block
BUCKET_TOKENS = 2_000_000
BLOCK_GRAMS = 500_000
BLOCK_WORDS = 1 << 16
#: words of chunks to a bucket of the vocabulary, and the ranges of hashes that buckets are made of
BUCKET_WORDS = 1_000_000
RANGE_BITS = 14
RANGES = 1 << RANGE_BITS
#: chunks that a task makes at most; the last one then takes all that is left
TASK_CHUNKS = 2048
SEED = 11
LOW = 2
COMMON = 16
#: strength of the restaurants of the word before
PAIR_STRENGTH = 1.0
UNIFORM = np.full((SYMBOLS, SYMBOLS), 1 / SYMBOLS)

CHUNK = (
    "chunk bigint, n_tokens bigint, n_words bigint, text binary, sizes binary, counts binary, "
    "ranges binary, doc_ids array<bigint>, held array<boolean>, ends binary, tokens binary"
)


def _stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows, written once to the shared scratch folder and read back, and the path."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def held_out():
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return F.coalesce(fold == HELD_FOLD, F.lit(False))


def _chunk(chunk: int, ids: list, held: list[bool], texts: list[str | None]) -> dict:
    w = Words(texts, SPACED)
    h, size = w.hashes, w.stops - w.starts
    coded = pa.array(h).dictionary_encode()
    at, first = coded.indices.to_numpy().astype(np.int64), np.empty(len(coded.dictionary), np.int64)
    # the last one written is the first there is
    first[at[::-1]] = np.arange(len(at))[::-1]
    # two words of one hash would be counted as one: tell them apart by their lengths
    odd = np.flatnonzero(size != size[first][at]) if len(h) else first
    at[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    # in order of the hashes, so that the words of a range of them are a slice
    order = np.argsort(h[first], kind="stable")
    first, place = first[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # the end token, the empty word, closes every text; it is the first word
    at = np.insert(place[at] + 1, w.ends, 0)
    ends = w.ends + np.arange(1, len(ids) + 1)
    trained = np.repeat(~np.array(held, bool), np.diff(ends, prepend=0))
    sizes = size[first]
    skipped = w.starts[first] - (np.cumsum(sizes) - sizes)
    text = w.data[np.repeat(skipped, sizes) + np.arange(sizes.sum())]
    ranges = np.bincount((h[first] >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=RANGES)
    ranges[0] += 1
    n_words = len(first) + 1
    return {
        "chunk": chunk,
        "n_tokens": len(at),
        "n_words": n_words,
        "text": squeezed(text.tobytes()),
        "sizes": packed(np.concatenate([[0], sizes])),
        "counts": packed(np.bincount(at[trained], minlength=n_words)),
        "ranges": packed(ranges),
        "doc_ids": ids,
        "held": held,
        "ends": ends.astype("<i8").tobytes(),
        "tokens": packed(at),
    }


def squeezed(raw: bytes) -> bytes:
    """Compressed bytes, after their number."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Integers from 0 as ``width`` bytes each, all lowest bytes first, compressed."""
    return squeezed(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def encode_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, str]:
    """Stored chunks of about ``chunk_bytes`` of text and at least one document, and their path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CHUNK))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() * TASK_CHUNKS
        last = chunk + TASK_CHUNKS - 1
        ids, held, texts, size = [], [], [], 0
        # few texts at a time: a batch of Spark's has thousands
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            cols = (batch[c].to_pylist() for c in ("doc_id", "held", "text"))
            for doc_id, out, text in zip(*cols):
                ids.append(doc_id)
                held.append(out)
                texts.append(text)
                size += len(text or "")
                if size >= chunk_bytes and chunk < last:
                    yield pa.RecordBatch.from_pylist([_chunk(chunk, ids, held, texts)], schema)
                    ids, held, texts, size, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_chunk(chunk, ids, held, texts)], schema)

    chosen = docs.select("doc_id", held_out().alias("held"), "text")
    return _stored_at(chosen.mapInArrow(encode, CHUNK), "lm-chunks")


def contexts_of(tokens: np.ndarray, ends: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each token 1 + the place of the commonest listed word before it in its text, or 0.

    ``common`` maps a word number to its place in the list, -1 for all other words. Among equals
    the earlier in the list wins. The model does not use it: its contexts are all words.
    """
    place = common[tokens]
    out = np.zeros(len(tokens), np.int64)
    low = 0
    for high in ends.tolist():
        hits = np.flatnonzero(place[low:high] >= 0)
        if len(hits):
            # the counts change at listed words only
            so_far = np.zeros((len(hits), COMMON), np.int32)
            so_far[np.arange(len(hits)), place[low + hits]] = 1
            best = np.cumsum(so_far, 0).argmax(1) + 1
            spans = np.diff(np.append(hits, high - low - 1))
            out[low + hits[0] + 1 : high] = np.repeat(best, spans)
        low = high
    return out


def _numbers(row: pa.RecordBatch, parts: int) -> np.ndarray:
    """The numbers of a chunk's words: of each bucket of the vocabulary, in order, their ranks."""
    own = sorted(row["ids"][0].as_py(), key=lambda x: x["bucket"])
    return np.concatenate([unpacked(x["ranks"]) * parts + x["bucket"] for x in own])


def _chunk_pairs(row: pa.RecordBatch, buckets: int, parts: int) -> tuple[np.ndarray, ...]:
    """A numbered chunk's pairs: (pair of each token, keys, words, order, edges, ends).

    A key is the number of the word before and that of the word, ``words`` are the places of both
    in the chunk. ``order`` sorts the keys by bucket and key, ``edges`` are the buckets' in it.
    """
    tokens = unpacked(row["tokens"][0].as_py())
    ends = np.frombuffer(row["ends"][0].as_py(), "<i8")
    ids = _numbers(row, parts).astype(np.uint64)
    # every text ends with the end token, so the token before a first word is one
    before = np.concatenate([tokens[-1:], tokens[:-1]])
    pairs, at = np.unique(before * len(ids) + tokens, return_inverse=True)
    words = np.divmod(pairs, len(ids))
    keys = (ids[words[0]] << np.uint64(32)) | ids[words[1]]
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(keys)
    # numbers of 16 bits are sorted in one go
    small = np.uint16 if buckets <= 1 << 16 else np.int64
    order = order[np.argsort(bucket[order].astype(small), kind="stable")]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return at, keys, words, order, edges, ends


ASKED = "bucket bigint, chunk bigint, keys binary, n binary"


def _deal(buckets: int, parts: int):
    """The distinct pairs of each chunk with their training counts, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                at, keys, _, order, edges, ends = _chunk_pairs(row, buckets, parts)
                held = np.array(row["held"][0].as_py(), bool)
                trained = np.repeat(~held, np.diff(ends, prepend=0))
                n = np.bincount(at[trained], minlength=len(keys))[order]
                keys, used = keys[order], np.flatnonzero(np.diff(edges))
                cuts = [slice(edges[b], edges[b + 1]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        pa.array([row["chunk"][0].as_py()] * len(used), pa.int64()),
                        pa.array([packed(keys[c], 8) for c in cuts], pa.binary()),
                        pa.array([packed(n[c]) for c in cuts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "keys", "n"],
                )

    return run


BUCKET = (
    "bucket bigint, keys binary, n binary, ones bigint, twos bigint, many_keys binary, "
    "many_n binary, chunks array<bigint>, sizes array<bigint>, places binary"
)
_KINDS = {
    "binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()),
    "double": pa.float64(), "array<binary>": pa.list_(pa.binary()),
}


def _arrow(schema: str) -> pa.Schema:
    """The Arrow form of a schema, also where there is no session."""
    fields = (field.split() for field in schema.split(", "))
    return pa.schema([(name, _KINDS[kind]) for name, kind in fields])


BUCKET_ROW = _arrow(BUCKET)


def _count(asked: pa.Table) -> pa.Table:
    """A bucket's trained pairs and counts, and which of them each chunk asked for, in its order.

    Pairs that are not trained have a count of 0. ``places`` has the steps from each to the next.
    """
    parts = [unpacked(k, 8) for k in asked["keys"].to_pylist()]
    n = np.concatenate([unpacked(k) for k in asked["n"].to_pylist()])
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(at, n, len(keys)).astype(np.int64)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    steps = np.diff(at, prepend=0)
    # each chunk's keys come in order
    steps[starts] = at[starts]
    row = {
        "bucket": asked["bucket"][0].as_py(),
        "keys": packed(keys[n > 0], 8),
        "n": packed(n),
        "ones": int((n == 1).sum()),
        "twos": int((n == 2).sum()),
        "many_keys": packed(keys[n > 1], 8),
        "many_n": packed(n[n > 1]),
        "chunks": asked["chunk"].to_pylist(),
        "sizes": [len(p) for p in parts],
        "places": packed(steps),
    }
    return pa.Table.from_pylist([row], BUCKET_ROW)


def _words_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word numbers of keys, and the places of the words before and the words."""
    ids, at = np.unique(np.concatenate([keys >> 32, keys & 0xFFFFFFFF]), return_inverse=True)
    return ids, at[: len(keys)], at[len(keys) :]


DEGREES = "bucket bigint, ranks binary, followers binary, contexts binary"


def _degrees(parts: int):
    """For each word of a bucket the distinct words after it, and before it, by its own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch["keys"]:
                ids, u, w = _words_of(unpacked(keys.as_py(), 8))
                part = ids % parts
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                used = np.flatnonzero(np.diff(edges))
                cuts = [order[edges[b] : edges[b + 1]] for b in used]
                cols = ids // parts, np.bincount(u, minlength=len(ids)), np.bincount(w, minlength=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        *(pa.array([packed(col[c]) for c in cuts], pa.binary()) for col in cols),
                    ],
                    names=["bucket", "ranks", "followers", "contexts"],
                )

    return run


def _many_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the pairs of a bucket that were seen twice or more."""
    for batch in batches:
        for bucket, keys in zip(batch["bucket"].to_pylist(), batch["many_keys"]):
            ids, _, _ = _words_of(unpacked(keys.as_py(), 8))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * len(ids), pa.int64()), pa.array(ids, pa.int64())],
                names=["bucket", "id"],
            )


SEATED = "bucket bigint, tables binary, sums binary, ids binary, more binary, customers binary"
SEATED_ROW = _arrow(SEATED)


def _seat_pairs(discount: float, seed: int, sweeps: int, kept: int):
    """Seats the pairs of a bucket seen twice or more.

    ``tables`` are the last ones and ``sums`` those of the kept sweeps together. Of each word,
    ``more`` is what its own restaurant had above one table for a pair in the kept sweeps, and
    ``customers`` what it has above that as a dish, by the last.
    """

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return SEATED_ROW.empty_table()
        bucket = pairs["bucket"][0].as_py()
        keys = unpacked(pairs["many_keys"][0].as_py(), 8)
        n = unpacked(pairs["many_n"][0].as_py())
        before = pairs["tables"][0].as_py()
        t = np.ones(len(n), np.int64) if before is None else unpacked(before)
        ids, u, w = _words_of(keys)
        order = np.argsort(words["id"].to_numpy())
        p = words["p"].to_numpy()[order][w]
        above = words["above"].to_numpy()[order][u]
        rng = np.random.default_rng([seed, bucket, len(n)])
        sums = np.zeros(len(n), np.int64)
        for turn in range(sweeps):
            fresh = (PAIR_STRENGTH + discount * np.maximum(above - t, 0)) * p
            t = seat(n, fresh, discount, rng, discount * p)
            if turn >= sweeps - kept:
                sums += t
        more = np.bincount(u, sums - kept, len(ids))
        customers = np.bincount(w, t - 1, len(ids))
        row = {
            "bucket": bucket,
            "tables": packed(t),
            "sums": packed(sums),
            "ids": packed(ids, 8),
            "more": packed(more, 8),
            "customers": packed(customers, 8),
        }
        return pa.Table.from_pylist([row], SEATED_ROW)

    return run


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            cols = ("ids", "more", "customers")
            values = [pa.array(unpacked(batch[c][k].as_py(), 8), pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(values, names=["id", "more", "customers"])


ANSWER = "chunk bigint, bucket bigint, pairs boolean, n binary, tables binary, log_p binary"


def _answer_pairs(kept: int):
    """For each chunk that asked a bucket, counts and summed tables of its pairs in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = unpacked(batch["n"][k].as_py())
                sums = np.where(n > 0, kept, 0)
                sums[n > 1] = unpacked(batch["sums"][k].as_py())
                chunks = batch["chunks"][k].as_py()
                sizes = np.cumsum(batch["sizes"][k].as_py())[:-1]
                steps = np.split(unpacked(batch["places"][k].as_py()), sizes)
                places = [np.cumsum(s) for s in steps]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunks, pa.int64()),
                        pa.array([batch["bucket"][k].as_py()] * len(chunks), pa.int64()),
                        pa.array([True] * len(chunks)),
                        pa.array([packed(n[p]) for p in places], pa.binary()),
                        pa.array([packed(sums[p]) for p in places], pa.binary()),
                        pa.nulls(len(chunks), pa.binary()),
                    ],
                    names=["chunk", "bucket", "pairs", "n", "tables", "log_p"],
                )

    return run


def _answer_words(parts: int):
    """For each chunk with words of a bucket, their counts, tables and logarithms in its order."""

    def run(words: pa.Table, listed: pa.Table) -> pa.Table:
        rank = words["id"].to_numpy() // parts
        cols = []
        for name, kind in (("c", np.int64), ("above", np.int64), ("log_p", float)):
            col = np.empty(len(rank), kind)
            col[rank] = words[name].to_numpy()
            cols.append(col)
        c, above, log_p = cols
        chunks = [x for row in listed["chunks"].to_pylist() for x in row]
        places = [unpacked(x) for row in listed["ranks"].to_pylist() for x in row]
        return pa.Table.from_arrays(
            [
                pa.array(chunks, pa.int64()),
                pa.array(listed["bucket"].to_pylist() * len(chunks), pa.int64()),
                pa.array([False] * len(chunks), pa.bool_()),
                pa.array([packed(c[p], 8) for p in places], pa.binary()),
                pa.array([packed(above[p], 8) for p in places], pa.binary()),
                pa.array([packed(log_p[p].view("<u8"), 8) for p in places], pa.binary()),
            ],
            names=["chunk", "bucket", "pairs", "n", "tables", "log_p"],
        )

    return run


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 20_000):
            some = batch.slice(i, 20_000)
            grams, owner = byte_grams(some["word"].to_pylist())
            tables = some["tables"].to_numpy()[owner]
            keys, at = np.unique(grams, return_inverse=True)
            sums = np.bincount(at, tables, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["gram", "n"])


MODEL = "level int, key bigint, is_context boolean, value double"


def _seat_contexts(top: np.ndarray, sweeps: int, kept: int, seed: int):
    """Seat the contexts of two to four bytes of a partition; its rows share no context.

    Returns averaged probabilities and back-off weights, and at level 1 the tables handed up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(b["gram"].to_numpy(), b["n"].to_numpy()) for b in batches if b.num_rows]
        if not cols:
            return
        grams = np.concatenate([g for g, _ in cols])
        counts = np.concatenate([n for _, n in cols])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        # a seed of the rows, not of the task, so that any partitioning can be repeated
        rng = np.random.default_rng([seed, int(grams[0]), len(grams)])
        tree = ByteTree(grams, counts, ORDER, LOW)
        parent = top[(tree.parent_keys >> 8) & 0xFF, tree.parent_keys & 0xFF]
        dishes = {k: np.zeros(len(level.keys)) for k, level in tree.levels.items()}
        houses = {k: np.zeros(len(level.contexts)) for k, level in tree.levels.items()}
        handed = np.zeros(len(tree.parent_keys))
        for turn in range(sweeps):
            tree.sweep(parent, rng)
            if turn >= sweeps - kept:
                for k, p in tree.predictions(parent).items():
                    dishes[k] += p / kept
                    houses[k] += tree.levels[k].back_off() / kept
                handed += tree.upward() / kept
        parts = [(1, tree.parent_keys, False, np.round(handed))]
        for k, level in tree.levels.items():
            parts += [(k, level.keys, False, dishes[k]), (k, level.contexts, True, houses[k])]
        for k, keys, is_context, values in parts:
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, k, np.int32)),
                    pa.array(keys.astype(np.int64)),
                    pa.array(np.full(n, is_context)),
                    pa.array(values.astype(float)),
                ],
                names=["level", "key", "is_context", "value"],
            )

    return run


def _seat_top(counts: np.ndarray, seed: int, sweeps: int, kept: int) -> np.ndarray:
    """Probabilities of a byte after a byte, from the tables handed up: at most 65,536 dishes."""
    keys = np.flatnonzero(counts)
    flat = np.full(SYMBOLS, 1 / SYMBOLS)
    if not len(keys):
        return np.tile(flat, (SYMBOLS, 1))
    rng = np.random.default_rng([seed, 1])
    pairs, single = Level(keys, DISCOUNTS[1]), Level(np.unique(keys & 0xFF), DISCOUNTS[0])
    pairs.customers = counts[keys].astype(np.int64)
    at = np.searchsorted(single.keys, keys & 0xFF)
    top = np.zeros((SYMBOLS, SYMBOLS))
    for turn in range(sweeps):
        single.customers = np.bincount(at, pairs.tables, len(single.keys)).astype(np.int64)
        single.resample(np.full(len(single.keys), 1 / SYMBOLS), rng)
        alone = single.back_off()[0] * flat
        alone[single.keys] = single.predict(np.full(len(single.keys), 1 / SYMBOLS))
        pairs.resample(alone[keys & 0xFF], rng)
        if turn >= sweeps - kept:
            weight = np.ones(SYMBOLS)
            weight[pairs.contexts] = pairs.back_off()
            now = weight[:, None] * alone
            now[keys >> 8, keys & 0xFF] = pairs.predict(alone[keys & 0xFF])
            top += now / kept
    return top


def fit_spelling(tables: DataFrame, top: np.ndarray, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(stored model rows under ``top``, the next top level) from words and their tables."""
    return _fit_spelling(tables, top, seed)[:2]


def _fit_spelling(
    tables: DataFrame, top: np.ndarray, seed: int
) -> tuple[DataFrame, np.ndarray, str]:
    grams = (
        tables.filter("tables > 0")
        .select("word", "tables")
        .mapInArrow(_gram_counts, "gram bigint, n bigint")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
    )
    # the last two bytes of the context: bits 8 to 24 of a gram
    dealt = grams.repartition(F.expr("(gram >> 8) & 65535"))
    rows, at = _stored_at(
        dealt.mapInArrow(_seat_contexts(top, SWEEPS, KEPT, seed), MODEL), "lm-spelling"
    )
    handed = rows.filter("level = 1").groupBy("key").agg(F.sum("value").alias("n")).collect()
    counts = np.zeros(SYMBOLS * SYMBOLS)
    for r in handed:
        counts[r["key"]] = r["n"]
    return rows.filter("level > 1"), _seat_top(counts, seed, SWEEPS, KEPT), at


def _block_grams(words: list[bytes], tails: int) -> tuple[np.ndarray, ...]:
    """(distinct grams by tail, place of each gram in them, its word, edges of the tails)."""
    grams, owner = byte_grams(words)
    keys, at = np.unique(grams, return_inverse=True)
    tail = ((keys >> 8) & 0xFFFF) % tails
    order = np.argsort(tail, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], place[at], owner, np.searchsorted(tail[order], np.arange(tails + 1))


def spell(words: DataFrame, model: DataFrame, top: np.ndarray) -> DataFrame:
    """Adds ``spelling``, the natural logarithm of the probability of the word's bytes.

    Each block of words asks for its distinct grams by the last two bytes of the context. Such a
    tail, or as many as make up ``BLOCK_GRAMS`` rows of the model, answers all blocks in a task.
    """
    tails = min(1 << 16, max(1, math.ceil(model.count() / BLOCK_GRAMS)))
    # a gram of level k holds k context bytes and a byte, a context k bytes
    tail = F.expr("if(is_context, key & 65535, (key >> 8) & 65535)")
    model = model.withColumn("tail", F.pmod(tail, F.lit(tails)))

    def ask(block: pa.Table) -> pa.Table:
        grams, _, _, edges = _block_grams(block["word"].to_pylist(), tails)
        used = np.flatnonzero(np.diff(edges))
        return pa.table(
            {
                "tail": pa.array(used, pa.int64()),
                "block": pa.array([block["block"][0].as_py()] * len(used), pa.int64()),
                "grams": pa.array([packed(grams[edges[b] : edges[b + 1]], 8) for b in used], pa.binary()),
            }
        )

    def answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
        level, is_context = rows["level"].to_numpy(), rows["is_context"].to_numpy()
        keys, values, tables = rows["key"].to_numpy(), rows["value"].to_numpy(), {}
        for k in range(LOW, ORDER + 1):
            own = []
            for side in (False, True):
                part = np.flatnonzero((level == k) & (is_context == side))
                part = part[np.argsort(keys[part])]
                own += [keys[part], values[part]]
            tables[k] = tuple(own)
        spelling = SpellingModel(top, tables)
        found = [spelling.log_probability(unpacked(g, 8)).tobytes() for g in asked["grams"].to_pylist()]
        return pa.table(
            {"block": asked["block"], "tail": asked["tail"], "logs": pa.array(found, pa.binary())}
        )

    names = words.columns

    def add(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return block.append_column("spelling", pa.array([], pa.float64()))
        _, place, owner, _ = _block_grams(block["word"].to_pylist(), tails)
        order = np.argsort(answers["tail"].to_numpy())
        logs = answers["logs"].to_pylist()
        values = np.concatenate([np.frombuffer(logs[i]) for i in order])
        sums = np.bincount(owner, values[place], block.num_rows)
        return block.select(names).append_column("spelling", pa.array(sums))

    asked = words.select("block", "word").groupBy("block").applyInArrow(
        ask, "tail bigint, block bigint, grams binary"
    )
    answers = (
        asked.groupBy("tail")
        .cogroup(model.groupBy("tail"))
        .applyInArrow(answer, "block bigint, tail bigint, logs binary")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return (
        words.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(add, f"{schema}, spelling double")
    )


def _seat_words(discount: float, tables: float, seed: int, sweeps: int, kept: int, schema: pa.Schema):
    """Seats the restaurant of words alone, given its number of tables.

    ``mid`` gets the mean customers less discounts, ``mean`` the mean tables, ``tables`` the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch["customers"].to_numpy()
            t = np.minimum(batch["tables"].to_numpy(), c)
            p0 = np.exp(batch["spelling"].to_numpy())
            # a seed of the rows, not of the task
            rng = np.random.default_rng([seed, len(c), int(c.sum()), int(batch["id"][0].as_py())])
            mid, mean = np.zeros(len(c)), np.zeros(len(c))
            for turn in range(sweeps):
                fresh = (STRENGTH + discount * np.maximum(tables - t, 0)) * p0
                t = seat(c, fresh, discount, rng, discount * p0)
                if turn >= sweeps - kept:
                    mid += np.maximum(c - discount * t, 0) / kept
                    mean += t / kept
            new = {"tables": pa.array(t, pa.int64()), "mid": pa.array(mid), "mean": pa.array(mean)}
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else batch[c] for c in schema.names], schema=schema
            )

    return run


ASKED_WORDS = "bucket bigint, chunk bigint, text binary, sizes binary, counts binary"


def _deal_words(parts: int):
    """The words of each chunk with their training counts, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.arange(parts + 1) * RANGES // parts
        for batch in batches:
            for k in range(batch.num_rows):
                text = unsqueezed(batch["text"][k].as_py())
                sizes, counts = (unpacked(batch[c][k].as_py()) for c in ("sizes", "counts"))
                edges = np.append(0, np.cumsum(unpacked(batch["ranges"][k].as_py())))[firsts]
                stops = np.append(0, np.cumsum(sizes))[edges].tolist()
                used = np.flatnonzero(np.diff(edges))
                cuts = [slice(edges[b], edges[b + 1]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        pa.array([batch["chunk"][k].as_py()] * len(used), pa.int64()),
                        pa.array([squeezed(text[stops[b] : stops[b + 1]]) for b in used], pa.binary()),
                        pa.array([packed(sizes[c]) for c in cuts], pa.binary()),
                        pa.array([packed(counts[c]) for c in cuts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "text", "sizes", "counts"],
                )

    return run


LISTED = (
    "bucket bigint, n_words bigint, text binary, sizes binary, c binary, chunks array<bigint>, "
    "ranks array<binary>"
)


def _binary(text: bytes, sizes: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    """Words from their bytes in a row and their lengths."""
    width = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.append(0, np.cumsum(sizes)).astype(width)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def _list_words(asked: pa.Table) -> pa.Table:
    """A bucket's words and counts, frequent ones first, and the ranks of each chunk's, in its order."""
    sizes = [unpacked(x) for x in asked["sizes"].to_pylist()]
    words = _binary(
        b"".join([unsqueezed(x) for x in asked["text"].to_pylist()]), np.concatenate(sizes)
    ).dictionary_encode()
    at, words = words.indices.to_numpy(), words.dictionary
    counts = np.concatenate([unpacked(x) for x in asked["counts"].to_pylist()])
    c = np.bincount(at, counts, len(words)).astype(np.int64)
    order = pc.sort_indices(
        pa.table({"c": c, "word": words}), [("c", "descending"), ("word", "ascending")]
    )
    words, order = words.take(order), order.to_numpy()
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c))
    ranks = np.split(rank[at], np.cumsum([len(x) for x in sizes])[:-1])
    _, offsets, text = words.buffers()
    row = {
        "bucket": asked["bucket"][0].as_py(),
        "n_words": len(c),
        "text": squeezed(text.to_pybytes() if text else b""),
        "sizes": packed(np.diff(np.frombuffer(offsets, np.int64)[: len(c) + 1])),
        "c": packed(c[order], 8),
        "chunks": asked["chunk"].to_pylist(),
        "ranks": [packed(x) for x in ranks],
    }
    return pa.Table.from_pylist([row], _arrow(LISTED))


def _listing(listed: pa.Table, parts: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers, words and counts of a bucket of words."""
    sizes, c = unpacked(listed["sizes"][0].as_py()), unpacked(listed["c"][0].as_py(), 8)
    words = _binary(unsqueezed(listed["text"][0].as_py()), sizes)
    return np.arange(len(c)) * parts + listed["bucket"][0].as_py(), words.cast(pa.binary()), c


WORD_ROWS = "id bigint, word binary, c bigint, followers bigint, contexts bigint"


def _word_rows(parts: int):
    """The words of a bucket with their counts and the distinct words after and before them."""

    def run(listed: pa.Table, degrees: pa.Table) -> pa.Table:
        ids, words, c = _listing(listed, parts)
        sums = {name: np.zeros(len(c), np.int64) for name in ("followers", "contexts")}
        for row in degrees.to_pylist():
            ranks = unpacked(row["ranks"])
            for name, total in sums.items():
                total[ranks] += unpacked(row[name])
        return pa.table({"id": ids, "word": words, "c": c} | sums)

    return run


def vocabulary(chunks: DataFrame) -> tuple[DataFrame, str, int]:
    """(stored buckets of words, their path, their number).

    Chunks deal their words out by the hash, so a bucket has all counts of its words. The number
    of a word is its rank in the bucket, times the number of buckets, and the bucket: frequent
    words get small numbers, which take less room. A bucket keeps the ranks of each chunk's words.
    """
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = min(RANGES, max(1, math.ceil(size / BUCKET_WORDS)))
    dealt = chunks.select("chunk", "text", "sizes", "counts", "ranges").mapInArrow(
        _deal_words(parts), ASKED_WORDS
    )
    listed, at = _stored_at(dealt.groupBy("bucket").applyInArrow(_list_words, LISTED), "lm-words")
    stride = listed.agg(F.coalesce(F.max("n_words"), F.lit(0))).first()[0]
    if parts * stride > 1 << 32:
        raise ValueError(f"{parts * stride} word numbers are needed, 2**32 are possible")
    return listed, at, parts


def numbered(chunks: DataFrame, listed: DataFrame) -> tuple[DataFrame, str]:
    """Stored chunks with the ranks of their words in place of the words."""
    ids = (
        listed.select("bucket", F.explode(F.arrays_zip("chunks", "ranks")).alias("own"))
        .select(F.col("own.chunks").alias("chunk"), "bucket", F.col("own.ranks").alias("ranks"))
        # at most one row a chunk and bucket: nothing to add up before
        .repartition("chunk")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("bucket", "ranks")).alias("ids"))
    )
    rest = chunks.drop("n_words", "text", "sizes", "counts", "ranges")
    return _stored_at(rest.join(ids, "chunk"), "lm-numbered")


def count_pairs(chunks: DataFrame, parts: int) -> tuple[DataFrame, str, int]:
    """(stored buckets of pairs, their path, their number) of numbered chunks."""
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size / BUCKET_TOKENS))
    dealt = chunks.mapInArrow(_deal(buckets, parts), ASKED)
    return *_stored_at(dealt.groupBy("bucket").applyInArrow(_count, BUCKET), "lm-pairs"), buckets


def _discount(once: int, twice: int) -> float:
    return min(max((once + 1) / (once + 2 * twice + 2), 0.1), 0.95)


def fit(
    listed: DataFrame, parts: int, pairs: DataFrame, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, str, DataFrame, str, dict]:
    """(stored words, their path, stored seated pairs, their path, totals).

    Words have their training count ``c``, the natural logarithm ``log_p`` of their probability
    in the parent and, as a context, ``above``, their restaurant's tables in all kept sweeps. ``totals``
    has the training tokens ``n``, distinct ones ``v`` and the ``discount`` of the pairs.
    """
    degrees = pairs.select("keys").mapInArrow(_degrees(parts), DEGREES)
    words = (
        listed.select("bucket", "text", "sizes", "c").groupBy("bucket")
        .cogroup(degrees.groupBy("bucket"))
        .applyInArrow(_word_rows(parts), WORD_ROWS)
    )
    none = F.lit(0).cast("bigint")
    spark = words.sparkSession
    words, at = _stored_at(
        words.select(
            "id",
            F.expr(f"id div {BLOCK_WORDS}").alias("block"),
            "word",
            "c",
            "followers",
            "contexts",
            F.col("followers").cast("double").alias("above"),
            F.col("contexts").alias("customers"),
            (F.col("c") > 0).cast("bigint").alias("tables"),
            F.lit(0.0).alias("mid"),
            F.lit(0.0).alias("mean"),
        ),
        "lm-degrees",
    )
    n, v, customers, once, twice = words.agg(
        *(
            F.coalesce(x, F.lit(0))
            for x in (
                F.sum("c"), F.count_if(F.col("c") > 0), F.sum("contexts"),
                F.count_if(F.col("contexts") == 1), F.count_if(F.col("contexts") == 2),
            )
        )
    ).first()
    low, tables = _discount(once, twice), float(v)
    # a word has at first one table, and all its other customers are its own
    words = words.withColumn("mid", F.greatest(F.col("customers") - low * F.col("tables"), F.lit(0.0)))
    once, twice = pairs.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("ones", "twos"))).first()
    high = _discount(once, twice)
    asked, asked_at = _stored_at(
        pairs.select("bucket", "many_keys").mapInArrow(_many_words, "bucket bigint, id bigint"), "lm-asked"
    )
    many = pairs.select("bucket", "many_keys", "many_n")
    seated = many.withColumn("tables", F.lit(None).cast("binary"))
    names, top, seats_at = words.columns, UNIFORM, None
    for turn in range(rounds):
        model, next_top, model_at = _fit_spelling(words.select("word", "tables"), top, seed + turn)
        spelled, spelled_at = _stored_at(spell(words, model, top), "lm-spelled")
        removed(spark, model_at)
        removed(spark, at)
        top = next_top
        p = F.exp(_log_p(low, tables, customers))
        found = asked.join(spelled.select("id", p.alias("p"), "above"), "id")
        last_at = seats_at
        seats, seats_at = _stored_at(
            seated.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
                _seat_pairs(high, seed + turn, SWEEPS, KEPT), SEATED
            ),
            "lm-seated",
        )
        if last_at:
            removed(spark, last_at)
        seated = many.join(seats.select("bucket", "tables"), "bucket")
        handed = (
            seats.select("ids", "more", "customers").mapInArrow(_handed, "id bigint, more bigint, customers bigint")
            .groupBy("id").agg(F.sum("more").alias("more"), F.sum("customers").alias("extra"))
        )
        fed = spelled.join(handed, "id", "left").withColumns(
            {
                "above": F.col("followers") + F.coalesce("more", none) / float(KEPT),
                "customers": F.col("contexts") + F.coalesce("extra", none),
            }
        ).select(*names, "spelling")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fed.schema)
        words, at = _stored_at(
            fed.mapInArrow(
                _seat_words(low, tables, seed + turn, SWEEPS, KEPT, _arrow(kind)), kind
            ),
            "lm-fed",
        )
        removed(spark, spelled_at)
        customers, tables = words.agg(
            F.coalesce(F.sum("customers"), none), F.coalesce(F.sum("mean"), F.lit(0.0))
        ).first()
        last = words.select(
            "id", "c", (F.col("above") * KEPT).cast("bigint").alias("above"),
            _log_p(low, tables, customers).alias("log_p"),
        )
        words = words.select(names)
    removed(spark, asked_at)
    last, last_at = _stored_at(last, "lm-fitted")
    removed(spark, at)
    return last, last_at, seats, seats_at, {"n": n, "v": v, "discount": high}


def _log_p(discount: float, tables: float, customers: int) -> Column:
    """Natural logarithm of a word's probability in the restaurant of words alone.

    Logarithms are only taken of a sum where a word has a share of its own; a very long word's
    spelling has no probability that is a number.
    """
    house = STRENGTH + customers
    new = F.col("spelling") + math.log((STRENGTH + discount * tables) / house)
    return F.when(F.col("mid") > 0, F.log(F.col("mid") / house + F.exp(new))).otherwise(new)


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def log_probabilities(
    n: np.ndarray, sums: np.ndarray, c: np.ndarray, above: np.ndarray, log_p: np.ndarray, discount: float
) -> np.ndarray:
    """Natural logarithms of words after words.

    A pair's count ``n`` and tables in all kept sweeps, the count ``c`` and such tables ``above``
    of the word before, ``log_p`` of the word in the parent.
    """
    house = PAIR_STRENGTH + c
    back = (PAIR_STRENGTH + discount * above / KEPT) / house
    own = (n - discount * sums / KEPT) / house
    out = np.log(back) + log_p
    some = own > 0
    out[some] = np.log(own[some] + back[some] * np.exp(log_p[some]))
    return out


def _score(n: int, v: int, discount: float, buckets: int, parts: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.combine_chunks().to_batches()[0]
        at, keys, (u, w), order, edges, ends = _chunk_pairs(row, buckets, parts)
        counts, sums = np.zeros(len(keys)), np.zeros(len(keys))
        found = answers.sort_by("bucket")
        own = found.filter(pc.field("pairs"))
        for bucket, a, b in zip(*(own[x].to_pylist() for x in ("bucket", "n", "tables"))):
            places = order[edges[bucket] : edges[bucket + 1]]
            counts[places], sums[places] = unpacked(a), unpacked(b)
        # a chunk has its words in the order of their buckets
        own = found.filter(~pc.field("pairs"))
        c, above, log_p = (
            np.concatenate([unpacked(x, 8) for x in own[name].to_pylist()])
            for name in ("n", "tables", "log_p")
        )
        logs = log_probabilities(
            counts, sums, c[u], above[u], log_p.view(float)[w], discount
        ) / math.log(10)
        tokens = unpacked(row["tokens"][0].as_py())
        starts = np.concatenate([[0], ends[:-1]])
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        return pa.Table.from_arrays(
            [
                pa.array(row["doc_ids"][0].as_py(), pa.int64()),
                pa.array(row["held"][0].as_py(), pa.bool_()),
                pa.array(np.diff(ends, prepend=0), pa.int64()),
                pa.array(np.add.reduceat((c > 0).astype(np.int64)[tokens], starts), pa.int64()),
                pa.array([n] * len(ends), pa.int64()),
                pa.array(np.add.reduceat(base[tokens], starts), pa.float64()),
                pa.array(np.add.reduceat(logs[at], starts), pa.float64()),
            ],
            names=[
                "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
            ],
        )

    return run


def score_texts(
    docs: DataFrame, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Per row: the base score and the model's log10 probability of the whole text."""
    with shuffles_removed(docs.sparkSession):
        return _score_texts(docs, rounds, chunk_bytes)


def _score_texts(docs: DataFrame, rounds: int, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    encoded, at = encode_chunks(docs, chunk_bytes)
    listed, listed_at, parts = vocabulary(encoded)
    chunks, _ = numbered(encoded, listed)
    removed(spark, at)
    pairs, pairs_at, buckets = count_pairs(chunks, parts)
    words, words_at, seats, seats_at, totals = fit(listed, parts, pairs, rounds)
    answers, _ = _stored_at(
        pairs.select("bucket", "n", "chunks", "sizes", "places")
        .join(seats.select("bucket", "sums"), "bucket")
        .mapInArrow(_answer_pairs(KEPT), ANSWER),
        "lm-answers",
    )
    removed(spark, pairs_at)
    removed(spark, seats_at)
    own, _ = _stored_at(
        words.withColumn("bucket", F.pmod("id", F.lit(parts)))
        .groupBy("bucket")
        .cogroup(listed.select("bucket", "chunks", "ranks").groupBy("bucket"))
        .applyInArrow(_answer_words(parts), ANSWER),
        "lm-answers",
    )
    removed(spark, words_at)
    removed(spark, listed_at)
    # one chunk at a time
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.union(own).groupBy("chunk"))
        .applyInArrow(_score(totals["n"], totals["v"], totals["discount"], buckets, parts), SCORES)
    )
