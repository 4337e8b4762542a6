"""Token-id shards with a minimal perfect hash index over their document keys.

Documents are dealt out by ranges of ``doc_id``, encoded in that order and stored as shards, one
row each: raw ids (two bytes an id where the vocabulary fits), the place of each document, and an
index. The index is minimal perfect hashing by levels: at each level every remaining key is hashed
to twice as many bits as there are keys; a bit hit by one key only is set and is that key's slot,
and keys that meet go on to the next level. A slot's number is the count of bits set before it,
from stored counts by word, so a lookup takes constant time. Slots hold a 32-bit fingerprint, which
turns away keys that are not in the shard, and the key's first document.

Cases: a null text is an empty one. Documents of equal ``doc_id`` are stored one after another and
a lookup returns all of them. Documents with a null ``doc_id`` come first; they are read with the
shard, but no key finds them. An empty table makes no shards. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mix, sum_before
from .encode import encoder

SHARD_IDS = 1 << 20
SHARD = (
    "part int, shard int, first_key bigint, last_key bigint, n_null int, n_docs int, n_ids bigint, "
    "width int, level_bits binary, level_sizes binary, ranks binary, fingerprints binary, "
    "firsts binary, runs binary, keys binary, places binary, ids binary"
)
FOUND = "part int, shard int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
_SEED = 0xD6E8FEB86659FD93


def _at_level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((_SEED * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(
        np.int64
    )


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(_SEED)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps each of n distinct 64-bit keys to a slot of its own in 0..n-1."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, ranks: np.ndarray):
        self.bits, self.sizes, self.ranks = bits, sizes, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, bits, sizes = keys.view(np.uint64), [], []
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = _at_level(rest, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            bits.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[hits[at] != 1]
        all_bits = np.concatenate(bits) if bits else np.zeros(0, "<u8")
        ranks = np.cumsum(np.bitwise_count(all_bits), dtype=np.uint32)
        return cls(all_bits, np.array(sizes, "<u4"), np.concatenate([[0], ranks]).astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys; -1 where no level has a bit for a key."""
        keys = keys.view(np.uint64)
        out, todo, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _at_level(keys[todo], level, size)
            word, bit = before + (at >> 6), (at & 63).astype(np.uint64)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            lower = value & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.ranks[word] + np.bitwise_count(lower))[hit]
            todo = todo[~hit]
            before += size >> 6
        return out


def _shard(part: int, shard: int, keys: list[int | None], docs: list[bytes], width: int) -> dict:
    n_null = sum(k is None for k in keys)
    known = np.array(keys[n_null:], np.int64)
    distinct, firsts, runs = np.unique(known, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    by_slot = np.empty(len(distinct), np.int64)
    by_slot[slots] = np.arange(len(distinct))
    places = np.cumsum([0, *(len(d) // width for d in docs)], dtype="<i8")
    return {
        "part": part,
        "shard": shard,
        "first_key": int(distinct[0]) if len(distinct) else None,
        "last_key": int(distinct[-1]) if len(distinct) else None,
        "n_null": n_null,
        "n_docs": len(docs),
        "n_ids": int(places[-1]),
        "width": width,
        "level_bits": index.bits.tobytes(),
        "level_sizes": index.sizes.tobytes(),
        "ranks": index.ranks.tobytes(),
        "fingerprints": _prints(distinct[by_slot].view(np.uint64)).astype("<u4").tobytes(),
        "firsts": (firsts[by_slot] + n_null).astype("<u4").tobytes(),
        "runs": runs[by_slot].astype("<u4").tobytes(),
        "keys": distinct.astype("<i8").tobytes(),
        "places": places.tobytes(),
        "ids": b"".join(docs),
    }


def write_shards(
    docs: DataFrame, tokenizer: str, path: str, shard_ids: int = SHARD_IDS
) -> None:
    """Encode every document and write the shards, ascending by ``doc_id``, to ``path``.

    Each shard holds about ``shard_ids`` ids and at least one whole document. ``part`` and
    ``shard`` number the shards in the order of their documents.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARD))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, docs, size = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [_shard(part, shard, keys, docs, enc.width)], schema
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                found = enc.encode(some["text"].to_pylist())
                for key, ids in zip(some["doc_id"].to_pylist(), found):
                    keys.append(key)
                    docs.append(ids)
                    size += len(ids) // enc.width
                    if size >= shard_ids:
                        yield row()
                        keys, docs, size, shard = [], [], 0, shard + 1
        if docs:
            yield row()

    (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(encode, SHARD)
        .write.option("compression", "none")
        .parquet(path)
    )


def _lookup(keys: list[int] | None):
    """Reads shards: the documents of the keys, or of all the shard's own keys if None."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                index = PerfectHash(
                    *(
                        np.frombuffer(s[c], t)
                        for c, t in (("level_bits", "<u8"), ("level_sizes", "<u4"), ("ranks", "<u4"))
                    )
                )
                prints, firsts, runs = (
                    np.frombuffer(s[c], "<u4") for c in ("fingerprints", "firsts", "runs")
                )
                asked = np.frombuffer(s["keys"], "<i8") if keys is None else np.array(keys, "<i8")
                slots = index.slots(asked)
                known = slots >= 0
                known[known] = prints[slots[known]] == _prints(asked[known].view(np.uint64))
                asked, slots = asked[known], slots[known]
                run = runs[slots].astype(np.int64)
                ids_of = np.repeat(asked, run).tolist()
                nth = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
                at = np.repeat(firsts[slots].astype(np.int64), run) + nth
                if keys is None:
                    ids_of = [None] * s["n_null"] + ids_of
                    at = np.concatenate([np.arange(s["n_null"]), at])
                places = np.frombuffer(s["places"], "<i8")
                low, high = places[at], places[at + 1]
                ids = np.frombuffer(s["ids"], f"<u{s['width']}").astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(low.tolist(), high.tolist())]
                n = len(ids_of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["part"]] * n, pa.int32()),
                        pa.array([s["shard"]] * n, pa.int32()),
                        pa.array(ids_of, pa.int64()),
                        pa.array(low, pa.int64()),
                        pa.array(high - low, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    return find


def read_documents(
    spark: SparkSession, path: str, keys: list[int] | None = None
) -> DataFrame:
    """Documents of the shards through their indexes: all of them, or those of a list of keys.

    With keys, the bounds of the shards are compared in the scan, so only row groups that can
    hold one of them are read. ``start`` counts the ids of all documents before it.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sum_before(
        sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")), "part", "ids", "before"
    )
    inner = "sum(n_ids) over (partition by part order by shard) - n_ids"
    starts = sizes.join(parts, "part").select(
        "part", "shard", (F.expr(inner) + F.col("before")).alias("base")
    )
    if keys is not None:
        asked = F.lit(False)
        for k in keys:
            asked = asked | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
        shards = shards.filter(asked)
    return (
        shards.mapInArrow(_lookup(keys), FOUND)
        .join(starts, ["part", "shard"])
        .select(
            "doc_id",
            (F.col("base") + F.col("place")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
