"""Near-duplicate documents: banded MinHash candidates, odd sketches, and exact confirmation.

1. One pass makes of each text its shingle set's 128-bit name, size and band keys. Documents with
   the same set are one class, so copies cost nothing further.
2. Classes that share a band belong to one candidate group; groups come from links to the smallest
   class of each band, one link for a class and band.
3. Within a group the sets are made again from the texts. MinHash values are folded into odd
   sketches; the number of bits in which two sketches differ estimates high similarities well,
   and pairs far below the threshold are left out. The rest are confirmed on the full sets, the most
   similar first, and pairs that confirmed links already connect need no look. Groups of more than
   ``BLOCK`` classes are cut into blocks, and every pair of blocks is a task of its own. What
   comes out is a spanning forest of confirmed links, at most one link for a class and task.
4. Components of the confirmed links give the result.

The bands follow from the threshold. With eight values in each of 48 bands, a pair at 0.85 shares
no band with a probability of 2.4e-7, and with six in each of 64 a pair at 0.80 with 3.6e-9. The
sketch estimate has a standard deviation of 0.02 at 0.85 and is cut at 0.74, and at 0.68 for 0.80.

Cases: null, empty and blank texts have an empty set and are linked with nothing. Repeated rows are
one class. A null ``doc_id`` counts only where a component has no other id. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import components
from .shingles import (
    band_keys,
    bands_for,
    estimated_similarity,
    minhashes,
    odd_sketch,
    set_key,
    shingle_sets,
)

PERCENT = 85
SKETCH_MARGIN = 0.11
BLOCK = 800


def sketch_margin(percent: int) -> float:
    """As many standard deviations of the estimate as ``SKETCH_MARGIN`` is at ``PERCENT``."""
    return SKETCH_MARGIN * math.sqrt(percent * (100 - percent) / (PERCENT * (100 - PERCENT)))


def _features(n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                some = batch.slice(i, 128)
                sets = shingle_sets(some["text"].to_pylist())
                bands = [band_keys(minhashes(s), n_bands) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        some["doc_id"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set", "bands"],
                )

    return run


FEATURES = "doc_id bigint, n_shingles bigint, set binary, bands array<bigint>"


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(id, label): which classes may be linked. ``id`` is a hash of the set's name.

    Two sets whose hashes agree would only share a group.
    """
    spread = classes.select("id", F.explode("bands").alias("band"))
    shared = (
        spread.groupBy("band")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first <> last")
        .select("band", "first")
    )
    links = (
        spread.join(shared, "band")
        .filter("id <> first")
        .select(F.col("id").alias("a"), F.col("first").alias("b"))
    )
    return components(links)


def _confirm(percent: int, margin: float):
    """Spanning forests of the confirmed links, tile by tile; rows come sorted by tile."""

    def forest(blocks: list[int], names: list[bytes], texts: list[str]) -> list[tuple]:
        sets = [s for i in range(0, len(texts), 128) for s in shingle_sets(texts[i : i + 128])]
        # another row of the same id may have another text
        right = {}
        for k, (s, name) in enumerate(zip(sets, names)):
            if set_key(s) == name:
                right.setdefault(name, k)
        rows = list(right.values())
        if len(rows) < 2:
            return []
        block = np.array([blocks[k] for k in rows])
        sketches = np.stack(
            [np.frombuffer(odd_sketch(minhashes(sets[k])), np.uint64) for k in rows]
        )
        size = np.array([len(sets[k]) for k in rows])
        across = len(np.unique(block)) > 1
        pairs, scores = [], []
        for i in range(len(rows) - 1):
            later = np.arange(i + 1, len(rows))
            # no link where the sizes alone rule it out
            low = np.minimum(size[i], size[later]) * 100
            later = later[low >= percent * np.maximum(size[i], size[later])]
            if across:
                later = later[block[later] != block[i]]
            bits = np.bitwise_count(sketches[later] ^ sketches[i]).sum(1, dtype=np.int64)
            score = estimated_similarity(bits)
            near = score >= percent / 100 - margin
            pairs.append(np.stack([np.full(near.sum(), i), later[near]], 1))
            scores.append(score[near])
        pairs = np.concatenate(pairs)[np.argsort(-np.concatenate(scores), kind="stable")]
        root = list(range(len(rows)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for a, b in pairs.tolist():
            ra, rb = top(a), top(b)
            if ra == rb:
                continue
            x, y = sets[rows[a]], sets[rows[b]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[max(ra, rb)] = min(ra, rb)
                out.append((names[rows[a]], names[rows[b]]))
        return out

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, ([], [], [])
        found: list[tuple] = []
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("label", "low", "high", "block", "set", "text")]
            for label, low, high, *row in zip(*cols):
                if (label, low, high) != tile:
                    found += forest(*held)
                    tile, held = (label, low, high), ([], [], [])
                for values, value in zip(held, row):
                    values.append(value)
        found += forest(*held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())],
            names=["a", "b"],
        )

    return confirm


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    margin: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Per row: doc_id, n_shingles, set (its name), component_id and kept."""
    texts = docs.select("doc_id", "text")
    margin = sketch_margin(percent) if margin is None else margin
    features = stored(
        texts.mapInArrow(_features(bands_for(percent)), FEATURES), "shingle-features"
    )
    classes = stored(
        features.filter("n_shingles > 0")
        .groupBy("set")
        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
        .withColumn("id", F.xxhash64("set")),
        "shingle-classes",
    )
    groups = candidate_groups(classes)
    members = classes.select("set", "doc_id", "id").join(
        groups.withColumnRenamed("node", "id"), "id"
    )
    sizes = members.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    placed = members.join(sizes, "label").withColumn("block", F.expr("pmod(hash(set), blocks)"))
    wanted = placed.select(
        F.col("doc_id").alias("_doc"), "set", "label", "block", "blocks"
    )
    tiles = (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "label",
            F.least("block", "_other").alias("low"),
            F.greatest("block", "_other").alias("high"),
            "block",
            "set",
            "text",
        )
    )
    links = (
        tiles.repartition("label", "low", "high")
        .sortWithinPartitions("label", "low", "high")
        .mapInArrow(_confirm(percent, margin), "a binary, b binary")
    )
    labels = components(links)
    named = classes.select("set", "doc_id").join(
        labels.withColumnRenamed("node", "set"), "set", "left"
    )
    named = named.withColumn("label", F.coalesce("label", "set"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(smallest, "label").select("set", "component_id")
    return (
        features.select("doc_id", "n_shingles", "set")
        .join(by_set, "set", "left")
        .select(
            "doc_id",
            "n_shingles",
            "set",
            F.when(F.col("n_shingles") > 0, F.col("component_id"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The documents that are kept, one row for each id and text."""
    kept = near_duplicates(docs, **params).filter("kept").select(
        F.col("doc_id").alias("_doc")
    ).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return (
        rows.join(kept, F.col("_row")["doc_id"].eqNullSafe(F.col("_doc")), "left_semi")
        .withColumn("_id", F.col("_row")["doc_id"])
        .withColumn("_text", F.xxhash64(F.col("_row")["text"]))
        .dropDuplicates(["_id", "_text"])
        .select("_row.*")
    )
