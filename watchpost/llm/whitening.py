"""Whitened embeddings: the leading eigenvectors of the covariance by Jacobi-Davidson.

The vectors are laid out once as blocks of whole numbers in the shared folder. The covariance is
never formed: a product with a few directions is one pass over the blocks, each task centring its
rows and adding up its share, and the shares are summed by Spark before they reach the driver,
which holds a search space of at most ``MAX_BASIS`` directions and nothing else.

Contract for odd input. A vector that is null, empty, or holds a null or non-finite entry is left
out. Vectors of several lengths: the commonest length is kept (the longer one in a tie), as a
covariance has one. Null and repeated ids stay, a row each. No vectors, or vectors that are all
equal, give no components and so no rows; a component whose variance is rounding error is no
component either, so there may be fewer than asked for. ``deviation`` is null where it exceeds a
long. Entries whose whole number exceeds 2**62 count as 2**62. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: directions of the search space before it is cut back, in multiples of the components
MAX_BASIS = 6
#: MINRES steps for each correction; one pass over the blocks each
INNER = 4
OUTER = 400
EPS = float(np.finfo(float).eps)
LIMIT = 2.0**62
#: entries of a block, 32 MB at eight bytes
BLOCK_ENTRIES = 4_000_000


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the usable vectors, their lengths, and all their entries as whole numbers."""
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    vectors = vectors.take(pa.array(at))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    faults = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ends = np.cumsum(lengths)
    good = (lengths > 0) & (faults[ends] == faults[ends - lengths])
    kept = entries[np.repeat(good, lengths)]
    whole = np.clip(np.floor(kept * SCALE) + SHIFT, -LIMIT, LIMIT).astype(np.int64)
    return at[good], lengths[good], whole


def lay_out(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Blocks of (dim, ids, width, x) of the commonest length, and that length (0: no vectors)."""
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = chosen.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, whole = whole_numbers(batch.column("vector"))
            ids, starts = batch.column("id"), np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                step = max(1, BLOCK_ENTRIES // dim)
                for low in range(0, len(rows), step):
                    part = rows[low : low + step]
                    x = whole[starts[part, None] + np.arange(dim)]
                    narrow = np.abs(x).max() < 2**31
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([dim], pa.int32()),
                            "rows": pa.array([len(part)], pa.int64()),
                            "ids": pa.array([ids.take(pa.array(at[part]))], pa.list_(ids.type)),
                            "width": pa.array([4 if narrow else 8], pa.int32()),
                            "x": pa.array([x.astype("<i4" if narrow else "<i8").tobytes()], pa.binary()),
                        }
                    )

    packed = stored(
        chosen.mapInArrow(pack, f"dim int, rows bigint, ids array<{kind}>, width int, x binary"),
        "vector-blocks",
    )
    commonest = (
        packed.groupBy("dim")
        .agg(F.sum("rows").alias("n"))
        .orderBy(F.desc("n"), F.desc("dim"))
        .first()
    )
    dim = commonest["dim"] if commonest else 0
    return packed.filter(F.col("dim") == dim), dim


def matrices(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """The blocks of a batch as whole-number matrices."""
    for width, x in zip(batch.column("width").to_pylist(), batch.column("x")):
        yield np.frombuffer(x.as_buffer(), f"<i{width}").reshape(-1, dim)


class Vectors:
    """Distributed sums over the fit list: its size, its sums, and centred products."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim, self.passes = blocks, dim, 0
        self.n = blocks.agg(F.sum("rows")).first()[0] or 0
        if not self.n:
            return

        def sums(batches):
            total = None
            for batch in batches:
                for x in matrices(batch, dim):
                    # halves keep the sums of any whole numbers exact
                    x = x.astype(np.int64)
                    part = np.stack([x >> 32, x & 0xFFFFFFFF]).sum(1)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict(
                    {"i": np.arange(dim), "high": total[0], "low": total[1]}
                )

        summed = (
            blocks.select("width", "x")
            .mapInArrow(sums, "i long, high long, low long")
            .groupBy("i")
            .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
            .collect()
        )
        exact = {r["i"]: (r["high"] << 32) + r["low"] for r in summed}
        self.sums = [exact[i] for i in range(dim)]
        quotients = [divmod(s, self.n) for s in self.sums]
        self.floor = np.array([q for q, _ in quotients], np.int64)
        self.rest = np.array([r for _, r in quotients], np.int64)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        floor, part = self.floor, self.rest / self.n
        return lambda x: (x.astype(np.int64) - floor) - part

    def total(self, share: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of ``share(centred block)``, a vector of ``size`` numbers."""
        centre, dim = self.centre(), self.dim
        self.passes += 1

        def add_up(batches):
            sums = np.zeros(size)
            for batch in batches:
                for x in matrices(batch, dim):
                    sums += share(centre(x))
            yield pa.RecordBatch.from_pydict({"i": np.arange(size), "v": sums})

        rows = (
            self.blocks.select("width", "x")
            .mapInArrow(add_up, "i long, v double")
            .groupBy("i")
            .agg(F.sum("v").alias("v"))
            .toArrow()
        )
        out = np.zeros(size)
        out[rows["i"].to_numpy()] = rows["v"].to_numpy()
        return out

    def product(self, directions: np.ndarray) -> np.ndarray:
        """The covariance times some directions, in one pass."""
        shape = directions.shape

        def share(c):
            return (c.T @ (c @ directions)).ravel()

        return self.total(share, directions.size).reshape(shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c: np.array([np.einsum("ij,ij->", c, c)]), 1)[0] / self.n)


def corrections(product, ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int):
    """Approximate solutions t of (I-UU')(V-theta)(I-UU') t = -r, a column for each residual.

    MINRES for all columns in step, so that a step is one pass: Lanczos directions of the
    projected operator, then the combination of least residual over the tridiagonal matrix.
    """

    def off(x):
        return x - ritz @ (ritz.T @ x)

    right = -off(residuals)
    norms = np.linalg.norm(right, axis=0)
    count = right.shape[1]
    tri = np.zeros((count, steps + 1, steps))
    basis, before, beta = [right / norms], 0.0, np.zeros(count)
    for j in range(steps):
        w = off(product(basis[j]) - basis[j] * values) - before * beta
        alpha = (basis[j] * w).sum(0)
        w = w - basis[j] * alpha
        for v in basis:  # what rounding left of the earlier directions
            w = w - v * (v * w).sum(0)
        beta, before = np.linalg.norm(w, axis=0), basis[j]
        tri[:, j, j], tri[:, j + 1, j] = alpha, beta
        if j + 1 < steps:
            tri[:, j, j + 1] = beta
        basis.append(w / np.where(beta > 0, beta, 1))
    out = np.zeros_like(right)
    for c in range(count):
        target = np.zeros(steps + 1)
        target[0] = norms[c]
        weights = np.linalg.lstsq(tri[c], target, rcond=None)[0]
        out[:, c] = sum(v[:, c] * a for v, a in zip(basis, weights))
    return out


def new_directions(basis: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``found`` outside ``basis``."""
    found = found / np.linalg.norm(found, axis=0)
    for _ in range(3):
        found = found - basis @ (basis.T @ found)
        left, sizes, _ = np.linalg.svd(found, full_matrices=False)
        found = left[:, sizes > 1e-8]
    return found[:, : basis.shape[0] - basis.shape[1]]


def leading_eigenvectors(product, dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, and unit eigenvectors.

    Rayleigh-Ritz over a search space; a Ritz pair whose residual is down to rounding error is
    locked: it stays in the space and is corrected no more. The rest extend the space by their
    corrections. At the end the residuals are taken anew from one more product.
    """
    wanted = min(wanted, dim)
    start = np.random.default_rng(seed).standard_normal((dim, min(dim, 2 * wanted)))
    space = np.linalg.qr(start)[0]
    image = product(space)
    for _ in range(OUTER):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, theta = space @ turn[:, :wanted], values[:wanted]
        residuals = image @ turn[:, :wanted] - ritz * theta
        bound = max(dim, 64) * EPS * max(abs(values[0]), np.finfo(float).tiny)
        open_ = np.flatnonzero(np.linalg.norm(residuals, axis=0) > bound)
        if not len(open_) or space.shape[1] == dim:
            ritz = np.linalg.qr(ritz)[0]
            anew = product(ritz)
            theta = (ritz * anew).sum(0)
            worst = np.linalg.norm(anew - ritz * theta, axis=0).max()
            if worst <= 4 * bound or space.shape[1] == dim:
                order = np.argsort(-theta, kind="stable")
                ritz, theta = ritz[:, order], theta[order]
                peak = ritz[np.abs(ritz).argmax(0), np.arange(wanted)]
                return theta, ritz * np.where(peak < 0, -1.0, 1.0)
            # the images have drifted: take them anew
            space = np.linalg.qr(space @ turn)[0]
            image = product(space)
            continue
        found = corrections(product, ritz, theta[open_], residuals[:, open_], INNER)
        if space.shape[1] + len(open_) > max(MAX_BASIS * wanted, 2 * wanted + len(open_)):
            space, image = space @ turn[:, : 2 * wanted], image @ turn[:, : 2 * wanted]
        extra = new_directions(space, found)
        if not extra.shape[1]:
            extra = new_directions(space, residuals[:, open_])
        space = np.hstack([space, extra])
        image = np.hstack([image, product(extra)])
    raise RuntimeError(f"residuals are above rounding error after {OUTER} rounds")


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row for each usable vector and component: its whitened coordinate and what explains it.

    The vectors are read once; the covariance is that of the numbers floor(1024 * c) + 100000.
    """
    blocks, dim = lay_out(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"{id_col} {kind}, component int, n long, deviation long, whitened double,"
        " explained double, identity_error double"
    )
    data = Vectors(blocks, dim)
    values = np.zeros(0)
    if data.n:
        values, axes = leading_eigenvectors(data.product, dim, components)
        real = values > 16 * max(dim, 64) * EPS * values[0] if values[0] > 0 else values > 0
        values, axes = values[real], axes[:, real]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    explained = values / data.trace()
    turn = axes / np.sqrt(values)
    count = len(values)
    mean = data.total(lambda c: (c @ turn).sum(0), count) / data.n

    def spread(c):
        w = c @ turn - mean
        return (w.T @ w).ravel()

    identity = data.total(spread, count * count).reshape(count, count) / data.n
    error = float(np.abs(identity - np.eye(count)).max())
    centre, n, floor, rest = data.centre(), data.n, data.floor, data.rest
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            for ids, x in zip(batch.column("ids"), matrices(batch, dim)):
                step = max(1, BLOCK_ENTRIES // (16 * max(dim, count)))
                for low in range(0, len(x), step):
                    part = x[low : low + step]
                    size = len(part)
                    whitened = centre(part) @ turn
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.values.slice(low, size).take(
                                pa.array(np.repeat(np.arange(size), count))
                            ),
                            pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                            pa.array(np.full(size * count, n, np.int64)),
                            exact_deviations(part, n, floor, rest).take(
                                pa.array(np.repeat(np.arange(size), count))
                            ),
                            pa.array(whitened.ravel()),
                            pa.array(np.tile(explained, size)),
                            pa.array(np.full(size * count, error)),
                        ],
                        names=names,
                    )

    return blocks.select("ids", "width", "x").mapInArrow(rows, schema)


def exact_deviations(x: np.ndarray, n: int, floor: np.ndarray, rest: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n*x-S)**2 of each row, exact; null beyond a long."""
    moved = x.astype(np.int64) - floor
    rough = moved.astype(float) * n - rest
    if (rough**2).sum(1).max() < LIMIT:
        away = moved * n - rest
        return pa.array((away * away).sum(1))
    away = moved.astype(object) * n - rest.astype(object)
    return pa.array([t if t < 2**63 else None for t in (away * away).sum(1)], pa.int64())
