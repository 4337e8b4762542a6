"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of a word embedding (by hash; zero until trained) and the mean of its
character-trigram embeddings. A word of more than ``CHARS`` bytes is read as pieces of that size
that overlap by half, each in the place of a word, so a text without spaces is read whole. Windows of ``WINDOW`` words that overlap by half cover the whole
text. In each, a gated recurrent unit runs in both directions, attention weighs its states, and a
logistic unit scores the pooled state. A text's logit is its highest window's, put on a probability
scale by a logistic fit over the training texts at the labels' own proportions.

Training is numpy on the driver with at most ``SAMPLE`` labelled texts of each class, those with
the smallest hash of their id: a bounded sample to fit on. Which window of a toxic text is toxic is
not known, so after a first round on random windows each text trains by its highest one. Scoring
covers every window of every text, on the executors.

Cases: null, empty and blank texts have no window and get the score of the lowest logit seen in
training. Texts are scored row by row, so repeated rows and null or equal ids give a row each. A
document with a null id is held out and never trained on. Without labels of both classes every score
is the share of label 1 (0 without any). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import SPACED, Words, mix

WINDOW, STRIDE = 64, 32
SAMPLE = 1500
WORD_SLOTS, CHAR_SLOTS, WIDTH, STATES = 1 << 16, 1 << 13, 8, 8
CHARS, PIECE_STRIDE = 16, 8
ROUNDS, BATCH, RATE, SEED = 4, 128, 0.02, 7
FOLDS = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Pieces(Words):
    """Words, the longer ones cut into overlapping pieces of ``CHARS`` bytes."""

    def _hash(self) -> np.ndarray:
        length = self.stops - self.starts
        pieces = 1 - np.minimum(CHARS - length, 0) // PIECE_STRIDE
        before = np.concatenate([[0], np.cumsum(pieces)])
        owner = np.repeat(np.arange(len(length)), pieces)
        step = (np.arange(before[-1]) - before[owner]) * PIECE_STRIDE
        # the last piece ends with the word
        step = np.minimum(step, np.maximum(length - CHARS, 0)[owner])
        self.starts = self.starts[owner] + step
        self.stops = np.minimum(self.starts + CHARS, self.stops[owner])
        self.ends = before[self.ends]
        return super()._hash()


class Inputs:
    """Distinct words and pieces of some texts, their slots, and the windows over them.

    ``windows`` holds places in the list of distinct words, -1 for padding; ``owner`` the text of
    each window.
    """

    def __init__(self, texts: list[str | None]):
        w = Pieces(texts, SPACED)
        _, first, at = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.words = (w.hashes[first] % np.uint64(WORD_SLOTS)).astype(np.int64)
        self.chars, self.n_chars = self._trigrams(w, first)
        starts, owner, low = [], [], 0
        sizes = []
        for text, high in enumerate(w.ends.tolist()):
            n = high - low
            if n:
                own = list(range(low, max(high - WINDOW, low) + 1, STRIDE))
                if n > WINDOW and own[-1] != high - WINDOW:
                    own.append(high - WINDOW)
                starts += own
                owner += [text] * len(own)
                sizes += [min(n, WINDOW)] * len(own)
            low = high
        step = np.arange(WINDOW)
        places = np.array(starts, np.int64)[:, None] + step
        padded = step >= np.array(sizes, np.int64)[:, None]
        if starts:
            places = np.minimum(places, len(at) - 1)
            self.windows = np.where(padded, -1, at.astype(np.int32)[places])
        else:
            self.windows = np.zeros((0, WINDOW), np.int64)
        self.owner = np.array(owner, np.int64)

    @staticmethod
    def _trigrams(w: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = w.stops[first] - w.starts[first]
        at = np.arange(CHARS)
        out = np.empty((len(first), CHARS), np.int32)
        # some words at a time, as the arrays in between are many and wide
        for low in range(0, len(first), 8192):
            part = slice(low, low + 8192)
            inside = at < size[part, None]
            # the texts are followed by a line end, so a place one off a word exists or is clipped
            places = np.minimum(w.starts[first[part]][:, None] + at, len(w.data) - 1)
            letters = np.where(inside, w.data[places], 0).astype(np.uint64)
            before = np.pad(letters, ((0, 0), (1, 0)))[:, :-1]
            after = np.pad(letters, ((0, 0), (0, 1)))[:, 1:]
            key = mix((before << np.uint64(16)) | (letters << np.uint64(8)) | after)
            slots = (key % np.uint64(CHAR_SLOTS - 1)).astype(np.int32) + 1
            out[part] = np.where(inside, slots, 0)
        return out, np.maximum(size, 1)


class Network:
    """The parameters, the forward pass and its gradients; slot 0 of the trigrams stays zero."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": np.zeros((WORD_SLOTS, WIDTH), np.float32),
            "char": draw(CHAR_SLOTS, WIDTH, scale=0.3),
            "inp": draw(2, WIDTH, 3 * STATES, scale=0.4),
            "bias": np.zeros((2, 1, 3 * STATES), np.float32),
            "rec": draw(2, STATES, 3 * STATES, scale=0.3),
            "att": draw(2 * STATES, scale=0.3),
            "out": draw(2 * STATES, scale=0.5),
            "base": np.zeros(1, np.float32),
        }
        self.p["char"][0] = 0
        self.scale = (1.0, 0.0)
        self.lowest = -10.0

    def word_inputs(self, words, chars, n_chars):
        x = self.p["word"][words]
        # a trigram place at a time keeps the arrays small
        total = np.zeros_like(x)
        for k in range(chars.shape[1]):
            total += self.p["char"][chars[:, k]]
        return x + total / n_chars[:, None].astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs (direction, word, gates) with a last row for padding that keeps the state."""
        gates = x @ self.p["inp"] + self.p["bias"]
        pad = np.zeros((2, 1, 3 * STATES), np.float32)
        pad[:, :, :STATES] = 30
        return np.concatenate([gates, pad], 1)

    def forward(self, gates: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what the gradients need."""
        n, H = len(windows), STATES
        h = np.zeros((2, n, H), np.float32)
        states = np.empty((WINDOW, 2, n, H), np.float32)
        trail = []
        rec = self.p["rec"]
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            g = np.stack([gates[0][windows[:, t]], gates[1][windows[:, back]]])
            a = h @ rec
            zr = _sigmoid(g[:, :, : 2 * H] + a[:, :, : 2 * H])
            z, r = zr[:, :, :H], zr[:, :, H:]
            c = np.tanh(g[:, :, 2 * H :] + r * a[:, :, 2 * H :])
            new = c + z * (h - c)
            if keep:
                trail.append((h, z, r, c, a[:, :, 2 * H :]))
            h = new
            states[t, 0], states[back, 1] = h[0], h[1]
        att, out = self.p["att"], self.p["out"]
        score = states[:, 0] @ att[:H] + states[:, 1] @ att[H:]
        score = np.where(windows.T < 0, -1e9, score)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tdnh->ndh", weight, states).reshape(n, 2 * H)
        logit = pooled @ out + self.p["base"]
        return (logit, (states, trail, weight, pooled)) if keep else logit

    def gradients(self, inputs: Inputs, chosen: np.ndarray, labels: np.ndarray) -> dict:
        """Gradients of the mean log loss; those of embeddings as (slots, values)."""
        H = STATES
        own, windows = np.unique(inputs.windows[chosen], return_inverse=True)
        windows = windows.reshape(len(chosen), WINDOW)
        if own[0] < 0:
            own, windows = own[1:], windows - 1
        words, chars, n_chars = inputs.words[own], inputs.chars[own], inputs.n_chars[own]
        x = self.word_inputs(words, chars, n_chars)
        gates = self.project(x)
        logit, (states, trail, weight, pooled) = self.forward(gates, windows, True)
        d = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        grad = {"out": pooled.T @ d, "base": np.array([d.sum()], np.float32)}
        d_pooled = (d[:, None] * self.p["out"]).reshape(-1, 2, H)
        d_states = weight[:, None, :, None] * d_pooled.transpose(1, 0, 2)[None]
        d_weight = np.einsum("tdnh,ndh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        grad["att"] = np.einsum("tn,tdnh->dh", d_score, states).reshape(-1)
        d_states += d_score[:, None, :, None] * self.p["att"].reshape(2, 1, H)[None]
        rec = self.p["rec"]
        d_rec, d_gates = np.zeros_like(rec), np.zeros_like(gates)
        dh = np.zeros((2, len(chosen), H), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            back = WINDOW - 1 - t
            dh = dh + np.stack([d_states[t, 0], d_states[back, 1]])
            h, z, r, c, a = trail[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * a * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 2)
            da = np.concatenate([dz, dr, dc * r], 2)
            np.add.at(d_gates[0], windows[:, t], dg[0])
            np.add.at(d_gates[1], windows[:, back], dg[1])
            d_rec += h.transpose(0, 2, 1) @ da
            dh = dh * z + da @ rec.transpose(0, 2, 1)
        d_gates = d_gates[:, :-1]
        grad["rec"], grad["bias"] = d_rec, d_gates.sum(1, keepdims=True)
        grad["inp"] = x.T @ d_gates
        dx = (d_gates @ self.p["inp"].transpose(0, 2, 1)).sum(0)
        grad["word"] = (words, dx)
        each = np.repeat(dx / n_chars[:, None], CHARS, 0)
        flat = chars.reshape(-1)
        grad["char"] = (flat[flat > 0], each[flat > 0].astype(np.float32))
        return grad

    def logits(self, inputs: Inputs) -> np.ndarray:
        """Logits of all windows."""
        x = self.word_inputs(inputs.words, inputs.chars, inputs.n_chars)
        gates = self.project(x)
        parts = [
            self.forward(gates, inputs.windows[i : i + 1024])
            for i in range(0, len(inputs.windows), 1024)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def text_logits(self, texts: list[str | None]) -> np.ndarray:
        inputs = Inputs(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, inputs.owner, self.logits(inputs))
        return np.where(np.isfinite(best), best, self.lowest)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        times, plus = self.scale
        return _sigmoid(times * self.text_logits(texts) + plus)


class Adam:
    """Adam steps; embeddings keep their moments but move only where a batch touches them."""

    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, grad: dict) -> None:
        self.t += 1
        rate = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            at = slice(None)
            if isinstance(g, tuple):
                slots, values = g
                at, where = np.unique(slots, return_inverse=True)
                g = np.zeros((len(at), values.shape[1]), np.float32)
                np.add.at(g, where, values)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            p[k][at] -= rate * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = SEED) -> Network:
    """Fit the network; ``weights`` give the texts the proportions of all labelled ones."""
    net, rng = Network(seed), np.random.default_rng(seed)
    inputs = Inputs(texts)
    adam = Adam(net.p, RATE)
    n = len(texts)
    count = np.bincount(inputs.owner, minlength=n)
    first = np.cumsum(count) - count
    able = np.flatnonzero(count)
    order = None
    for turn in range(ROUNDS):
        chosen = first[able] + (rng.random(len(able)) * count[able]).astype(np.int64)
        owners = able
        if turn:
            logit = net.logits(inputs)
            order = np.lexsort((logit, inputs.owner))
            top = order[np.cumsum(count)[able] - 1]
            # toxic texts by their highest window, clean ones by theirs and by a random one
            clean = labels[able] == 0
            chosen = np.concatenate([top, chosen[clean]])
            owners = np.concatenate([able, able[clean]])
        for _ in range(2):
            mixed = rng.permutation(len(chosen))
            for i in range(0, len(mixed), BATCH):
                some = mixed[i : i + BATCH]
                grad = net.gradients(inputs, chosen[some], labels[owners[some]].astype(np.float32))
                adam.step(net.p, grad)
    best = np.full(n, -np.inf)
    np.maximum.at(best, inputs.owner, net.logits(inputs))
    seen = np.isfinite(best)
    net.lowest = float(best[seen].min()) if seen.any() else net.lowest
    net.scale = _logistic_fit(best[seen], labels[seen], weights[seen])
    return net


def _logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(times, plus) of a weighted logistic fit with a light pull towards (1, 0)."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([1.0, 0.0])
    pull = 0.01 * w.sum() / max(len(x), 1)
    for _ in range(50):
        p = _sigmoid(design @ beta)
        g = design.T @ (w * (p - y)) + pull * (beta - [1.0, 0.0])
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + pull * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(curve, g), -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def held_out(folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network from the bounded sample, or the share of label 1 if a class is missing."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return float(bool(sizes.get(1)))
    chosen = None
    for side in (0, 1):
        of_side = known.filter(F.col("toxic") == side)
        part = of_side.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most twice ``sample`` rows are sent out and come back
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .collect()
    )
    y = np.array([r["toxic"] for r in rows])
    if len(set(y.tolist())) < 2:
        return sizes.get(1, 0) / sum(sizes.values())
    weights = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
    return train([r["text"] for r in rows], y, weights)


def _scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, key, score) for each row; ``key`` is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for low, high in _slices(batch["text"]):
                some = batch.slice(low, high - low)
                texts = some["text"].to_pylist()
                found = (
                    net.scores(texts) if isinstance(net, Network) else np.full(len(texts), net)
                )
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["key"], pa.array(found, pa.float64())],
                    names=["doc_id", "key", "score"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(score, "doc_id bigint, key bigint, score double")


def score_toxicity(docs: DataFrame, model: Network | float) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    return _scored(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text, so that arrays stay small."""
    low, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= most:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def drop_toxic(docs: DataFrame, model: Network | float) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    # decided by id and text: the same text has the same score
    toxic = (
        _scored(docs, model)
        .filter("score >= 0.5")
        .select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
        .distinct()
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(
        toxic,
        F.col("_row")["doc_id"].eqNullSafe(F.col("_doc"))
        & (F.xxhash64(F.col("_row")["text"]) == F.col("_key")),
        "left_anti",
    ).select("_row.*")
