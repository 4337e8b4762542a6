"""Pitman-Yor restaurants in numpy: seating by Gibbs sampling and predictive probabilities.

``ByteTree`` is a hierarchy of restaurants over byte strings: one for each context of up to
``ORDER`` bytes, whose parent is the context without its first byte; the tables of a restaurant are
the customers of its parent.
"""

from __future__ import annotations

import numpy as np

ORDER = 4
#: discount and strength of the restaurants by length of context, fixed parameters
DISCOUNTS = (0.1, 0.3, 0.5, 0.6, 0.7)
STRENGTH = 1.0
END = 0x0A
SYMBOLS = 256


def seat(
    customers: np.ndarray,
    fresh: np.ndarray,
    discount: float,
    rng: np.random.Generator,
    grow: np.ndarray | float = 0.0,
) -> np.ndarray:
    """Tables that each dish gets when all its customers are seated anew, one after another.

    A customer opens a table with weight ``fresh`` (strength and other tables times the parent's
    probability, plus ``grow`` for each own table) against customers so far less the discounts of
    the tables. After the first 32 they come in batches of a sixteenth of those seated, whose
    tables are drawn at once, so that the work grows with the logarithm of a count.
    """
    tables = (customers > 0).astype(np.int64)
    grow = np.broadcast_to(grow, customers.shape)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        n, t = customers[live], tables[live]
        batch = np.minimum(max(1, seated // 16), n - seated) if seated >= 32 else 1
        opens = fresh[live] + grow[live] * t
        share = opens / (opens + np.maximum(seated - discount * t, 1e-9))
        tables[live] = t + rng.binomial(batch, np.clip(share, 0, 1))
        seated += max(1, seated // 16) if seated >= 32 else 1
        live = live[n > seated]
    return tables


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each row's place among them, and the sums of values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at, np.bincount(at, values, len(distinct))


class Level:
    """All restaurants of one context length: dishes (context, byte), customers and tables."""

    def __init__(self, keys: np.ndarray, discount: float):
        self.keys, self.discount = keys, discount
        self.contexts, self.house = np.unique(keys >> 8, return_inverse=True)
        self.customers = np.zeros(len(keys), np.int64)
        self.tables = np.ones(len(keys), np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.contexts)
        return (
            np.bincount(self.house, self.customers, k),
            np.bincount(self.house, self.tables, k),
        )

    def back_off(self) -> np.ndarray:
        """For each restaurant, the weight of its parent."""
        customers, tables = self.totals()
        return (STRENGTH + self.discount * tables) / (STRENGTH + customers)

    def predict(self, parent: np.ndarray) -> np.ndarray:
        customers, _ = self.totals()
        own = np.maximum(self.customers - self.discount * self.tables, 0)
        return own / (STRENGTH + customers[self.house]) + self.back_off()[self.house] * parent

    def resample(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        _, tables = self.totals()
        others = tables[self.house] - self.tables
        fresh = (STRENGTH + self.discount * others) * parent
        self.tables = seat(self.customers, fresh, self.discount, rng, self.discount * parent)


class ByteTree:
    """Restaurants with contexts of ``low`` to ``high`` bytes over the given longest grams.

    A gram packs its context and its byte into an integer, the byte lowest; ``mask`` bytes of
    a context name its ancestors.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, high: int, low: int):
        self.levels, self.up = {}, {}
        keys = grams
        for k in range(high, low - 1, -1):
            level = Level(keys, DISCOUNTS[k])
            self.levels[k] = level
            shorter = keys & ((1 << 8 * k) - 1)
            keys, at, _ = _sums(shorter, np.ones(len(shorter)))
            self.up[k] = at
        self.high, self.low = high, low
        self.levels[high].customers = counts.astype(np.int64)
        self.parent_keys = keys
        for k in range(high - 1, low - 1, -1):
            self._hand_up(k + 1)

    def _hand_up(self, k: int) -> None:
        """The tables of level k are the customers of the level above it."""
        above = self.levels[k - 1]
        above.customers = np.bincount(
            self.up[k], self.levels[k].tables, len(above.keys)
        ).astype(np.int64)
        above.tables = np.clip(above.tables, 1, np.maximum(above.customers, 1))

    def predictions(self, parent: np.ndarray) -> dict[int, np.ndarray]:
        """Per level the probabilities of its dishes; ``parent`` those of ``parent_keys``."""
        out, above = {}, parent
        for k in range(self.low, self.high + 1):
            out[k] = self.levels[k].predict(above[self.up[k]])
            above = out[k]
        return out

    def sweep(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """Seat all dishes anew, longest contexts first."""
        before = self.predictions(parent)
        for k in range(self.high, self.low - 1, -1):
            above = before[k - 1] if k > self.low else parent
            self.levels[k].resample(above[self.up[k]], rng)
            if k > self.low:
                self._hand_up(k)

    def upward(self) -> np.ndarray:
        """Tables of the shortest level, summed over ``parent_keys``."""
        tables = self.levels[self.low].tables
        return np.bincount(self.up[self.low], tables, len(self.parent_keys)).astype(np.int64)


def byte_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word number): every byte of every word and its end, after ``ORDER`` bytes."""
    data = np.frombuffer(b"".join([b"\0" * ORDER + w + bytes([END]) for w in words]), np.uint8)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes + ORDER) - sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.repeat(starts, sizes) + at
    key = np.zeros(len(places), np.int64)
    for back in range(ORDER, -1, -1):
        key = (key << 8) | data[places - back]
    return key, owner


class SpellingModel:
    """Predictive probabilities of bytes, ready for lookup, for the contexts of one block."""

    def __init__(self, top: np.ndarray, rows: dict[int, tuple[np.ndarray, ...]]):
        #: (previous byte, byte) probabilities, dense
        self.top = top
        #: level -> (grams, probabilities, contexts, back-off weights), each sorted
        self.rows = rows

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms for full grams."""
        keys, back = np.unique(keys, return_inverse=True)
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for k in sorted(self.rows, reverse=True):
            grams, probabilities, contexts, weights = self.rows[k]
            own = keys[todo] & ((1 << 8 * (k + 1)) - 1)
            at, hit = self._find(grams, own)
            out[todo[hit]] += np.log(probabilities[at[hit]])
            todo, own = todo[~hit], own[~hit]
            at, hit = self._find(contexts, own >> 8)
            out[todo[hit]] += np.log(weights[at[hit]])
        pair = keys[todo] & 0xFFFF
        out[todo] += np.log(self.top[pair >> 8, pair & 0xFF])
        return out[back]
