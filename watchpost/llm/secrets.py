"""Secrets in whole texts: three plain patterns and windows of high entropy.

Everything is SQL functions, one row in and one row out, with no exchange. Matches are bracketed
by two noncharacters and the places read off the pieces between them, so that places are code
points. Noncharacters of that kind in a text are first replaced one for one, which moves nothing
and touches no character that a pattern can match. No pattern repeats a group that has to be
remembered, so that a run of any length is matched without recursion.

Entropy: a candidate is a run of key characters with a letter and a digit. A window slides over
it; the counts of its characters, a string with one character for each, and the sum of n*log2(n),
a whole number at a fixed scale, change by the one character that enters and the one that leaves,
and give the Shannon entropy of each window. Hexadecimal runs and mixed ones have thresholds of
their own. The span runs from the first window at the threshold to the end of the last. Runs on
the allow-list are left out; what plain matches cover is cut off a span, and what is left of it
counts from ``PIECE`` characters on.

Cases: a null text is an empty one. Rows are judged on their own, so repeated rows and null or
equal ids give a row each. Work grows with the length of a text; lists of matches are put together
in blocks, as appending to one long list would copy it every time. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .sequences import bound as _bound, walk as _walk

# fixed values: the patterns of the three plain kinds, in the order of the report
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

KEY = "[A-Za-z0-9+/_=-]"
CANDIDATE = (
    rf"(?<!{KEY})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){KEY}{{24,}}"
)
WINDOW = 24
#: bits a character in a window, by class of characters
HEX_BITS, MIXED_BITS = 3.0, 3.75
#: runs that look random and are no secrets: UUIDs, dates and times, paths of plain words
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_]?[0-9Z+-]*$",
    r"^/?(?:[A-Za-z]++[/_-])++[A-Za-z0-9]{0,12}$",
)
#: characters of a cut span that still count
PIECE = 8
#: the sum of n*log2(n) is kept as whole multiples of one part in this
SCALE = 1 << 32

_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct(start, found)> of the leftmost non-overlapping matches."""
    kind = "struct<start:bigint,found:string>"
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        found = F.substring_index(part, _CLOSE, 1)
        return (
            (at + F.length(part) - 1).cast("bigint"),
            F.array(F.struct(at.alias("start"), found.alias("found"))),
        )

    def places(parts: Column) -> Column:
        first = F.length(F.get(parts, F.lit(0))).cast("bigint")
        return _bound(
            F.slice(parts, F.lit(2), F.size(parts)), lambda rest: _walk(rest, first, kind, step)["out"]
        )

    none = F.expr(f"cast(array() as array<{kind}>)")
    return F.when(text.rlike(pattern), _bound(F.split(marked, _OPEN), places)).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(kind).alias("kind"),
            (m["start"] + F.length(m["found"])).alias("end"),
        ),
    )


def _hot_range(found: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """struct(low, high): from the first window at its threshold to the end of the last."""
    weight = [round(n * math.log2(n) * SCALE) if n else 0 for n in range(window + 2)]
    up = F.array(*[F.lit(b - a) for a, b in zip(weight, weight[1:])])

    def most(bits: float) -> Column:
        # rounding of the weights must not cost a window exactly at the threshold
        return F.lit(int((math.log2(window) - bits) * window * SCALE) + window)

    limit = F.when(found.rlike("^[0-9a-fA-F]+$"), most(hex_bits)).otherwise(most(mixed_bits))

    def count(state: Column, c: Column) -> Column:
        return F.ascii(F.substring(state["counts"], F.ascii(c) + 1, F.lit(1)))

    def put(counts: Column, c: Column, n: Column) -> Column:
        return F.overlay(counts, F.chr(n), F.ascii(c) + 1, F.lit(1))

    def judged(state: Column, low: str, high: str) -> list[Column]:
        """The bounds after the window that ends at the last character read."""
        hot = (state["i"] >= window) & (state["total"] <= state["limit"])
        return [
            F.when(hot & (state[low] < 0), state["i"] - window).otherwise(state[low]).alias(low),
            F.when(hot, state["i"]).otherwise(state[high]).alias(high),
        ]

    def step(state: Column, c: Column) -> Column:
        leaves = F.substring(state["ring"], 1, 1)
        full, same = state["i"] >= window, leaves == c

        def changed(n: Column) -> Column:
            come, gone = n["come"], n["gone"]
            total = (
                F.when(full & same, state["total"])
                .when(full, state["total"] + F.get(up, come) - F.get(up, gone - 1))
                .otherwise(state["total"] + F.get(up, come))
            )
            entered = put(state["counts"], c, come + 1)
            counts = (
                F.when(full & same, state["counts"])
                .when(full, put(entered, leaves, gone - 1))
                .otherwise(entered)
            )
            kept = F.when(full, F.substring(state["ring"], 2, window)).otherwise(state["ring"])
            return F.struct(
                (state["i"] + 1).alias("i"),
                F.concat(kept, c).alias("ring"),
                counts.alias("counts"),
                total.alias("total"),
                state["limit"].alias("limit"),
                *judged(state, "low", "high"),
            )

        return _bound(
            F.struct(count(state, c).alias("come"), count(state, leaves).alias("gone")), changed
        )

    start = F.struct(
        F.lit(0).alias("i"),
        F.lit("").alias("ring"),
        F.repeat(F.chr(F.lit(0)), F.lit(128)).alias("counts"),
        F.lit(0).cast("bigint").alias("total"),
        limit.cast("bigint").alias("limit"),
        F.lit(-1).alias("low"),
        F.lit(-1).alias("high"),
    )
    return F.aggregate(
        F.split(found, ""), start, step, lambda s: F.struct(*judged(s, "low", "high"))
    )


def _uncovered(base: Column, added: Column) -> Column:
    """The spans ``added``, which are disjoint, without what spans of ``base`` cover."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def piece(start: Column, end: Column) -> Column:
        return F.when(
            end - start >= PIECE,
            F.array(F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end"))),
        ).otherwise(none)

    def state(low: Column, high: Column, covered: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), covered.alias("covered"))

    def step(now: Column, span: Column) -> tuple[Column, Column]:
        """[low, high) is what is left of the last span of ``added``."""
        plain, none_left = span["kind"] < 3, F.lit(-1).cast("bigint")
        covered = F.greatest(now["covered"], span["end"])
        inside = plain & (span["start"] < now["high"])
        after = (
            F.when(inside, state(F.greatest(span["end"], now["low"]), now["high"], covered))
            .when(plain, state(none_left, none_left, covered))
            .otherwise(state(F.greatest(span["start"], now["covered"]), span["end"], now["covered"]))
        )
        return after, piece(now["low"], F.when(inside, span["start"]).otherwise(now["high"]))

    empty = state(*(F.lit(-1).cast("bigint") for _ in range(3)))
    return _bound(
        F.array_sort(F.concat(base, added)),
        lambda spans: _bound(
            _walk(spans, empty, _SPAN, step),
            lambda w: F.concat(w["out"], piece(w["state"]["low"], w["state"]["high"])),
        ),
    )


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def find_secrets(
    docs: DataFrame,
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    mixed_bits: float = MIXED_BITS,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """Per row: doc_id, ``base`` and ``added``, sorted arrays of (start, kind, end).

    ``kind`` is a place in ``KINDS``; places are code points, the end exclusive.
    """
    clean = F.translate(F.coalesce("text", F.lit("")), _OPEN + _CLOSE, "\ufffd\ufffd")
    found = docs.select("doc_id", clean.alias("_text")).select(
        "doc_id",
        _matches(F.col("_text"), ASSIGN).alias("_assign"),
        _matches(F.col("_text"), ACCESS).alias("_access"),
        _matches(F.col("_text"), HEX).alias("_hex"),
        _matches(F.col("_text"), CANDIDATE).alias("_runs"),
    )
    value = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
    base = F.array_sort(
        F.concat(
            _spans(
                F.filter(
                    "_assign", lambda m: F.length(F.regexp_extract(m["found"], value, 1)) >= 8
                ),
                0,
            ),
            _spans(F.filter("_access", lambda m: F.length(m["found"]) >= 16), 1),
            _spans(F.col("_hex"), 2),
        )
    )

    def suspicious(m: Column) -> Column:
        keep = F.lit(True)
        for pattern in allowed:
            keep = keep & ~m["found"].rlike(pattern)
        return keep

    hot = F.transform(
        F.filter("_runs", suspicious),
        lambda m: F.struct(
            m["start"].alias("start"),
            _hot_range(m["found"], window, hex_bits, mixed_bits).alias("hot"),
        ),
    )
    added = F.transform(
        F.filter("_hot", lambda h: h["hot"]["high"] > 0),
        lambda h: F.struct(
            (h["start"] + h["hot"]["low"]).alias("start"),
            F.lit(3).alias("kind"),
            (h["start"] + h["hot"]["high"]).alias("end"),
        ),
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return (
        found.select("doc_id", base.alias("base"), "_runs")
        .select("doc_id", "base", F.when(F.size("_runs") > 0, hot).alias("_hot"))
        .select("doc_id", "base", F.coalesce(added, none).alias("_added"))
        .select(
            "doc_id",
            "base",
            F.when(F.size("_added") > 0, _uncovered(F.col("base"), F.col("_added")))
            .otherwise(none)
            .alias("added"),
        )
    )


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the plain spans, and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_entropy"),
    )
