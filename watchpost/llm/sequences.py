"""SQL expressions over long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: items of a list that are worked off before they are added to the result
STRETCH = 300


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def walk(
    items: Column,
    state: Column,
    kind: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """struct(state, out): ``step`` gives the next state and an array to append, item after item."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def held(now: Column, out: Column) -> Column:
        return F.struct(now.alias("state"), out.alias("out"))

    def one(so_far: Column, item: Column) -> Column:
        now, more = step(so_far["state"], item)
        return held(now, F.concat(so_far["out"], more))

    def stretch(so_far: Column, k: Column) -> Column:
        part = F.slice(items, k * STRETCH + 1, F.lit(STRETCH))
        worked = F.aggregate(part, held(so_far["state"], none), one)
        return bound(worked, lambda w: held(w["state"], F.concat(so_far["out"], w["out"])))

    last = F.floor((F.size(items) - 1) / STRETCH).cast("int")
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(
        F.expr("cast(array() as array<int>)")
    )
    return F.aggregate(numbers, held(state, none), stretch)
