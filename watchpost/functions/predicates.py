"""Predicates used by several filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def true() -> Column:
    return F.lit(True)


def all_of(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, true()) if preds else true()


def contains_ci(c: Column | str, needle: str) -> Column:
    """Literal, case-insensitive substring; a null value never matches."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(needle))), F.lit(False))


def has_all(c: Column | str, wanted: Sequence[str]) -> Column:
    """Every wanted element is in the array; a null array never matches."""
    c = F.col(c) if isinstance(c, str) else c
    return all_of([F.coalesce(F.array_contains(c, w), F.lit(False)) for w in wanted])


def search(
    df: DataFrame,
    facets: Mapping[str, str] | None = None,
    text: Sequence[str] = (),
    text_col: str = "message",
) -> Column:
    """All facets and all text terms must match.

    A facet names a column when there is one (exact, case-sensitive), else a key of the
    ``meta`` map, else a ``key:value`` element of ``tags``. ``error`` is true when the code is
    not zero. Text terms are case-insensitive substrings; ``''`` and ``'*'`` match everything.
    """
    columns = {f.name: f.dataType for f in df.schema.fields}
    preds: list[Column] = []
    for key, value in (facets or {}).items():
        kind = columns.get(key)
        if key == "error" and kind is not None and not isinstance(kind, T.BooleanType):
            failed = F.coalesce(F.col(key) != 0, F.lit(False))
            wanted = str(value).lower()
            if wanted not in ("true", "false"):
                raise ValueError("the error facet takes true or false")
            preds.append(failed if wanted == "true" else ~failed)
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            preds.append(F.col(key) == F.lit(value).try_cast(kind))
        elif isinstance(kind, T.StringType):
            preds.append(F.col(key) == F.lit(value))
        elif kind is None and isinstance(columns.get("meta"), T.MapType):
            preds.append(F.col("meta").getItem(key) == F.lit(value))
        elif kind is None and isinstance(columns.get("tags"), T.ArrayType):
            preds.append(F.array_contains("tags", f"{key}:{value}"))
        else:
            raise ValueError(f"cannot search on facet {key!r}")
    for term in text:
        if term not in ("", "*"):
            preds.append(contains_ci(text_col, term))
    return F.coalesce(all_of(preds), F.lit(False))
