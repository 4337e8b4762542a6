"""Argument checks, made before any plan exists."""

from __future__ import annotations

from collections.abc import Iterable


def one_of(name: str, value: str, allowed: Iterable[str]) -> str:
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")
    return value


def whole(name: str, value: int, low: int | None = None, high: int | None = None) -> int:
    if isinstance(value, bool) or int(value) != value:
        raise ValueError(f"{name} must be a whole number; got {value!r}")
    value = int(value)
    if low is not None and value < low:
        raise ValueError(f"{name} must be at least {low}; got {value}")
    if high is not None and value > high:
        raise ValueError(f"{name} must be at most {high}; got {value}")
    return value
