"""Argument checks shared by the operators."""

from __future__ import annotations


def in_range(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        bound = f"between {low} and {high}" if high is not None else f"at least {low}"
        raise ValueError(f"{name} must be {bound}, got {value}")
    return value


def top_n(n: int) -> int:
    return in_range("n", n, 1)


def limit_offset(limit: int | None, offset: int = 0) -> None:
    if limit is not None:
        in_range("limit", limit, 1)
    in_range("offset", offset, 0)


def filled(name: str, text: str) -> str:
    stripped = text.strip()
    if not stripped:
        raise ValueError(f"{name} must not be blank")
    return stripped


def choice(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")
    return value
