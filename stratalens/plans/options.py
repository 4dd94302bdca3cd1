"""Checks of arguments shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


class ConfigError(ValueError):
    """An option has a value that the operator can't work with."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


def pick(df: DataFrame, columns: Sequence[str | int] | str | int | None, what: str = "columns") -> list[str]:
    """Column names from names or 0-based positions; None means all. Order is kept, repeats are an error."""
    if columns is None:
        return list(df.columns)
    if isinstance(columns, str | int):
        columns = [columns]
    out = []
    for c in columns:
        if isinstance(c, int):
            require(0 <= c < len(df.columns), f"{what}: no column {c}")
            c = df.columns[c]
        require(c in df.columns, f"{what}: no column {c}")
        out.append(c)
    require(len(set(out)) == len(out), f"{what}: a column is named twice")
    return out


def share(value: float, what: str) -> float:
    require(0 <= value <= 1, f"{what} must lie between 0 and 1")
    return value
