"""Attention and padding masks as arrays of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _grid(n: Column, seen) -> Column:
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.transform(places, lambda j: seen(i, j)))


def causal(n: Column) -> Column:
    """Row i sees up to i."""
    return _grid(n, lambda i, j: j <= i)


def chunked(n: Column, size: int, left: int | None = None) -> Column:
    """Row i sees its own chunk and `left` chunks before it, or all of them."""

    def seen(i: Column, j: Column) -> Column:
        chunk = F.floor(i / size)
        inside = j < (chunk + 1) * size
        return inside if left is None or left < 0 else inside & (j >= (chunk - left) * size)

    return _grid(n, seen)


def by_policy(n: Column, dynamic: Column | None = None, static_chunk: int = 0, left: int = -1) -> Column:
    """Chunks of a row's own size (dynamic), of a fixed one, or no limit; a row that sees nothing sees everything."""
    if dynamic is not None:
        grid = _grid(n, lambda i, j: j < (F.floor(i / dynamic) + 1) * dynamic)
    elif static_chunk > 0:
        grid = chunked(n, static_chunk, left)
    else:
        grid = _grid(n, lambda i, j: F.lit(True))
    return F.transform(grid, lambda row: F.when(F.exists(row, lambda x: x), row).otherwise(F.transform(row, lambda x: F.lit(True))))


def padding(n: Column, size: Column) -> Column:
    """True from the length on."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: i >= n)
