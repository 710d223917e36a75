"""Bin index of a value, as plain column expressions inside code generation.

Bins are half-open ``[lo, hi)``; the last one includes its upper edge. A value
that is null or NaN has no bin. ``flow`` folds everything below (above) the
range into the first (last) bin.
"""

from __future__ import annotations

import builtins
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_and_centers(bins, range: tuple[float, float] | None = None) -> tuple[list[float], list[float]]:
    if isinstance(bins, int):
        if range is None:
            raise ValueError("an integer number of bins needs a range")
        lo, hi = map(float, range)
        width = (hi - lo) / bins
        edges = [lo + i * width for i in builtins.range(bins)] + [hi]
    else:
        edges = [float(e) for e in bins]
        if any(a > b for a, b in zip(edges, edges[1:])):
            raise ValueError("bin edges must not decrease")
    return edges, bin_centers(edges)


def bin_centers(edges: Sequence[float]) -> list[float]:
    return [(a + b) * 0.5 for a, b in zip(edges, edges[1:])]


def bin_index(
    value: Column,
    bins: int | Sequence[float],
    range: tuple[float, float] | None = None,
    flow: bool = False,
) -> Column:
    """0-based bin of ``value``; null outside the range unless ``flow``."""
    edges, _ = edges_and_centers(bins, range)
    last = len(edges) - 2
    if isinstance(bins, int):
        width = (edges[-1] - edges[0]) / bins
        inside = F.least(F.floor((value - F.lit(edges[0])) / F.lit(width)).cast("int"), F.lit(last))
    else:
        inside = _search(value, edges, 0, last)
    return ranged(value, F.lit(edges[0]), F.lit(edges[-1]), inside, last, flow)


def ranged(value: Column, lo: Column, hi: Column, inside: Column, last: int, flow: bool = False) -> Column:
    """``inside`` for values in [lo, hi], the flow bins (or null) elsewhere."""
    none = F.lit(None).cast("int")
    return (
        F.when(value.isNull() | F.isnan(value), none)
        .when(value < lo, F.lit(0) if flow else none)
        .when(value > hi, F.lit(last) if flow else none)
        .otherwise(inside)
    )


def _search(value: Column, edges: Sequence[float], first: int, last: int) -> Column:
    """Binary search over literal edges as nested CASE: log2(bins) comparisons per row."""
    if first == last:
        return F.lit(first)
    middle = (first + last + 1) // 2
    return F.when(value < F.lit(edges[middle]), _search(value, edges, first, middle - 1)).otherwise(
        _search(value, edges, middle, last)
    )


def edge_columns(bin_col: Column, edges: Sequence[float]) -> tuple[Column, Column]:
    """Lower and upper edge of a bin number; null for a null bin (``element_at`` itself would not say so)."""
    table = F.array(*[F.lit(float(e)) for e in edges])
    return F.try_element_at(table, bin_col + 1), F.try_element_at(table, bin_col + 2)
