"""Registry of queries: a Spark callable and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("frame_queries", "hist_queries", "ranking_queries", "fit_queries", "ml_queries")


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    for module in _MODULES:
        import_module(f"evq.plans.{module}")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Floating-point sums depend on their order: compare them rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bin_sql(x: str, n: int, lo: float, hi: float, flow: bool = False) -> str:
    below, above = ("0", f"{n - 1}") if flow else ("NULL", "NULL")
    width = repr((hi - lo) / n)
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {lo} THEN {below} WHEN {x} > {hi} THEN {above} "
        f"ELSE least(CAST(floor(({x} - {lo}) / CAST({width} AS DOUBLE)) AS INT), {n - 1}) END"
    )


def edge_sql(n: int, lo: float, hi: float, bin_name: str = "bin") -> str:
    width = repr((hi - lo) / n)
    return (
        f"{lo} + {bin_name} * CAST({width} AS DOUBLE) AS lo, "
        f"CASE WHEN {bin_name} = {n - 1} THEN CAST({hi} AS DOUBLE) "
        f"ELSE {lo} + ({bin_name} + 1) * CAST({width} AS DOUBLE) END AS hi"
    )


def unit_sql(key: str = "event_id", seed: int | str = 414) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"
