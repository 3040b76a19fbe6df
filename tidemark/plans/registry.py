"""All queries over the shared tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df):
    """Dates as text, which every client reads alike."""
    return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})


def _load() -> None:
    for module in ("series", "frame", "stats", "scaling", "scoring", "dates", "lunar", "convert", "scalars", "baskets", "learning", "sequential", "pivots", "storage", "store", "chance", "fits"):
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
