"""The explicit order that every ordered operator needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols or [])


@dataclass(frozen=True)
class Order:
    """Rows of one key in a total order; ``by`` must be unique within the key, so end it with a row id.

    Without a key all rows are one series and one task; give the key whenever there is one.
    """

    key: tuple[str, ...]
    by: tuple[str, ...]

    def __init__(self, key, by):
        object.__setattr__(self, "key", tuple(names(key)))
        object.__setattr__(self, "by", tuple(names(by)))

    def window(self, *more, descending: bool = False) -> WindowSpec:
        by = [F.col(c).desc() if descending else F.col(c).asc() for c in self.by]
        return Window.partitionBy(*self.key, *more).orderBy(*by)

    def to_here(self, *more) -> WindowSpec:
        return self.window(*more).rowsBetween(Window.unboundedPreceding, 0)

    def before(self, *more) -> WindowSpec:
        return self.window(*more).rowsBetween(Window.unboundedPreceding, -1)

    def after(self) -> WindowSpec:
        return self.window().rowsBetween(1, Window.unboundedFollowing)

    def last(self, n: int, *more) -> WindowSpec:
        return self.window(*more).rowsBetween(-(n - 1), 0)

    def whole(self, *more) -> WindowSpec:
        return Window.partitionBy(*self.key, *more)

    def row(self) -> Column:
        return F.row_number().over(self.window()).cast("long")


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is null."""
    return F.when(cond, 1).otherwise(0)


def clean(col) -> Column:
    """A float column with NaN as null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
