"""Zigzag pivots of a high and a low series, under rules of time and height for rises and falls, whole or resumed.

From a low pivot the highest row since is the candidate for the next high one.  It is a pivot once the rise to it is
sure and so is the fall from it to the deepest row behind it; at once if a row goes below the low pivot.  Low pivots are
found the same way on the mirrored series.  The first pivot comes from a walk back in time from the later one of the
highest and the lowest row.

All that matters after a sure pivot are the rows from it on, so the labels are the state of the fold: with ``label``, a
key's rows before its last sure pivot stay in the plan as they are, and only the later ones are folded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import Order

NONE = -math.inf


@dataclass(frozen=True)
class Leg:
    """When a move is sure: after more than ``t_min`` rows if it is ``min_pct`` (or ``min_val``) and more; before that if
    it is ``max_pct`` (or ``max_val``) and more; after ``t_max`` rows in any case.

    Shares and values are the size of the move, whichever way it goes; of a share and a value the share counts.
    """

    min_pct: float | None = None
    min_val: float | None = None
    max_pct: float | None = None
    max_val: float | None = None
    t_min: int | None = None
    t_max: float = math.inf
    from_zero: float = 1.0

    def __post_init__(self):
        if self.min_pct is None and self.min_val is None:
            raise ValueError("a leg needs min_pct or min_val; a negative one is met by every move")

    def size(self, a: float, b: float, share: bool) -> float:
        """How far ``b`` is above ``a``."""
        if not share:
            return b - a
        return (b - a) / abs(a) if a else math.copysign(self.from_zero, b) if b else 0.0

    def measure(self, a: float, b: float) -> float:
        return self.size(a, b, self.min_pct is not None)

    def sure(self, least: float, most: float | None, rows: int) -> bool:
        """least and most: the move by the measures of the minimum and of the maximum."""
        late = self.t_min is None or rows > self.t_min
        if rows >= self.t_max or late and least >= (self.min_val if self.min_pct is None else self.min_pct):
            return True
        top = self.max_val if self.max_pct is None else self.max_pct
        return top is not None and most is not None and (self.t_min is None or not late) and most >= top


class _Move:
    """A move so far: its two measures and its rows."""

    def __init__(self, leg: Leg):
        self.leg, self.least, self.most, self.rows = leg, NONE, NONE, 0

    def put(self, a: float, b: float, rows: int) -> None:
        self.least, self.most, self.rows = self.leg.measure(a, b), self.leg.size(a, b, self.leg.max_pct is not None), rows

    def sure(self) -> bool:
        return self.leg.sure(self.least, self.most, self.rows)


def next_high(high: list[float], low: list[float], at: int, leg: Leg, back: Leg) -> tuple[int, bool, bool]:
    """(row, whether the rise to it is sure, whether the fall from it is) of the high pivot behind the low pivot ``at``."""
    top, peak, rise, fall = at + 1, NONE, _Move(leg), _Move(back)
    n, k, done = len(high), at + 2, False
    while k < n and not done:
        if low[k] < low[at]:
            return max(range(top if peak > NONE else at + 1, k + 1), key=lambda r: (high[r], -r)), True, True
        if high[k - 1] > peak:
            top, peak, fall.least = k - 1, high[k - 1], NONE
            rise.put(low[at], peak, top - at)
        if back.measure(-peak, -low[k]) > fall.least:
            fall.put(-peak, -low[k], k - top)
        done = rise.sure() and fall.sure()
        k += 1
    if k == n and high[n - 1] > peak:  # the last row is the candidate, and nothing is behind it
        top = n - 1
        rise.put(low[at], high[top], top - at)
        fall.least, fall.most, fall.rows = 0.0, 0.0, 0
    return top, rise.sure(), fall.sure()


def walk(high: list[float], low: list[float], at: int, kind: int, up: Leg, down: Leg, out: list[float]) -> None:
    """Labels of the pivots behind row ``at``, which is one (1: high, -1: low): 1 and -1, or 0.5 and -0.5 for one not sure yet."""
    sides = {-1: (high, low, up, down), 1: ([-x for x in low], [-x for x in high], down, up)}
    while at < len(high):
        at, there, behind = next_high(*sides[kind][:2], at, *sides[kind][2:])
        if not there:
            return
        kind = -kind
        out[at] = float(kind) if behind else kind * 0.5
        if not behind:
            return


def zigzag_labels(high: list[float], low: list[float], up: Leg, down: Leg) -> list[float]:
    """The labels of a whole series."""
    n = len(high)
    out = [0.0] * n
    if not n:
        return out
    top, bottom = max(range(n), key=lambda r: (high[r], -r)), min(range(n), key=lambda r: (low[r], r))
    end, kind = (top, 1) if top > bottom else (bottom, -1)
    past = [0.0] * (end + 1)
    walk(high[end::-1], low[end::-1], 0, kind, up, down, past)
    past.reverse()
    first = next((k for k, label in enumerate(past) if abs(label) == 1), None)
    if first is None:
        return out
    out[: first + 1] = past[: first + 1]
    walk(high, low, first, int(past[first]), up, down, out)
    return out


def resumed_labels(high: list[float], low: list[float], kind: float | None, up: Leg, down: Leg) -> list[float]:
    """The labels of rows that begin with a sure pivot of that kind; without one, of a whole series."""
    if kind not in (1, -1):
        return zigzag_labels(high, low, up, down)
    out = [float(kind)] + [0.0] * (len(high) - 1)
    walk(high, low, 0, int(kind), up, down, out)
    return out


def zigzag(df: DataFrame, order: Order, high: str, low: str, up: Leg, down: Leg | None = None, label: str | None = None, out: str = "zigzag") -> DataFrame:
    """``out``: 1 at high pivots, -1 at low ones, 0.5 and -0.5 at a last one that is not sure yet, else 0.

    label: a column with the labels of an earlier run, null or 0 in rows that came since; it may be named like ``out``.
    Rows whose high or low is null or not finite are an error.
    """
    down = up if down is None else down
    for c in (high, low):
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == math.inf)
        df = df.withColumn(c, F.when(bad, F.raise_error(f"{c} has a value that is not finite")).otherwise(F.col(c)))
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), kind="stable")
        kind = None if label is None else frame[label].iloc[0]
        return frame[kept].assign(**{out: resumed_labels(frame[high].tolist(), frame[low].tolist(), kind, up, down)})

    if label is None:
        return df.groupBy(*order.key).applyInPandas(fold, schema)
    w = order.window()
    marked = df.withColumn("__row", F.row_number().over(w)).withColumn("__sure", F.max(F.when(F.abs(F.col(label)) == 1, F.col("__row"))).over(order.whole()))
    settled = marked.where(F.col("__row") < F.col("__sure")).select(*kept, F.col(label).cast("double").alias(out))
    later = marked.where(F.col("__sure").isNull() | (F.col("__row") >= F.col("__sure"))).drop("__row", "__sure")
    return settled.unionByName(later.groupBy(*order.key).applyInPandas(fold, schema))
