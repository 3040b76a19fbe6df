"""Turning points called as the rows come: signals that a trough or a peak is behind the newest row.

Each row moves or adds the last turning point, and the turning points so far (or those of the last ``window`` rows) are
pruned as :func:`extrema.prune_spots` has it.  Online rules, after each row from the ``start``-th on:

1.  If the extremum of the last normal signal was among the extrema once and is not any more, the signal is taken back:
    the opposite signal is given, as ``reversed``.
2.  If the newest row is no extremum itself and the last extremum is not of the kind that was signalled last, the rules
    of its kind (:class:`Called`) say whether it is called now, as ``normal``.
3.  If nothing was called, but the value has gone past that of the extremum signalled last, the extremum in between was
    missed and is called now, as ``normal``.

The state of a key is its turning points and the last signal, not its rows: :func:`call_stream` keeps it between the
batches of a stream, :func:`call` folds a table's rows, and both give the same signals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .extrema import Limits, prune_spots, turning_marks
from .order import Order

INF = math.inf
KINDS = {1: "max", -1: "min"}


@dataclass(frozen=True)
class Called:
    """When an extremum behind the newest row is called.

    Distances from it (own) and from the last opposite extremum (other) are in rows (gap), in values (dif) and as a share
    (pct), counted in the direction of the move.  A pair is an open interval.  The own distance must lie in gap, dif and
    pct, or be over sure_gap, or over sure_dif and sure_pct; the other distance over other_gap, other_dif and other_pct, or
    over other_sure_gap, or over other_sure_dif and other_sure_pct.  The value must be beyond ``now`` and the extremum
    beyond ``past`` (under them for a trough, over them for a peak).
    """

    gap: tuple[float, float] = (0, INF)
    dif: tuple[float, float] | None = None
    pct: tuple[float, float] | None = (0, INF)
    sure_gap: float = INF
    sure_dif: float | None = None
    sure_pct: float | None = INF
    other_gap: float = 0
    other_dif: float | None = None
    other_pct: float | None = 0
    other_sure_gap: float = INF
    other_sure_dif: float | None = None
    other_sure_pct: float | None = INF
    now: float | None = None
    past: float | None = None

    def holds(self, kind: int, own: tuple, other: tuple, value: float, extremum: float) -> bool:
        """own, other: (gap, dif, pct), None where there is no such extremum or the share has a base of 0."""
        if own[0] is None or other[0] is None or own[0] >= other[0]:
            return False
        near = all(_between(x, span) for x, span in zip(own, (self.gap, self.dif, self.pct)))
        sure = _over(own[0], self.sure_gap) or _over(own[1], self.sure_dif) and _over(own[2], self.sure_pct)
        far = _over(other[0], self.other_gap) and _over(other[1], self.other_dif) and _over(other[2], self.other_pct)
        very = _over(other[0], self.other_sure_gap) or _over(other[1], self.other_sure_dif) and _over(other[2], self.other_sure_pct)
        beyond = all(bound is None or (x - bound) * kind > 0 for x, bound in ((value, self.now), (extremum, self.past)))
        return (near or sure) and (far or very) and beyond


def _over(x: float | None, bound: float | None) -> bool:
    return bound is None or x is not None and x > bound


def _between(x: float | None, span: tuple | None) -> bool:
    return span is None or x is not None and span[0] < x < span[1]


@dataclass(frozen=True)
class Rules:
    """limits: how turning points are pruned; start: the first row (from 0) that can give a signal, 4 * t_min if None;
    window: the rows before the newest one that count, all if None."""

    limits: Limits = Limits()
    trough: Called = Called()
    peak: Called = Called()
    start: int | None = None
    window: int | None = None


@dataclass
class Caller:
    """One key's state; :meth:`step` takes a row's value and gives (signal, kind of signal)."""

    rules: Rules
    n: int = 0
    points: list = field(default_factory=list)  # turning points so far (place, value, label); the last one is still open
    recent: list = field(default_factory=list)  # with a window: its values
    seen: list = field(default_factory=list)  # places of extrema that were kept after some row
    gone: list = field(default_factory=list)  # those of them that were not kept after a later one
    last: list | None = None  # the last signal: label, kind, place and value of the extremum

    def save(self) -> str:
        return json.dumps([self.n, self.points, self.recent, self.seen, self.gone, self.last])

    @classmethod
    def load(cls, rules: Rules, saved: str | None) -> Caller:
        if saved is None:
            return cls(rules)
        n, points, *rest = json.loads(saved)
        return cls(rules, n, [tuple(p) for p in points], *rest)

    def _take(self, value: float) -> list[tuple]:
        """Count the row in; the turning points that matter now."""
        place, self.n = self.n, self.n + 1
        if self.rules.window is not None:
            self.recent = (self.recent + [value])[-self.rules.window - 1 :]
            first = self.n - len(self.recent)
            return [(first + k, self.recent[k], m) for k, m in enumerate(turning_marks(self.recent)) if m]
        if not self.points:
            self.points = [(place, value, 0)]
            return []
        _, before, label = self.points[-1]
        step = (value > before) - (value < before)
        if step and not label:  # the first move: its beginning is an extremum too
            self.points = [(self.points[0][0], before, -step), (place, value, step)]
        elif step == label and step:
            self.points[-1] = (place, value, step)
        elif step:
            self.points.append((place, value, step))
        return self.points if self.points[-1][2] else []

    def step(self, value: float) -> tuple[int, str]:
        turning = self._take(value)
        start = 4 * self.rules.limits.t_min if self.rules.start is None else self.rules.start
        if self.n <= start:
            return 0, ""
        kept = prune_spots(turning, self.rules.limits)
        places = {p for p, _, _ in kept}
        alive = {p for p, _, _ in turning} | ({self.last[2]} if self.last else set())
        self.gone = sorted({*self.gone, *(p for p in self.seen if p not in places)} & alive)
        self.seen = sorted({*self.seen, *places} & alive)
        return self._signal(value, kept)

    def _distance(self, kept: list[tuple], label: int, value: float) -> tuple:
        """(gap, dif, pct) from the last extremum of a kind before the newest row, and its value."""
        found = next((s for s in reversed(kept) if s[2] == label and s[0] < self.n - 1), None)
        if found is None:
            return None, None, None, None
        low, high = (found[1], value) if label == -1 else (value, found[1])
        return self.n - 1 - found[0], high - low, high / low - 1 if low else None, found[1]

    def _signal(self, value: float, kept: list[tuple]) -> tuple[int, str]:
        here = bool(kept) and kept[-1][0] == self.n - 1
        before = kept[-2 if here else -1] if len(kept) > here else None
        if before is None:
            return 0, ""
        signal, kind, at = 0, "", None
        if self.last and self.last[1] == "normal" and self.last[2] != 0 and self.last[2] in self.gone:
            signal, kind, at = -self.last[0], "reversed", before
        if not here and not (self.last and self.last[0] == before[2]):
            sides = {m: self._distance(kept, m, value) for m in (1, -1)}
            rule = self.rules.peak if before[2] == 1 else self.rules.trough
            own, other = sides[before[2]], sides[-before[2]]
            if rule.holds(before[2], own[:3], other[:3], value, own[3]):
                signal, kind, at = before[2], "normal", before
        if not signal and self.last and self.last[0] == -before[2] and (value - self.last[3]) * self.last[0] > 0:
            signal, kind, at = before[2], "normal", before
        if signal:
            self.last = [signal, kind, at[0], at[1]]
        return signal, f"{kind}_{KINDS[signal]}" if signal else ""


def _schema(df: DataFrame, out: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType()), T.StructField(f"{out}_kind", T.StringType())])


def call(df: DataFrame, order: Order, col: str, rules: Rules = Rules(), out: str = "signal") -> DataFrame:
    """``out``: -1 where a trough is called, 1 where a peak is, else 0; and the kind of signal."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), kind="stable")
        caller = Caller(rules)
        made = [caller.step(x) for x in frame[col].tolist()]
        return frame.assign(**{out: pd.array([m[0] for m in made], "Int32"), f"{out}_kind": [m[1] for m in made]})

    return df.groupBy(*order.key).applyInPandas(fold, _schema(df, out))


class _Stream(StatefulProcessor):
    def __init__(self, order: Order, col: str, rules: Rules, out: str):
        self.order, self.col, self.rules, self.out = order, col, rules, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("caller", "saved string, newest string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        saved, newest = self.state.get() if self.state.exists() else (None, None)
        caller = Caller.load(self.rules, saved)
        by = list(self.order.by)
        frame = pd.concat(list(rows)).sort_values(by, kind="stable")
        signals, kinds = [], []
        for value, *place in zip(frame[self.col].tolist(), *[frame[c] for c in by]):
            place = json.dumps([_sortable(x) for x in place])
            late = newest is not None and json.loads(place) <= json.loads(newest)
            signal, kind = (None, None) if late else caller.step(value)
            newest = newest if late else place
            signals.append(signal)
            kinds.append(kind)
        self.state.update((caller.save(), newest))
        yield frame.assign(**{self.out: pd.array(signals, "Int32"), f"{self.out}_kind": kinds})

    def close(self) -> None:
        pass


def _sortable(x):
    return x.value if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x


def call_stream(df: DataFrame, order: Order, col: str, rules: Rules = Rules(), out: str = "signal") -> DataFrame:
    """:func:`call` over a stream; needs a key and the RocksDB state store.

    Rows of a key must come in order from batch to batch (within a batch they are sorted); one that is not behind the
    newest so far comes back with null signals and changes nothing.
    """
    return df.groupBy(*order.key).transformWithStateInPandas(
        statefulProcessor=_Stream(order, col, rules, out), outputStructType=_schema(df, out), outputMode="Append", timeMode="None")
