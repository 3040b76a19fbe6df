"""Turning points under rules of distance and height, curvature.

Which turning points stay depends on those kept before, so each key's rows are folded in one ``applyInPandas`` call.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import Order
from .series import turns


@dataclass(frozen=True)
class Limits:
    """When a pair of neighbouring extrema stays.

    Fewer than ``t_min`` rows between them: it goes, unless it differs by ``max_pct`` or ``max_val`` and more.  ``t_max``
    rows apart and more: it stays.  Else it goes if it differs by ``min_pct`` or ``min_val`` at most.  A pair whose removal
    would change the trend before and after stays in any case.  Of a share and a value the share counts.
    """

    t_min: int = 2
    t_max: float = math.inf
    min_pct: float | None = None
    min_val: float | None = None
    max_pct: float | None = None
    max_val: float | None = None
    from_zero: float = 1.0

    def _change(self, a: float, b: float) -> float:
        return abs(b - a) / abs(a) if a else (abs(self.from_zero) if b else 0.0)

    def _goes(self, a: tuple, b: tuple) -> bool:
        rows, rise = b[0] - a[0], abs(b[1] - a[1])
        if rows < self.t_min + 1:
            if self.max_pct is not None:
                return self._change(a[1], b[1]) < self.max_pct
            return self.max_val is None or rise < self.max_val
        if rows >= self.t_max:
            return False
        if self.min_pct is not None:
            return self._change(a[1], b[1]) <= self.min_pct
        return self.min_val is not None and rise <= self.min_val

    def sweep(self, spots: list[tuple]) -> list[tuple]:
        """One pass over (place, value, label) in order: the pairs that go are left out; the first point may go alone."""
        kept: list[tuple] = []
        k = 0
        while k < len(spots):
            if k + 2 < len(spots):
                here, there, behind = spots[k : k + 3]
                up = here[2]  # compare heights as if ``here`` were a peak
                if kept:
                    needed = up * here[1] > up * behind[1] or up * there[1] < up * kept[-1][1]
                    gone = 2
                else:
                    needed = up * here[1] >= up * behind[1]
                    gone = 1
                if not needed and self._goes(here, there):
                    k += gone
                    continue
            kept.append(spots[k])
            k += 1
        return kept


def _both_ways(spots: list[tuple], limits: Limits) -> list[tuple]:
    forth = limits.sweep(spots)
    back = limits.sweep([(-p, v, m) for p, v, m in reversed(forth)])
    return [(-p, v, m) for p, v, m in reversed(back)]


def prune_spots(spots: list[tuple], limits: Limits = Limits()) -> list[tuple]:
    """The turning points (place, value, label) that stay after sweeps forth and back, repeated until they are far enough apart or nothing changes."""
    if limits.t_min >= 1:
        spots, before = _both_ways(spots, limits), None
        while spots != before and len(spots) > 3 and any(b[0] - a[0] - 1 < limits.t_min for a, b in zip(spots, spots[1:])):
            spots, before = _both_ways(spots, limits), spots
    return spots


def prune(values: list[float], marks: list[int], limits: Limits = Limits()) -> list[int]:
    """Labels of all rows: those of the turning points that stay, 0 elsewhere."""
    out = [0] * len(values)
    for k, _, m in prune_spots([(k, values[k], m) for k, m in enumerate(marks) if m], limits):
        out[k] = m
    return out


def turning_marks(values: list[float]) -> list[int]:
    """1 at peaks, -1 at troughs (a plateau at its first row), 0 elsewhere, both ends labelled; as ``series.turns`` has it."""
    steps = [0] + [(b > a) - (b < a) for a, b in zip(values, values[1:])]
    out, ahead = [0] * len(values), 0
    for k in range(len(values) - 1, 0, -1):
        if steps[k] and steps[k] != ahead:
            out[k] = steps[k]
        ahead = steps[k] or ahead
    if values:
        out[0] = -ahead
    return out


class _Chain:
    """A list of turning points that shares its beginning with others: the last point, and the chain before it.

    Equal chains of one :class:`Prefixes` are one object.  ``tight``: two neighbours are closer than the limits have it.
    ``forth`` is how far a sweep forth has come with what it knows: (kept chain, the points it cannot decide yet).
    """

    __slots__ = ("spot", "before", "size", "tight", "forth")

    def __init__(self, spot: tuple, before: _Chain | None, limits: Limits):
        self.spot, self.before, self.forth = spot, before, None
        self.size = 1 + (before.size if before else 0)
        self.tight = bool(before) and (before.tight or spot[0] - before.spot[0] - 1 < limits.t_min)


class Prefixes:
    """The label of the newest row among all rows so far, row by row, as :func:`prune` of those rows has it.

    From row to row only the last turning point moves or one is added, so nearly all decisions of the sweeps are those of
    the row before.  A sweep forth needs the next two points for a decision and keeps its state at each point of a chain;
    a sweep back meets, after few points, a point and a last kept point that an earlier sweep back had met, and from there
    on the result is the earlier one.  Chains are never changed, so both are looked up.
    """

    def __init__(self, limits: Limits):
        self.limits, self.n = limits, 0
        self.points: _Chain | None = None
        self.first: tuple | None = None
        self.chains: dict[tuple, _Chain] = {}
        self.backs: dict[tuple, _Chain | None] = {}

    def _chain(self, spot: tuple, before: _Chain | None) -> _Chain:
        key = (spot[0], spot[2], id(before))
        if key not in self.chains:
            self.chains[key] = _Chain(spot, before, self.limits)
        return self.chains[key]

    def _gone(self, here: tuple, there: tuple, behind: tuple, last: tuple | None, way: int) -> int:
        """How many points from ``here`` on a sweep leaves out; way: 1 forth, -1 back."""
        up = here[2]
        needed = up * here[1] >= up * behind[1] if last is None else up * here[1] > up * behind[1] or up * there[1] < up * last[1]
        if needed or not self.limits._goes((way * here[0], here[1]), (way * there[0], there[1])):
            return 0
        return 1 if last is None else 2

    def _forth_state(self, chain: _Chain) -> tuple[_Chain | None, tuple]:
        todo, at = [], chain
        while at is not None and at.forth is None:
            todo.append(at)
            at = at.before
        kept, open_ = at.forth if at is not None else (None, ())
        for at in reversed(todo):
            open_ = (*open_, at.spot)
            while len(open_) > 2:
                gone = self._gone(*open_, kept.spot if kept else None, 1)
                if not gone:
                    kept = self._chain(open_[0], kept)
                open_ = open_[gone or 1 :]
            at.forth = kept, open_
        return kept, open_

    def _forth(self, chain: _Chain | None) -> _Chain | None:
        if chain is None:
            return None
        kept, open_ = self._forth_state(chain)
        for spot in open_:
            kept = self._chain(spot, kept)
        return kept

    def _back(self, chain: _Chain | None) -> _Chain | None:
        at, last, met, stayed = chain, None, [], []
        while at is not None:
            key = (id(at), last[0] if last else None)
            if key in self.backs:
                break
            there = at.before
            behind = there.before if there else None
            gone = self._gone(at.spot, there.spot, behind.spot, last, -1) if behind else 0
            met.append((key, None if gone else at.spot))
            if gone:
                at = there if gone == 1 else behind
            else:
                last, at = at.spot, there
        result = self.backs[key] if at is not None else None
        for key, spot in reversed(met):
            if spot is not None:
                result = self._chain(spot, result)
            self.backs[key] = result
        return result

    def skip(self, value: float) -> None:
        """Count a row in without asking for its label."""
        place, self.n = self.n, self.n + 1
        if self.points is None:
            if self.first is None or value == self.first[1]:
                self.first = self.first or (place, value)
                return
            step = 1 if value > self.first[1] else -1
            self.points = self._chain((place, value, step), self._chain((*self.first, -step), None))
            return
        _, before, label = self.points.spot
        step = (value > before) - (value < before)
        if step:
            self.points = self._chain((place, value, step), self.points.before if step == label else self.points)

    def put(self, value: float) -> int:
        """Count a row in; its label."""
        self.skip(value)
        kept = self.points
        if self.limits.t_min >= 1:
            kept, before = self._back(self._forth(kept)), None
            while kept is not before and kept is not None and kept.size > 3 and kept.tight:
                kept, before = self._back(self._forth(kept)), kept
        return kept.spot[2] if kept is not None and kept.spot[0] == self.n - 1 else 0


def find_extrema(df: DataFrame, order: Order, col: str, limits: Limits = Limits(), out: str = "extremum") -> DataFrame:
    """1 at kept peaks, -1 at kept troughs, else 0."""
    marked = turns(df, order, col, "__m")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), kind="stable")
        return frame.drop(columns="__m").assign(**{out: prune(frame[col].tolist(), frame["__m"].tolist(), limits)})

    return marked.groupBy(*order.key).applyInPandas(fold, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))


def last_labels(df: DataFrame, order: Order, col: str, window: int | None, least: int = 1, limits: Limits = Limits(), out: str = "extremum") -> DataFrame:
    """The label that each row has as the last of its window: the last ``window`` rows, or all rows so far if None.

    Null until there are ``window`` (``least``) rows.  All rows so far are not pruned afresh at each row: see :class:`Prefixes`.
    """
    first = window if window is not None else max(least, 1)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), kind="stable")
        values = frame[col].tolist()
        if window is None:
            sofar = Prefixes(limits)
            labels: list = [sofar.put(x) if k >= first else sofar.skip(x) for k, x in enumerate(values, 1)]
        else:
            labels = [None] * min(first - 1, len(values))
            for k in range(first, len(values) + 1):
                some = values[k - window : k]
                labels.append(prune(some, turning_marks(some), limits)[-1])
        return frame.assign(**{out: pd.array(labels, dtype="Int32")})

    return df.groupBy(*order.key).applyInPandas(fold, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))


def drop_close(df: DataFrame, order: Order, col: str, label: str, pct: float = 0.05) -> DataFrame:
    """``label`` without pairs of neighbouring extrema whose values differ by less than ``pct`` of the later one."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), kind="stable")
        marks, values = frame[label].tolist(), frame[col].tolist()
        spots = [k for k, m in enumerate(marks) if m]
        for a, b in zip(spots, spots[1:]):
            # of a pair that went, the second still is the first of the next pair only if it stayed
            if marks[a] and values[b] and abs(values[a] / values[b] - 1) < pct:
                marks[a] = marks[b] = 0
        return frame.assign(**{label: marks})

    return df.groupBy(*order.key).applyInPandas(fold, df.schema)


def last_position(df: DataFrame, order: Order, col: str, label: str, min_gap: int = 2) -> DataFrame:
    """(key, ..): where each key's last row stands against its last peak and trough, and against the moves before.

    The labels of the last ``min_gap`` rows do not count.  gap, dif and pct are from the last trough (up) and peak (down)
    to the last row; pos_ is their place between the least and the largest such move so far, null if those are equal.
    """
    w, upto = order.window(), order.before()
    rows = df.withColumns({"__rn": order.row(), "__n": F.count(F.lit(1)).over(order.whole())})
    rows = rows.withColumn("__l", F.when(F.col("__n") - F.col("__rn") >= min_gap, F.coalesce(F.col(label), F.lit(0))).otherwise(0))
    for name, mark in (("max", 1), ("min", -1)):
        hit = F.col("__l") == mark
        rows = rows.withColumns({f"__v{name}": F.last(F.when(hit, F.col(col)), ignorenulls=True).over(upto), f"__r{name}": F.last(F.when(hit, F.col("__rn")), ignorenulls=True).over(upto)})
    rows = rows.withColumns({
        "pct_min2now": F.try_divide(F.col(col), F.col("__vmin")) - 1, "dif_min2now": F.col(col) - F.col("__vmin"), "gap_min2now": F.col("__rn") - F.col("__rmin"),
        "pct_max2now": F.try_divide(F.col("__vmax"), F.col(col)) - 1, "dif_max2now": F.col("__vmax") - F.col(col), "gap_max2now": F.col("__rn") - F.col("__rmax")})
    last = F.col("__rn") == F.col("__n")
    now = [F.max(F.when(last, F.col(c))).alias(c) for c in ("pct_min2now", "dif_min2now", "gap_min2now", "pct_max2now", "dif_max2now", "gap_max2now")]
    past = [f(F.when(F.col("__l") == mark, F.col(f"{kind}_{way}"))).alias(f"{n}_{kind}_{way}") for way, mark in (("min2now", 1), ("max2now", -1)) for kind in ("pct", "dif", "gap") for n, f in (("least", F.min), ("most", F.max))]
    ends = [F.max(F.when(last, F.col("__vmax"))).alias("pre_max"), F.max(F.when(last, F.col("__vmin"))).alias("pre_min"), F.max_by(F.when(F.col("__l") != 0, F.col("__l")), F.when(F.col("__l") != 0, F.col("__rn"))).alias("last_label")]
    stats = rows.groupBy(*order.key).agg(*now, *past, *ends)
    place = {f"pos_{kind}_{way}": F.try_divide(F.col(f"{kind}_{way}") - F.col(f"least_{kind}_{way}"), F.col(f"most_{kind}_{way}") - F.col(f"least_{kind}_{way}")) for way in ("min2now", "max2now") for kind in ("pct", "dif", "gap")}
    return stats.select(*order.key, *[c.alias(n) for n, c in place.items()], "pct_min2now", "dif_min2now", "gap_min2now", "pct_max2now", "dif_max2now", "gap_max2now", "pre_max", "pre_min", "last_label")


def streak_of_signals(signals: DataFrame, order: Order, place: str, label: str) -> DataFrame:
    """(key, n, label): how many of the last snapshots in a row saw the same signal, each one row further on.

    ``signals`` has a row for each snapshot: the place of its last extremum and its label.
    """
    w = order.window()
    breaks = (F.col(place) - F.lag(place).over(w) != 1) | (F.lag(label).over(w) != F.col(label))
    runs = signals.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("__s", F.sum("__b").over(order.to_here()))
    each = runs.groupBy(*order.key, "__s").agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("label"))
    return each.groupBy(*order.key).agg(F.max_by("n", "__s").alias("n"), F.max_by("label", "__s").alias("label"))


def vanished(signals: DataFrame, order: Order, place: str, where: int, tolerance: int = 10) -> DataFrame:
    """(key, vanished): whether a signal within ``tolerance`` rows of ``where`` was in a snapshot and not in a later one.

    ``signals`` has a row for each snapshot (by ``order``) and extremum in it; ``place`` is null where it has none.
    """
    seen = F.max(F.coalesce(F.col(place).between(where - tolerance, where + tolerance), F.lit(False)))
    each = signals.groupBy(*order.key, *order.by).agg(seen.alias("__s"))
    begun = each.withColumn("__a", F.max("__s").over(order.to_here()))
    return begun.groupBy(*order.key).agg(F.max(F.col("__a") & ~F.col("__s")).alias("vanished"))


def check_extrema(df: DataFrame, order: Order, col: str, label: str) -> DataFrame:
    """(key, good): whether the labels (1 peak, -1 trough, else 0 or null) are in order.

    Three and more must alternate, and each two neighbours must be the highest and the lowest row of the closed stretch
    between them; no row before the first or behind the last may go beyond it.  One or two labelled rows must be the
    series' highest or lowest value, two of them one of each.  Without any the labels are not in order.
    """
    w = order.window()
    hit = F.coalesce(F.abs(F.col(label)) == 1, F.lit(False))
    rows = df.withColumn("__s", F.coalesce(F.sum(hit.cast("long")).over(order.to_here()), F.lit(0)))
    first = F.max_by(F.struct(F.col(label).cast("int").alias("m"), F.col(col).alias("v")), F.when(hit, 1))
    parts = rows.groupBy(*order.key, "__s").agg(first.alias("__f"), F.max(col).alias("__hi"), F.min(col).alias("__lo"))
    by_part = Window.partitionBy(*order.key).orderBy("__s")
    top, low = F.greatest("__hi", F.lead("__f.v").over(by_part)), F.least("__lo", F.lead("__f.v").over(by_part))
    mine, its, there = F.col("__f.m"), F.col("__f.v"), F.lead("__f.v").over(by_part)
    ends = F.lead("__f").over(by_part).isNull()
    beyond = F.when(mine == 1, its < F.col("__hi")).otherwise(its > F.col("__lo"))  # a row of the stretch goes beyond
    ahead = F.lead("__f.m").over(by_part)
    before = F.when(ahead == 1, there < F.col("__hi")).otherwise(there > F.col("__lo"))
    bad = (F.when(F.col("__s") == 0, ~ends & before).when(ends, beyond)
           .otherwise((mine == ahead) | (its == there) | F.when(mine == 1, (its != top) | (there != low)).otherwise((its != low) | (there != top))))
    found = parts.withColumn("__bad", F.coalesce(bad, F.lit(False)))
    whole = found.groupBy(*order.key).agg(
        F.max("__s").alias("n"), F.count_if("__bad").alias("bad"), F.max("__hi").alias("hi"), F.min("__lo").alias("lo"),
        F.max(F.when(F.col("__s") > 0, F.col("__f.v"))).alias("most"), F.min(F.when(F.col("__s") > 0, F.col("__f.v"))).alias("least"),
        F.max_by("__f.m", "__f.v").alias("up"), F.min_by("__f.m", "__f.v").alias("down"))
    one, two = (F.col("most") == F.col("hi")) | (F.col("most") == F.col("lo")), (F.col("most") == F.col("hi")) & (F.col("least") == F.col("lo")) & (F.col("most") > F.col("least"))
    good = F.when(F.col("n") == 0, False).when(F.col("n") == 1, one).when(F.col("n") == 2, two & (F.col("up") == 1) & (F.col("down") == -1)).otherwise(F.col("bad") == 0)
    return whole.select(*order.key, F.coalesce(good, F.lit(False)).alias("good"))


def extremum_steps(df: DataFrame, order: Order, col: str, label: str) -> DataFrame:
    """Labelled rows with difference, relative difference and rows since the extremum before."""
    hits = df.withColumn("__rn", order.row()).where(F.col(label) != 0)
    w = order.window()
    last = F.lag(col).over(w)
    return hits.withColumns({"diff": F.col(col) - last, "pct": F.try_divide(F.col(col) - last, F.abs(last)), "gap": F.col("__rn") - F.lag("__rn").over(w)}).drop("__rn")


def near_extrema(df: DataFrame, order: Order, col: str, label: str, rows: int = 3, pct: float = 0.01, out: str = "near") -> DataFrame:
    """The label of an extremum at most ``rows`` rows off whose value is within ``pct``; the nearest, the earlier on ties."""
    w = order.window()
    best = F.when(F.col(label) != 0, F.col(label))
    for k in range(1, rows + 1):
        for move in (F.lag, F.lead):
            other, value = move(label, k).over(w), move(col, k).over(w)
            best = F.coalesce(best, F.when((other != 0) & (F.abs(F.try_divide(F.col(col) - value, value)) <= pct), other))
    return df.withColumn(out, F.coalesce(best, F.lit(0)))


def last_extremum(df: DataFrame, order: Order, col: str, label: str, gap: int = 5, pct: float = 0.001) -> DataFrame:
    """(key, label, value, since): the last extremum that is ``gap`` rows old and ``pct`` away from the last value."""
    rows = df.withColumns({"__rn": order.row(), "__n": F.count(F.lit(1)).over(order.whole()), "__last": F.last(col).over(order.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    sure = rows.where((F.col(label) != 0) & (F.col("__n") - F.col("__rn") >= gap) & (F.abs(F.try_divide(F.col("__last") - F.col(col), F.col(col))) >= pct))
    return sure.groupBy(*order.key).agg(F.max_by(label, "__rn").alias("label"), F.max_by(col, "__rn").alias("value"), F.min(F.col("__n") - F.col("__rn")).alias("since"))


def curvature(x: list[Column], y: list[Column]) -> Column:
    """Signed curvature at the middle of three points, from the parabolas x(t), y(t) through them with t by chord length."""
    ta = F.sqrt(F.pow(x[1] - x[0], 2) + F.pow(y[1] - y[0], 2))
    tb = F.sqrt(F.pow(x[2] - x[1], 2) + F.pow(y[2] - y[1], 2))

    def parts(v: list[Column]) -> tuple[Column, Column]:
        left, right = F.try_divide(v[1] - v[0], ta), F.try_divide(v[2] - v[1], tb)
        return F.try_divide(left * tb + right * ta, ta + tb), F.try_divide(right - left, ta + tb) * 2

    (dx, ddx), (dy, ddy) = parts(x), parts(y)
    return F.try_divide(ddx * dy - ddy * dx, F.pow(dx * dx + dy * dy, F.lit(1.5)))


def rolling_curvature(df: DataFrame, order: Order, x: str, y: str, before: int = 3, behind: int = 3, out: str = "curvature") -> DataFrame:
    """Curvature at each row from it, the row ``before`` rows earlier and the one ``behind`` rows later."""
    w = order.window()
    points = [[F.lag(c, before).over(w), F.col(c), F.lead(c, behind).over(w)] for c in (x, y)]
    named = df.withColumns({f"__{n}{k}": v for n, vs in zip("xy", points) for k, v in enumerate(vs)})
    return named.withColumn(out, curvature([F.col(f"__x{k}") for k in range(3)], [F.col(f"__y{k}") for k in range(3)])).drop(*[f"__{n}{k}" for n in "xy" for k in range(3)])
