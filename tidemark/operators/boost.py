"""Gradient boosting of several classes with softmax, weights and early stopping.

Features are cut in bins by quantiles.  A round grows one tree for each class; for each level the sums of gradients and
curvatures by class, node, feature and bin are added up within the tasks, batch by batch, and then over them, so what a task
holds and what reaches the driver is bounded by classes x nodes x features x bins, whatever the number of rows.  Rows are
written with their bins and raw scores after each round, in place of those of the round before: plans do not grow, a lost
executor costs no round, and the disk holds two such tables at most and none in the end.  They are written in blocks of
some hundred rows, whose columns are bytes, as passing single rows to Python costs more than the sums.  Gradients,
curvatures and nodes are computed from them and the trees whenever they are asked for.  Null values go left at every split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Latest
from .order import names

TINY = 1e-6


@dataclass
class Boosted:
    """A fitted model: for each round and class the tables of a tree by node (children of n are 2n + 1 and 2n + 2)."""

    cols: list[str]
    classes: list
    edges: list[list[float]]
    prior: np.ndarray
    depth: int
    feature: np.ndarray | None = None  # rounds x classes x nodes; -1 at leaves
    bin: np.ndarray | None = None
    value: np.ndarray | None = None
    losses: list[tuple[float, float | None]] = field(default_factory=list)  # of training and validation rows, by round

    def transform(self, df: DataFrame, out: str = "prediction", probabilities: str = "probability") -> DataFrame:
        """``df`` with the likeliest class and the probabilities of all, in the order of ``classes``."""
        binned, softmax = _binned(self.edges), _softmax()
        added, prior = [_added(*tree, self.depth) for tree in zip(self.feature, self.bin, self.value)], self.prior

        @F.arrow_udf("array<double>")
        def scores(*columns: pa.Array) -> pa.Array:
            x = binned(columns)
            raw = np.tile(prior, (len(x), 1))
            for more in added:
                raw += more(x)
            return pa.ListArray.from_arrays(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32), softmax(raw).T.ravel())

        scored = df.withColumn(probabilities, scores(*[F.col(c).cast("double") for c in self.cols]))
        best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
        return scored.withColumn(out, F.element_at(F.array(*map(F.lit, self.classes)), best))


# What runs in tasks is made here as closures, which need no import of this package there.


def _binned(edges: list[list[float]]):
    """The bins of rows' features, rows x features: 0 for null and NaN, else 1 more than the edges below."""

    def binned(columns) -> np.ndarray:
        parts = []
        for column, own in zip(columns, edges):
            x = column.to_numpy(zero_copy_only=False)  # nulls are NaN
            parts.append(np.where(np.isnan(x), 0, np.searchsorted(np.array(own, float), x) + 1))
        return np.stack(parts, axis=1).astype(np.int32)

    return binned


def _softmax():
    def softmax(raw: np.ndarray) -> np.ndarray:
        """Classes x rows of scores by row."""
        turned = np.ascontiguousarray(raw.T)
        p = np.exp(turned - turned.max(axis=0))
        return p / p.sum(axis=0)

    return softmax


def _node(feature: np.ndarray, split: np.ndarray):
    """The node of each row in the tree of class ``k`` after so many ``steps``."""

    def node(x: np.ndarray, k: int, steps: int) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(steps):
            f = feature[k, at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > split[k, at]))
        return at

    return node


def _added(feature: np.ndarray, split: np.ndarray, value: np.ndarray, depth: int):
    """What the trees of a round add to rows' scores, rows x classes."""
    node = _node(feature, split)

    def added(x: np.ndarray) -> np.ndarray:
        return np.stack([value[k, node(x, k, depth)] for k in range(len(value))], axis=1)

    return added


BLOCKS = "x binary, y binary, w binary, v binary, f binary"
SUMS = "k int, node int, f int, b int, g double, h double"
#: Bytes of a block, of which Spark's reader takes some thousands at a time, and rows and bytes that are computed at once.
BLOCK, AT_ONCE, BYTES = 16_384, 16_384, 2**24


def _blocks(classes: int, features: int, bins: int):
    """Two functions: bins, labels, weights, whether a row validates, and scores to BLOCKS, and back in stretches of rows."""
    shapes = [(np.min_scalar_type(bins), (features,)), (np.dtype(np.int32), ()), (np.dtype(np.float64), ()), (np.dtype(bool), ()), (np.dtype(np.float64), (classes,))]
    row = sum(kind.itemsize * math.prod(shape) for kind, shape in shapes)
    size = max(1, BLOCK // row)
    at_once = max(size, min(AT_ONCE, BYTES // row))

    def pack(*columns: np.ndarray) -> pa.RecordBatch:
        held = [column.astype(kind) for column, (kind, _) in zip(columns, shapes)]
        cuts = range(0, len(held[0]), size)
        return pa.RecordBatch.from_arrays([pa.array([column[i : i + size].tobytes() for i in cuts], pa.binary()) for column in held], names=["x", "y", "w", "v", "f"])

    def unpack(batches):
        for batch in batches:
            whole = [np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape) for column, (kind, shape) in zip(batch.columns, shapes)]
            for i in range(0, len(whole[0]), at_once):
                yield [column[i : i + at_once] for column in whole]

    return pack, unpack


def _first(edges: list[list[float]], prior: np.ndarray, blocks: tuple):
    """Features, y, w and v to BLOCKS with the scores before the first round."""
    binned, (pack, _) = _binned(edges), blocks

    def first(batches):
        for batch in batches:
            yield pack(binned(batch.columns[:-3]), *[column.to_numpy(zero_copy_only=False) for column in batch.columns[-3:]], np.tile(prior, (batch.num_rows, 1)))

    return first


def _next(trees: tuple, depth: int, blocks: tuple):
    """BLOCKS with the scores after the round."""
    added, (pack, unpack) = _added(*trees, depth), blocks

    def after(batches):
        for x, y, w, v, f in unpack(batches):
            yield pack(x, y, w, v, f + added(x))

    return after


def _sums(feature: np.ndarray, split: np.ndarray, level: int, classes: int, features: int, bins: int, blocks: tuple):
    """BLOCKS to a task's SUMS of gradients and curvatures at the nodes of ``level``; with k -1, at level 0, the loss and weight of training (node 0) and validation rows (1)."""
    node, softmax, first, wide, tiny, (_, unpack) = _node(feature, split), _softmax(), 2**level - 1, 2**level, TINY, blocks

    def sums(batches):
        g, h, loss = np.zeros((classes, features, wide * bins)), np.zeros((classes, features, wide * bins)), np.zeros((2, 2))
        for x, y, w, v, f in unpack(batches):
            if level == 0:
                lost = -w * np.log(np.maximum(softmax(f)[y, np.arange(len(y))], 1e-15))
                for side, those in enumerate((~v, v)):
                    loss[side] += lost[those].sum(), w[those].sum()
            x, y, w, p = x[~v], y[~v], w[~v], softmax(f[~v])
            turned = np.ascontiguousarray(x.T)
            for k in range(classes):
                at = node(x, k, level) - first
                gradient, curvature = w * (p[k] - (y == k)), w * np.maximum(p[k] * (1 - p[k]), tiny)
                here = at >= 0  # other rows are in leaves above
                kept = slice(None) if here.all() else here
                at, gradient, curvature = at[kept] * bins, gradient[kept], curvature[kept]
                for j in range(features):
                    cell = at + turned[j][kept]
                    g[k, j] += np.bincount(cell, gradient, wide * bins)
                    h[k, j] += np.bincount(cell, curvature, wide * bins)
        k, j, cell = np.nonzero(h)
        both = [(np.full(2, -1), k), (np.arange(2), cell // bins + first), (np.full(2, -1), j), (np.full(2, -1), cell % bins), (loss[:, 0], g[k, j, cell]), (loss[:, 1], h[k, j, cell])]
        columns = [pa.array(np.concatenate(pair), pa.int32() if n < 4 else pa.float64()) for n, pair in enumerate(both)]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "node", "f", "b", "g", "h"])

    return sums


def _splits(hist: pd.DataFrame, l2: float, least: float) -> dict[tuple[int, int], tuple[int, int, tuple, tuple]]:
    """(class, node) to the best (feature, bin, (g, h) left, (g, h) right), if it lowers the loss."""
    out = {}
    for at, rows in hist.groupby(["k", "node"]):
        best = 1e-9
        for f, part in rows.groupby("f"):
            part = part.sort_values("b")
            g, h = part.g.cumsum().to_numpy(), part.h.cumsum().to_numpy()
            G, H = g[-1], h[-1]
            gain = g * g / (h + l2) + (G - g) ** 2 / (H - h + l2) - G * G / (H + l2)
            gain[(h < least) | (H - h < least)] = -1
            i = int(np.argmax(gain[:-1])) if len(gain) > 1 else 0
            if len(gain) > 1 and gain[i] > best:
                best, out[at] = gain[i], (int(f), int(part.b.iloc[i]), (g[i], h[i]), (G - g[i], H - h[i]))
    return out


def boost(df: DataFrame, y: str, cols, weight: str | None = None, valid: Column | None = None, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32,
          l2: float = 1.0, least: float = 1e-3, patience: int | None = None) -> Boosted:
    """Fit on the rows whose label is not null and for which ``valid`` does not hold.

    patience: stop when the loss of the ``valid`` rows has not fallen for so many rounds, and keep the best ones.
    """
    cols = names(cols)
    some = df.where(F.col(y).isNotNull())
    held = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    counted = some.where(~held).groupBy(y).agg(F.sum(w).alias("w")).limit(1001).collect()
    classes = sorted(r[y] for r in counted)
    if not 2 <= len(classes) <= 1000:
        raise ValueError(f"{len(classes)} classes; from 2 to 1000 can be told apart")
    mass = {r[y]: r.w for r in counted}
    prior = np.log(np.array([max(mass[c], TINY) for c in classes]) / sum(mass.values()))
    shares = [k / bins for k in range(1, bins)]
    edges = [sorted(set(e)) for e in some.where(~held).select(*[F.col(c).cast("double") for c in cols]).approxQuantile(cols, shares, 0.001)]
    model = Boosted(cols, classes, edges, prior, depth)
    K, nodes, wide = len(classes), 2 ** (depth + 1) - 1, max(map(len, edges)) + 2
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(y)).cast("int") - 1
    drawn = some.select(*[F.col(c).cast("double").alias(f"x{n}") for n, c in enumerate(cols)], place.alias("y"), w.alias("w"), held.alias("v")).where("y >= 0")
    trees, best, latest, blocks = [], (math.inf, 0), Latest(df.sparkSession), _blocks(K, len(cols), wide)

    def measured(level: int) -> tuple[pd.DataFrame, dict[bool, float]]:
        """The sums at the nodes of a level, and the losses with the trees of the rounds before."""
        each = rows.mapInArrow(_sums(feature, split, level, K, len(cols), wide, blocks), SUMS)
        found = pd.DataFrame([tuple(r) for r in each.groupBy("k", "node", "f", "b").agg(F.sum("g"), F.sum("h")).collect()], columns=["k", "node", "f", "b", "g", "h"])
        return found[found.k >= 0], {bool(r.node): r.g / r.h for r in found[found.k < 0].itertuples() if r.h}

    try:
        rows = latest.put(drawn.mapInArrow(_first(edges, prior, blocks), BLOCKS))
        for turn in range(rounds + 1):
            feature, split, value = np.full((K, nodes), -1), np.zeros((K, nodes), int), np.zeros((K, nodes))
            hist, found = measured(0)
            if turn:
                model.losses.append((found.get(False), found.get(True)))
                if found.get(True, math.inf) < best[0]:
                    best = found[True], turn
            if turn == rounds or turn and patience is not None and True in found and turn - best[1] >= patience:
                break
            for k, part in hist[hist.f == 0].groupby("k"):
                value[k, 0] = -rate * part.g.sum() / (part.h.sum() + l2)
            for level in range(depth):
                for (k, node), (f, b, *sides) in _splits(measured(level)[0] if level else hist, l2, least).items():
                    feature[k, node], split[k, node] = f, b
                    for side, (g, h) in enumerate(sides):
                        value[k, 2 * node + 1 + side] = -rate * g / (h + l2)
            trees.append((feature, split, value))
            rows = latest.put(rows.mapInArrow(_next(trees[-1], depth, blocks), BLOCKS))
    finally:
        latest.drop()
    kept = trees[: best[1]] if patience is not None and best[1] else trees
    model.feature, model.bin, model.value = (np.array([t[k] for t in kept]) for k in range(3))
    return model
