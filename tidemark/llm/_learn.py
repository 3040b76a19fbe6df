"""Bounded samples of labelled rows, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fold_of, text_of


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], folds: int, held_out: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple[int, int]]:
    """(id, text, y) of at most ``per_class`` documents labelled 0 and 1, and how many are labelled 0 and 1 in all.

    Only ids outside the held-out fold count.  The sample is the ids that hash lowest, so it is the same every time.
    """
    seen = labels.where(F.col(label).isin(0, 1) & (fold_of(id_col, folds) != held_out)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in seen.groupBy("y").count().collect()}
    ids = [tuple(r) for y in (0, 1) for r in seen.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class[y]).collect()]
    few = df.sparkSession.createDataFrame(ids, "id long, y int")
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    return slim.join(F.broadcast(few), "id"), (counts.get(0, 0), counts.get(1, 0))


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3):
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros(z.shape[1])
        keep = np.full(z.shape[1], ridge)
        keep[-1] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            slope = z.T @ (weight * (y - p)) - keep * self.w
            self.w += np.clip(np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), slope), -3, 3)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


def fit(x: np.ndarray, y: np.ndarray, counts: tuple[int, int]) -> Logistic | float:
    """A regression whose scores have the classes' shares of all labelled rows; that share where a class is missing."""
    share = counts[1] / sum(counts) if sum(counts) else 0.0
    if not len(y) or y.min() == y.max():
        return share
    per = np.array([counts[0] / (y == 0).sum(), counts[1] / (y == 1).sum()])
    weight = per[y.astype(int)]
    return Logistic(x, y.astype(float), weight * len(y) / weight.sum())
