"""Scores over several criteria: entropy weights, TOPSIS, judgement matrices."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import names


def entropy_weights(df: DataFrame, cols, negative=()) -> DataFrame:
    """(name, weight): columns scaled to 0..1 (turned round if ``negative``), as shares of their sums, weigh 1 - entropy.

    A share of 0 counts with the logarithm 1e-6, so it adds nothing.  Two aggregations over the rows.
    """
    cols = names(cols)
    edge = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.min, "a"), (F.max, "b"))], F.count(F.lit(1)).alias("n"))
    both = df.join(F.broadcast(edge))
    unit = {c: F.try_divide(F.col(f"b{i}") - F.col(c) if c in negative else F.col(c) - F.col(f"a{i}"), F.col(f"b{i}") - F.col(f"a{i}")) for i, c in enumerate(cols)}
    # sum(p ln p) with p = u / U is sum(u ln u) / U - ln U
    sums = both.agg(F.max("n").alias("n"), *[F.sum(u).alias(f"s{i}") for i, u in enumerate(unit.values())], *[F.sum(F.when(u > 0, u * F.ln(F.when(u > 0, u)))).alias(f"l{i}") for i, u in enumerate(unit.values())])
    spare = [1 + (F.col(f"l{i}") / F.col(f"s{i}") - F.ln(f"s{i}")) / F.ln("n") for i in range(len(cols))]
    total = reduce(lambda a, b: a + b, spare)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (d / total).alias("weight")) for c, d in zip(cols, spare)])).alias("e")).select("e.*")


def entropy_scores(df: DataFrame, cols, negative=(), out: str = "score") -> DataFrame:
    """Rows with the sum of their scaled columns by entropy weight."""
    cols = names(cols)
    weights = {r.name: r.weight for r in entropy_weights(df, cols, negative).collect()}
    edge = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.min, "__a"), (F.max, "__b"))])
    both = df.join(F.broadcast(edge))
    parts = [weights[c] * F.try_divide(F.col(f"__b{i}") - F.col(c) if c in negative else F.col(c) - F.col(f"__a{i}"), F.col(f"__b{i}") - F.col(f"__a{i}")) for i, c in enumerate(cols)]
    return both.withColumn(out, reduce(lambda a, b: a + b, parts)).drop(*[f"__{n}{i}" for i in range(len(cols)) for n in "ab"])


def topsis(df: DataFrame, cols, weights: dict[str, float] | None = None, score: str = "score") -> DataFrame:
    """Distance to the worst over the distances to best and worst, columns brought to length 1; weights on squares."""
    cols = names(cols)
    w = weights or {c: 1 / len(cols) for c in cols}
    stats = df.agg(*[x for i, c in enumerate(cols) for x in (F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"__n{i}"), F.max(c).alias(f"__b{i}"), F.min(c).alias(f"__a{i}"))])
    both = df.join(F.broadcast(stats))

    def distance(edge: str) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [w[c] * F.pow(F.try_divide(F.col(c) - F.col(f"__{edge}{i}"), F.col(f"__n{i}")), 2) for i, c in enumerate(cols)]))

    best, worst = distance("b"), distance("a")
    return both.withColumn(score, F.try_divide(worst, best + worst)).drop(*[f"__{n}{i}" for i in range(len(cols)) for n in "nba"])


def with_place(df: DataFrame, score: str, out: str = "place") -> DataFrame:
    """Place by score, best first, equal scores alike; scores are cut in ranges, whose sizes alone are added up."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(F.col(score).desc()).withColumn("__p", F.spark_partition_id())
    own = F.sum("__n").over(Window.partitionBy("__p").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0))
    sizes = counts.groupBy("__p").agg(F.sum("__n").alias("__s"))
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    places = counts.withColumn("__u", own).join(before, "__p").select(F.col(score).alias("__k"), (F.col("__u") - F.col("__n") + 1 + F.col("__b")).cast("long").alias(out))
    return df.join(places, F.col(score).eqNullSafe(F.col("__k")), "left").drop("__k")


def judgement_matrix(scores: DataFrame, item: str, score: str, most: int = 9, big: bool = True) -> DataFrame:
    """(a, b, value) of all pairs of a few items: rounded ratios of scores, cut to 1..most, and their reciprocals."""
    left, right = scores.select(F.col(item).alias("a"), F.col(score).alias("sa")), scores.select(F.col(item).alias("b"), F.col(score).alias("sb"))
    ratio = F.try_divide(F.greatest("sa", "sb"), F.least("sa", "sb"))
    level = F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.round(ratio)))
    wins = F.col("sa") >= F.col("sb") if big else F.col("sa") <= F.col("sb")
    # the items of a judgement are a handful, and every pair of them is an entry of the matrix
    return left.join(right, F.lit(True)).select("a", "b", F.when(wins, level).otherwise(1 / level).alias("value"))


def is_reciprocal(matrix: DataFrame, tol: float = 0.001) -> DataFrame:
    """(good): whether value(a, b) * value(b, a) is 1 for all pairs."""
    back = matrix.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("value").alias("back"))
    return matrix.join(back, ["a", "b"]).agg(F.coalesce(F.max(F.abs(F.col("value") * F.col("back") - 1)) <= tol, F.lit(True)).alias("good"))


def column_weights(matrix: DataFrame) -> DataFrame:
    """(name, weight): columns brought to sum 1, rows averaged."""
    sums = matrix.groupBy("b").agg(F.sum("value").alias("s"))
    return matrix.join(sums, "b").groupBy(F.col("a").alias("name")).agg(F.avg(F.col("value") / F.col("s")).alias("weight"))


def column_consistency(matrix: DataFrame) -> DataFrame:
    """(ci): the consistency index with the eigenvalue that the column weights give; 0 for up to two items."""
    w = column_weights(matrix)
    products = matrix.join(w, F.col("b") == F.col("name")).groupBy("a").agg(F.sum(F.col("value") * F.col("weight")).alias("y"))
    both = products.join(w, F.col("a") == F.col("name")).agg(F.avg(F.try_divide("y", "weight")).alias("top"), F.count(F.lit(1)).alias("n"))
    return both.select(F.when(F.col("n") <= 2, 0.0).otherwise(F.try_divide(F.col("top") - F.col("n"), F.col("n") - 1)).alias("ci"))


def eigen_weights(matrix: np.ndarray, random_index: float | None = None) -> tuple[np.ndarray, float, float | None]:
    """(weights, consistency index, ratio) of a small matrix on the driver, from its principal eigenvector."""
    values, vectors = np.linalg.eig(np.asarray(matrix, float))
    k = int(np.argmax(values.real))
    v = np.abs(vectors[:, k].real)
    n = len(v)
    index = (values[k].real - n) / (n - 1) if n > 1 else 0.0
    return v / v.sum(), index, index / random_index if random_index else None


def random_indices(spark, sizes: range, most: int = 9, rounds: int = 500, seed: int = 0) -> DataFrame:
    """(n, ri): mean consistency index of random reciprocal matrices, simulated in tasks with their own seeds."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for n, k in zip(frame.n, frame.k):
                rng = np.random.default_rng((seed, int(n), int(k)))
                values = np.concatenate((np.arange(1, most + 1), 1 / np.arange(2, most + 1)))
                m = np.triu(rng.choice(values, (n, n)), 1)
                with np.errstate(divide="ignore"):
                    m = m + np.where(m.T > 0, 1 / m.T, 0) + np.eye(n)
                rows.append((int(n), eigen_weights(m)[1]))
            yield pd.DataFrame(rows, columns=["n", "ci"])

    grid = spark.range(rounds).withColumnRenamed("id", "k").withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    return grid.mapInPandas(run, "n int, ci double").groupBy("n").agg(F.avg("ci").alias("ri"))


def combined_weights(experts: list[np.ndarray], skip_bad: float | None = 0.1, random_index: float | None = None) -> np.ndarray:
    """Weights of several experts' matrices, each expert by exp(-10 (n - 1) CI); those over ``skip_bad`` are left out."""
    done = [eigen_weights(m, random_index) for m in experts]
    kept = [(w, i) for w, i, r in done if skip_bad is None or r is None or r <= skip_bad]
    factor = np.array([np.exp(-10 * (len(w) - 1) * max(0.0, i)) for w, i in kept])
    return sum(f * w for f, (w, _) in zip(factor / factor.sum(), kept))
