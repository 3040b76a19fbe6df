"""Models on Spark ML, and extreme learning machines by normal equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import names


def vector(df: DataFrame, cols, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names(cols), outputCol=out, handleInvalid="skip").transform(df)


def linear_regression(df: DataFrame, y: str, cols) -> dict[str, float]:
    """Least squares with an intercept: column to coefficient, and 'intercept'."""
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(labelCol=y, solver="normal").fit(vector(df, cols))
    return {**dict(zip(names(cols), map(float, model.coefficients))), "intercept": float(model.intercept)}


def logistic_regression(df: DataFrame, y: str, cols) -> dict[str, float]:
    """Maximum likelihood coefficients of a binary label."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(labelCol=y, regParam=0.0, maxIter=200, tol=1e-10).fit(vector(df, cols))
    return {**dict(zip(names(cols), map(float, model.coefficients))), "intercept": float(model.intercept)}


def pca(df: DataFrame, cols, k: int, out: str = "pca") -> DataFrame:
    """The first ``k`` principal components of the centred columns."""
    from pyspark.ml.feature import PCA, StandardScaler

    v = vector(df, cols, "__v")
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="__c", outputCol=out).fit(centred).transform(centred).drop("__v", "__c")


def boosted_trees(df: DataFrame, y: str, cols, objective: str = "regression", seed: int = 0, **params):
    """Gradient boosted trees for regression and binary labels, a forest for several classes."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor

    kind = {"regression": GBTRegressor, "binary": GBTClassifier, "multi": RandomForestClassifier}[objective]
    return kind(labelCol=y, featuresCol="features", seed=seed, **params).fit(vector(df, cols))


def importances(model, cols) -> list[tuple[str, float]]:
    """(column, share) of a tree model, largest first."""
    values = model.featureImportances.toArray()
    return sorted(((c, float(v)) for c, v in zip(names(cols), values / (values.sum() or 1))), key=lambda x: (-x[1], x[0]))


def cross_validate(df: DataFrame, estimator, evaluator, grid=None, folds: int = 3, seed: int = 0, parallelism: int = 2):
    """A fitted CrossValidator over a grid of parameters."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    return CrossValidator(estimator=estimator, estimatorParamMaps=grid or ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism).fit(df)


class ExtremeLearningMachine:
    """A random hidden layer as Columns, and output weights from the Gram matrix that one aggregation gives."""

    def __init__(self, df: DataFrame, y: list[str], cols, hidden: int = 20, seed: int = 0, ridge: float = 1e-6):
        self.cols = names(cols)
        rng = np.random.default_rng(seed)
        self.w, self.b = rng.normal(size=(len(self.cols), hidden)), rng.normal(size=hidden)
        h = [F.lit(1.0), *self._hidden()]
        named = df.select(*[c.alias(f"h{i}") for i, c in enumerate(h)], *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(y)]).dropna()
        n = len(h)
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        row = named.agg(*[F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"h{i}") * F.col(f"y{k}")).alias(f"r{i}_{k}") for i in range(n) for k in range(len(y))]).first()
        gram = np.zeros((n, n))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
        self.beta = np.linalg.solve(gram + ridge * np.eye(n), np.array([[row[f"r{i}_{k}"] or 0.0 for k in range(len(y))] for i in range(n)]))

    def _hidden(self) -> list[Column]:
        out = []
        for k in range(len(self.b)):
            s = F.lit(float(self.b[k]))
            for c, w in zip(self.cols, self.w[:, k]):
                s = s + F.col(c) * float(w)
            out.append(1 / (1 + F.exp(-s)))
        return out

    def outputs(self) -> list[Column]:
        h = self._hidden()
        done = []
        for k in range(self.beta.shape[1]):
            s = F.lit(float(self.beta[0, k]))
            for x, w in zip(h, self.beta[1:, k]):
                s = s + x * float(w)
            done.append(s)
        return done

    def classify(self) -> Column:
        a = F.array(*self.outputs())
        return F.array_position(a, F.array_max(a)).cast("int") - 1
