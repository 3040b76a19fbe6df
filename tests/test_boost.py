"""Boosting of several classes: held-out loss, weights, early stopping, scores as fitted."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import boost as operator
from tidemark.operators import learn
from tidemark.operators.boost import boost


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        a, b = rng.uniform(-2, 2), rng.uniform(-2, 2)
        label = "in" if a * a + b * b < 1.2 else "up" if a * b > 0 else "down"
        rows.append((k, a if k % 31 else None, b, label if rng.random() > 0.05 else rng.choice(("in", "up", "down")), 1.0 + k % 3))
    return spark.createDataFrame(rows, "k int, a double, b double, y string, w double").repartition(4).cache()


def loss(scored, classes, y="y"):
    rows = scored.collect()
    return -sum(math.log(max(r.probability[classes.index(r[y])], 1e-15)) for r in rows) / len(rows)


def test_several_classes(table):
    train, test = table.where("k % 3 > 0"), table.where("k % 3 = 0")
    model = boost(train, "y", ["a", "b"], weight="w", valid=F.col("k") % 5 == 0, rounds=12, rate=0.4, patience=4)
    assert model.classes == ["down", "in", "up"] and len(model.feature) <= len(model.losses) <= 12
    scored = model.transform(test)
    held = loss(scored, model.classes)
    forest = learn.boosted_trees(train.withColumn("label", F.array_position(F.array(*map(F.lit, model.classes)), F.col("y")).cast("int") - 1).na.fill(0.0), "label", ["a", "b"], "multi", maxDepth=3, numTrees=12)
    other = forest.transform(learn.vector(test.na.fill(0.0), ["a", "b"])).collect()
    assert held < -sum(math.log(max(r.probability[model.classes.index(r.y)], 1e-15)) for r in other) / len(other)
    assert scored.where("prediction = y").count() / test.count() > 0.8
    # the scores that fitting ended with are those of the model
    fitted = model.transform(train.where("k % 5 = 0")).collect()
    best = min(v for _, v in model.losses)
    assert -sum(r.w * math.log(r.probability[model.classes.index(r.y)]) for r in fitted) / sum(r.w for r in fitted) == pytest.approx(best, rel=1e-6)


def test_early_stop_and_two_classes(spark, table):
    rng = np.random.default_rng(1)
    noise = spark.createDataFrame([(int(k), float(x), int(rng.integers(2))) for k, x in enumerate(rng.normal(size=400))], "k int, x double, y int")
    model = boost(noise, "y", "x", valid=F.col("k") % 2 == 0, rounds=15, rate=0.8, patience=2)
    assert len(model.losses) < 15 and len(model.feature) <= len(model.losses) - 2 + 1
    two = table.na.fill(0.0).withColumn("z", (F.col("y") == "in").cast("int"))
    train, test = two.where("k % 3 > 0"), two.where("k % 3 = 0")
    own = boost(train, "z", ["a", "b"], rounds=8, rate=0.4).transform(test)
    gbt = learn.boosted_trees(train, "z", ["a", "b"], "binary", maxIter=8, maxDepth=3).transform(learn.vector(test, ["a", "b"])).select("k", F.col("prediction").alias("g"))
    assert own.join(gbt, "k").where("prediction = g").count() / test.count() > 0.95
    with pytest.raises(ValueError):
        boost(two.where("z = 1"), "z", "a")


def test_rounds_leave_nothing_on_disk(spark, table, monkeypatch):
    session.cut(spark.range(1))  # the folder is there
    home = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")

    def tables():
        return {folder for folder, _, files in os.walk(home) if any(f.endswith(".parquet") or f.startswith("part-") for f in files)}

    before, seen, put = tables(), [], session.Latest.put

    def watched(self, df):
        out = put(self, df)
        seen.append(len(tables() - before))
        return out

    monkeypatch.setattr(session.Latest, "put", watched)
    model = boost(table, "y", ["a", "b"], weight="w", rounds=3)
    assert len(model.losses) == 3 and seen == [1] * 4 and tables() == before
    assert boost(table, "y", ["a", "b"], rounds=0).transform(table).select("probability").distinct().count() == 1


@pytest.mark.parametrize(("classes", "bins"), [(3, 33), (3, 300), (900, 33)])
def test_blocks_there_and_back(classes, bins):
    rng, n = np.random.default_rng(2), 5001
    columns = [rng.integers(0, bins, (n, 4)), rng.integers(0, classes, n), rng.random(n), rng.random(n) < 0.5, rng.random((n, classes))]
    pack, unpack = operator._blocks(classes, 4, bins)
    held = pack(*columns)
    assert max(sum(len(c[k].as_py()) for c in held.columns) for k in range(held.num_rows)) <= operator.BLOCK
    back = list(unpack([held.slice(0, 2), held.slice(2)]))
    assert sum(len(part[0]) for part in back) == n and all(part[4].nbytes <= operator.BYTES for part in back)
    for k, column in enumerate(columns):
        assert np.array_equal(np.concatenate([part[k] for part in back]), column)
