"""Model queries; learned numbers have no SQL, but closed forms do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as M
from ..operators.boost import boost
from .registry import query, table

COLS = ["l_quantity", "l_tax", "l_discount"]


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *COLS, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


@query("lr_skl", """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT 'l_quantity' AS name, round(a, 4) AS value FROM m UNION ALL SELECT 'intercept', round(b, 2) FROM m""")
def linear(spark, d):
    found = M.linear_regression(lines(spark, d), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(k, round(v, 2 if k == "intercept" else 4)) for k, v in found.items()], "name string, value double")


@query("lrc_skl")
def logistic(spark, d):
    return spark.createDataFrame(list(M.logistic_regression(lines(spark, d), "y", COLS).items()), "name string, value double")


@query("get_pca")
def components(spark, d):
    from pyspark.ml.functions import vector_to_array

    return M.pca(lines(spark, d), COLS, 2).select("l_orderkey", "l_linenumber", vector_to_array("pca").alias("pca"))


@query("lgb_train")
def trees(spark, d):
    model = M.boosted_trees(lines(spark, d), "l_extendedprice", COLS, maxIter=5, maxDepth=3)
    return model.transform(M.vector(lines(spark, d), COLS)).select("l_orderkey", "l_linenumber", "prediction")


@query("lgb_train_multi")
def boosted_classes(spark, d):
    """Return flags by boosting, rows weighted by quantity, a fifth of the orders for early stopping; all lines are scored."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "days"]
    df = table(spark, d, "lineitem").withColumn("days", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")))
    model = boost(df, "l_returnflag", cols, weight="l_quantity", valid=F.col("l_orderkey") % 5 == 0, rounds=4, patience=2)
    return model.transform(df).select("l_orderkey", "l_linenumber", "prediction", F.round(F.array_max("probability"), 6).alias("probability"))


@query("get_features_importance")
def importance(spark, d):
    return spark.createDataFrame(M.importances(M.boosted_trees(lines(spark, d), "y", COLS, "binary", maxIter=3, maxDepth=3), COLS), "name string, share double")


@query("elm_reg")
def elm(spark, d):
    df = lines(spark, d).withColumn("z", F.col("l_extendedprice") / 50000)
    scaled = df.withColumn("l_quantity", F.col("l_quantity") / 50)
    return scaled.select("l_orderkey", "l_linenumber", M.ExtremeLearningMachine(scaled, ["z"], COLS, 8).outputs()[0].alias("prediction"))


@query("elm_cls")
def elm_classes(spark, d):
    scaled = lines(spark, d).withColumn("l_quantity", F.col("l_quantity") / 50).withColumn("n", 1 - F.col("y"))
    return scaled.select("l_orderkey", "l_linenumber", M.ExtremeLearningMachine(scaled, ["n", "y"], COLS, 8).classify().alias("label"))


def _priced(spark, d):
    return table(spark, d, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 100).cast("double").alias("r"))


def _search(spark, d, grid):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    df = M.vector(_priced(spark, d), ["p_size", "r"])
    trees = GBTRegressor(labelCol="p_retailprice", maxIter=2, maxDepth=2, seed=1)
    return M.cross_validate(df, trees, RegressionEvaluator(labelCol="p_retailprice"), grid(trees), folds=2)


@query("lgb_cv")
def validated(spark, d):
    """(rmse): the mean error over the folds."""
    return spark.createDataFrame([(float(_search(spark, d, lambda trees: None).avgMetrics[0]),)], "rmse double")


@query("lgb_cv_grid_search")
def searched(spark, d):
    """(depth, rmse) of each depth that was tried."""
    from pyspark.ml.tuning import ParamGridBuilder

    found = _search(spark, d, lambda trees: ParamGridBuilder().addGrid(trees.maxDepth, [1, 3]).build())
    return spark.createDataFrame([(depth, float(x)) for depth, x in zip((1, 3), found.avgMetrics)], "depth int, rmse double")


@query("lr_fit_sm", """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b, regr_r2(l_extendedprice, l_quantity) AS r FROM lineitem)
SELECT 'l_quantity' AS name, round(a, 4) AS value FROM m UNION ALL SELECT 'intercept', round(b, 2) FROM m UNION ALL SELECT 'r2', round(r, 6) FROM m""")
def summary(spark, d):
    """Least squares with the share of the variance that it explains."""
    df = lines(spark, d)
    found = M.linear_regression(df, "l_extendedprice", ["l_quantity"])
    r2 = df.agg((F.corr("l_extendedprice", "l_quantity") ** 2).alias("r")).first()[0]
    return spark.createDataFrame([("l_quantity", round(found["l_quantity"], 4)), ("intercept", round(found["intercept"], 2)), ("r2", round(r2, 6))], "name string, value double")
