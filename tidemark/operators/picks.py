"""Random picks: by shares of a weight, by rejection, and random texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

SLOTS = 4096


def _wheel(options: DataFrame, ident: str, weight: str) -> DataFrame:
    """(ident, lo, hi, total): each option's stretch of the summed weights.  Options are a list, so one task adds them up."""
    w = Window.orderBy(ident).rowsBetween(Window.unboundedPreceding, 0)
    return options.select(ident, F.sum(weight).over(w).alias("__hi"), (F.sum(weight).over(w) - F.col(weight)).alias("__lo"), F.sum(weight).over(Window.partitionBy()).alias("__total"))


def by_share(draws: DataFrame, u: str, options: DataFrame, ident: str, weight: str) -> DataFrame:
    """``draws`` with the option whose stretch of the weights holds the draw's ``u`` in (0, 1]; weights are positive.

    Draws and stretches meet in slots of the wheel, so this is an equi-join with a filter.
    """
    wheel = _wheel(options, ident, weight)
    slot = lambda x: F.least(F.floor(x * SLOTS), F.lit(SLOTS - 1))
    ends = F.sequence(slot(F.col("__lo") / F.col("__total")), slot(F.col("__hi") / F.col("__total")))
    spread = wheel.withColumn("__slot", F.explode(ends))
    point = F.col(u) * F.col("__total")
    hit = draws.withColumn("__slot", slot(F.col(u))).join(spread, "__slot")
    return hit.where((point > F.col("__lo")) & (point <= F.col("__hi"))).drop("__slot", "__lo", "__hi", "__total")


def counted(picked: DataFrame, options: DataFrame, ident: str) -> DataFrame:
    """(ident, n): how often each option was picked, 0 for those that were not."""
    hits = picked.groupBy(ident).agg(F.count(F.lit(1)).alias("n"))
    return options.select(ident).join(hits, ident, "left").select(ident, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def by_rejection(draws: DataFrame, draw: str, options: DataFrame, ident: str, weight: str, seed: int = 0, tries: int = 16) -> DataFrame:
    """``draws`` with an option, each try taking any one and keeping it with probability weight / largest weight.

    Rounds of tries run until every draw has an option: draws without one after ``tries`` tries go to the next round.
    What a round leaves is written, so plans do not grow.
    """
    numbered = options.select(ident, weight, (F.row_number().over(Window.orderBy(ident)) - 1).cast("long").alias("__k"))
    n, top = numbered.agg(F.count(F.lit(1)), F.max(weight)).first()
    if not n:
        return draws.withColumn(ident, F.lit(None).cast(options.schema[ident].dataType)).limit(0)
    left, done, turn = draws, None, 0
    while turn == 0 or not left.isEmpty():
        uniform = lambda *x: (F.xxhash64(*x, F.lit(seed), F.lit(turn)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)  # noqa: E731, B023
        each = left.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        each = each.withColumn("__k", F.floor(uniform(F.col(draw), F.col("__t"), F.lit(1)) * n).cast("long"))
        kept = each.join(numbered, "__k").where(uniform(F.col(draw), F.col("__t"), F.lit(2)) <= F.col(weight) / float(top))
        first = cut(kept.groupBy(draw).agg(F.min_by(ident, "__t").alias(ident)))
        hit = left.join(first, draw)
        done = hit if done is None else done.unionByName(hit)
        left, turn = cut(left.join(first, draw, "left_anti")), turn + 1
    return done


def tokens(spark: SparkSession, n: int, length: int = 64, seed: int = 0) -> DataFrame:
    """(id, token): random texts of letters and digits."""
    return spark.range(n).withColumn("token", F.randstr(F.lit(length), F.lit(seed)))
