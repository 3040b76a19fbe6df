"""Running totals in an order that no task holds as a whole: by ranges of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def same(left: list[str], right: list[str]) -> Column:
    """The join condition that columns are equal pairwise, nulls too."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def running(df: DataFrame, key: list[str], by: list, **sums: Column) -> DataFrame:
    """``df`` with running totals within ``key`` in the order ``by`` (unique within the key), the row itself included.

    Rows are dealt by ranges of (key, order) and written with the number of their range, so that it does not change; each
    range is summed by itself, and only the ranges' totals, one row a range and key, are added up.
    """
    part = cut(df.repartitionByRange(*key, *by).withColumn("__range", F.spark_partition_id()))
    inner = Window.partitionBy("__range", *key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    per = part.groupBy(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in key]).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*[f"__k_{k}" for k in key]).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__r", *[f"__k_{k}" for k in key], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    own = part.withColumns({f"__s_{n}": F.sum(c).over(inner) for n, c in sums.items()})
    both = own.join(per, (F.col("__range") == F.col("__r")) & same(key, [f"__k_{k}" for k in key]))
    return both.select(*df.columns, *[(F.col(f"__s_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])
