"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def frequent_itemsets(df: DataFrame, items: str, min_support: float) -> DataFrame:
    """(items sorted, freq, support) of the sets in at least ``min_support`` of the baskets (arrays), by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    baskets = df.select(F.array_distinct(items).alias("items"))
    n = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq", (F.col("freq") / n).alias("support"))


def level_counts(df: DataFrame, basket: str, item: str, min_support: float, levels: int = 2) -> list[DataFrame]:
    """Frequent sets level by level with joins: the candidates of a level extend the last level's sets by prefix.

    Each level joins the last level's sets per basket with frequent single items, so all work is by basket and set.
    """
    rows = df.select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct()
    n = rows.select("b").distinct().count()
    one = rows.groupBy("i").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_support * n)
    rows = rows.join(one.select("i"), "i", "left_semi")
    have = rows.select("b", F.array("i").alias("s"))
    out = [one.select(F.array("i").alias("items"), "freq", (F.col("freq") / n).alias("support"))]
    for _ in range(levels - 1):
        longer = have.join(rows, "b").where(F.col("i") > F.element_at("s", -1)).select("b", F.array_append("s", F.col("i")).alias("s"))
        counts = longer.groupBy("s").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_support * n)
        out.append(counts.select(F.col("s").alias("items"), "freq", (F.col("freq") / n).alias("support")))
        have = longer.join(counts.select("s"), "s", "left_semi")
    return out


def all_levels(df: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """(items, freq, support) of the frequent sets of every size, level by level until a level has none.

    Each level is written before the next one is built on it, so the plan stays short.
    """
    rows = df.select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct()
    n = rows.select("b").distinct().count()
    one = rows.groupBy("i").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_support * n)
    rows = cut(rows.join(one.select("i"), "i", "left_semi"))
    have, found = rows.select("b", F.array("i").alias("s")), [one.select(F.array("i").alias("items"), "freq")]
    while True:
        longer = have.join(rows, "b").where(F.col("i") > F.element_at("s", -1)).select("b", F.array_append("s", F.col("i")).alias("s"))
        counts = cut(longer.groupBy("s").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_support * n))
        if counts.isEmpty():
            break
        found.append(counts.select(F.col("s").alias("items"), "freq"))
        have = cut(longer.join(counts.select("s"), "s", "left_semi"))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.withColumn("support", F.col("freq") / n)


def next_candidates(frequent: DataFrame) -> DataFrame:
    """(items) of one item more: pairs of frequent sorted sets that agree in all but the last item."""
    sets = frequent.select("items", F.expr("slice(items, 1, size(items) - 1)").alias("head"), F.element_at("items", -1).alias("tail"))
    other = sets.select("head", F.col("tail").alias("more"))
    return sets.join(other, "head").where("more > tail").select(F.array_append("items", F.col("more")).alias("items"))


def rules(sets: DataFrame, min_confidence: float, strict: bool = True) -> DataFrame:
    """(antecedent, consequent, support_a, support_c, support, confidence, lift) for every split of every frequent set.

    strict: the confidence must be over ``min_confidence``, else at least that.
    """
    whole = sets.where(F.size("items") > 1)
    # bit k of a mask from 1 to 2^n - 2 says whether item k is in the antecedent
    masks = whole.withColumn("m", F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 2)")))
    split = masks.select("items", "support", F.expr("filter(items, (x, k) -> (shiftright(m, k) & 1) = 1)").alias("antecedent"), F.expr("filter(items, (x, k) -> (shiftright(m, k) & 1) = 0)").alias("consequent"))
    a = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("support_a"))
    c = sets.select(F.col("items").alias("consequent"), F.col("support").alias("support_c"))
    out = split.join(a, "antecedent").join(c, "consequent").withColumn("confidence", F.col("support") / F.col("support_a")).withColumn("lift", F.col("confidence") / F.col("support_c"))
    keep = F.col("confidence") > min_confidence if strict else F.col("confidence") >= min_confidence
    return out.where(keep).select("antecedent", "consequent", "support_a", "support_c", "support", "confidence", "lift")


def rules_table(found: DataFrame, joiner: str = "&") -> DataFrame:
    """Rules with their sets as text, most supported and surest first."""
    text = {c: F.array_join(c, joiner) for c in ("antecedent", "consequent")}
    return found.withColumns(text).orderBy(F.desc("support"), F.desc("confidence"), "antecedent", "consequent")
