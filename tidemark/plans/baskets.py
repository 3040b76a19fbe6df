"""Frequent event types per user and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets as B
from .registry import query, table

_B = "(SELECT DISTINCT user_id || '/' || CAST(ts AS DATE) AS b, event_type AS i FROM events)"


def _baskets(spark, d):
    return table(spark, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("b"), F.col("event_type").alias("i"))


_N = f"(SELECT count(DISTINCT b) FROM {_B})"

#: Sets of every size: each basket's sets are extended by its later items until none is left.
_SETS = f"""WITH RECURSIVE t AS {_B}, s AS (SELECT b, i AS last, [i] AS items FROM t UNION ALL SELECT s.b, t.i, list_append(s.items, t.i) FROM s JOIN t ON s.b = t.b AND t.i > s.last),
f AS (SELECT items, count(*) AS freq, count(*) / {_N} AS p FROM s GROUP BY items HAVING count(*) >= 0.005 * {_N})"""


@query("gen_C1", f"SELECT DISTINCT i FROM {_B}")
def singles(spark, d):
    return _baskets(spark, d).select("i").distinct()


@query("get_CkSup_and_FreqLk", f"SELECT x.i || '&' || y.i AS items, count(*) AS freq, round(count(*) / {_N}, 9) AS support FROM {_B} x JOIN {_B} y ON x.b = y.b AND x.i < y.i GROUP BY x.i, y.i HAVING count(*) >= 0.005 * {_N}")
def pairs(spark, d):
    found = B.level_counts(_baskets(spark, d), "b", "i", 0.005, 2)[1]
    return found.select(F.array_join("items", "&").alias("items"), "freq", F.round("support", 9).alias("support"))


@query("gen_Ck_from_FreqLk_1", _SETS + " SELECT array_to_string(x.items, '&') || '&' || y.items[2] AS candidate FROM f x JOIN f y ON len(x.items) = 2 AND len(y.items) = 2 AND x.items[1] = y.items[1] AND x.items[2] < y.items[2]")
def candidates(spark, d):
    frequent = B.level_counts(_baskets(spark, d), "b", "i", 0.005, 2)[1]
    return B.next_candidates(frequent.select("items")).select(F.array_join("items", "&").alias("candidate"))


def _sets(spark, d):
    return B.frequent_itemsets(_baskets(spark, d).groupBy("b").agg(F.collect_set("i").alias("items")), "items", 0.005)


_ALL = _SETS + " SELECT array_to_string(items, '&') AS items, freq, round(p, 9) AS support FROM f"


@query("get_CkSup_and_FreqLk_all", _ALL)
def itemsets(spark, d):
    return _sets(spark, d).select(F.array_join("items", "&").alias("items"), "freq", F.round("support", 9).alias("support"))


@query("apriori_levels", _ALL)
def levels(spark, d):
    """The same sets level by level: each level's sets extend those of the last."""
    found = B.all_levels(_baskets(spark, d), "b", "i", 0.005)
    return found.select(F.array_join("items", "&").alias("items"), "freq", F.round("support", 9).alias("support"))


_RULES = _SETS + """ SELECT array_to_string(a.items, '&') AS antecedent, array_to_string(c.items, '&') AS consequent, round(w.p, 9) AS support, round(w.p / a.p, 9) AS confidence, round(w.p / a.p / c.p, 6) AS lift
FROM f w JOIN f a ON len(a.items) < len(w.items) AND list_has_all(w.items, a.items) JOIN f c ON len(c.items) = len(w.items) - len(a.items) AND list_has_all(w.items, c.items) AND NOT list_has_any(a.items, c.items) WHERE w.p / a.p {} 0.02"""


def _ruled(spark, d, strict):
    found = B.rules_table(B.rules(_sets(spark, d), 0.02, strict))
    return found.select("antecedent", "consequent", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("gen_rules", _RULES.format(">"))
def rules(spark, d):
    return _ruled(spark, d, True)


@query("fpgrowth_mlx", _RULES.format(">="))
def rules_at_least(spark, d):
    return _ruled(spark, d, False)


@query("apriori_rules", _RULES.format(">="))
def rules_by_level(spark, d):
    """Rules from the sets found level by level."""
    found = B.rules_table(B.rules(B.all_levels(_baskets(spark, d), "b", "i", 0.005), 0.02, False))
    return found.select("antecedent", "consequent", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("rules2df", _SETS + """ SELECT array_to_string(a.items, '&') || ' -> ' || array_to_string(c.items, '&') AS rule, len(w.items) AS size, round(w.p / a.p, 9) AS confidence, rank() OVER (ORDER BY round(w.p, 9) DESC, round(w.p / a.p, 9) DESC, array_to_string(a.items, '&'), array_to_string(c.items, '&')) AS place
FROM f w JOIN f a ON len(a.items) < len(w.items) AND list_has_all(w.items, a.items) JOIN f c ON len(c.items) = len(w.items) - len(a.items) AND list_has_all(w.items, c.items) AND NOT list_has_any(a.items, c.items) WHERE w.p / a.p > 0.02""")
def rule_rows(spark, d):
    """Rules as one line of text each, with their place, which is counted in ranges."""
    from ..operators.ranges import running

    found = B.rules(_sets(spark, d), 0.02)
    rounded = found.select("antecedent", "consequent", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"))
    text = {c: F.array_join(c, "&") for c in ("antecedent", "consequent")}
    size = (F.size("antecedent") + F.size("consequent")).cast("long")
    placed = running(rounded.withColumn("size", size).withColumns(text), [], [F.desc("support"), F.desc("confidence"), "antecedent", "consequent"], place=F.lit(1))
    return placed.select(F.concat_ws(" -> ", "antecedent", "consequent").alias("rule"), "size", "confidence", "place")
