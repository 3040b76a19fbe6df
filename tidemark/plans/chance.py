"""Random picks by weight, tokens, and sorting within arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import picks
from .registry import query, table

_DRAWS = "(SELECT event_id, (event_id % 1000 + 0.5) / 1000 AS u FROM events)"
_WHEEL = "(SELECT s_suppkey, sum(s_nationkey + 1) OVER (ORDER BY s_suppkey) AS hi, sum(s_nationkey + 1) OVER (ORDER BY s_suppkey) - (s_nationkey + 1) AS lo, sum(s_nationkey + 1) OVER () AS total FROM supplier)"


def _wheel(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("fitness"))


def _picked(spark, d):
    draws = table(spark, d, "events").select("event_id", ((F.col("event_id") % 1000 + 0.5) / 1000).alias("u"))
    return picks.by_share(draws, "u", _wheel(spark, d), "s_suppkey", "fitness")


@query("roulette_base", f"SELECT event_id, s_suppkey FROM {_DRAWS} JOIN {_WHEEL} ON u * total > lo AND u * total <= hi")
def wheel(spark, d):
    return _picked(spark, d).select("event_id", "s_suppkey")


@query("roulette_count", f"SELECT s_suppkey, count(u) AS n FROM {_WHEEL} LEFT JOIN {_DRAWS} ON u * total > lo AND u * total <= hi GROUP BY 1")
def counted(spark, d):
    return picks.counted(_picked(spark, d), _wheel(spark, d), "s_suppkey")


@query("roulette_stochastic_accept")
def accepted(spark, d):
    draws = table(spark, d, "events").select("event_id")
    return picks.by_rejection(draws, "event_id", _wheel(spark, d), "s_suppkey", "fitness", seed=3).select("event_id", "s_suppkey")


@query("gen_random_tokens", "SELECT i AS k, 64 AS size, TRUE AS alnum FROM range(1000) r(i)")
def tokens(spark, d):
    made = picks.tokens(spark, 1000, 64, seed=5)
    return made.select(F.col("id").alias("k"), F.length("token").cast("long").alias("size"), F.col("token").rlike("^[A-Za-z0-9]+$").alias("alnum"))


_A = "(SELECT user_id, list(value ORDER BY ts, event_id) AS a FROM events GROUP BY 1)"


def _arrays(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return rows.select("user_id", F.col("r.value").alias("a"))


for _name, _sql, _f in (
        ("quick_sort", "list_sort(a)", lambda a: S.sorted_array(a)), ("bubble_sort", "list_reverse_sort(a)", lambda a: S.sorted_array(a, False)),
        ("insert_to_sorted", "list_sort(list_append(a, 50.0))", lambda a: S.insert_sorted(S.sorted_array(a), F.lit(50.0))),
        ("insert_sort", "list_sort(list_concat(a, [10.0, 90.0]))", lambda a: S.insert_sorted(S.insert_sorted(S.sorted_array(a), F.lit(10.0)), F.lit(90.0)))):
    query(_name, f"SELECT user_id, array_to_string(list_transform({_sql}, lambda x: CAST(round(x * 100) AS BIGINT)), ',') AS sorted FROM {_A}")(
        lambda spark, d, f=_f: _arrays(spark, d).select("user_id", F.array_join(F.transform(f(F.col("a")), lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("sorted")))
for _name, _sql, _f in (
        ("bin_search", "len(list_filter(a, lambda x: x <= 50.0))", lambda a: S.insertion_index(a, F.lit(50.0))),
        ("rank_of_insert", "len(list_filter(list_distinct(a), lambda x: x < 50.0)) + 1", lambda a: S.rank_of_insert(a, F.lit(50.0), "dense")),
        ("rank_of_insert_bin", "len(list_filter(a, lambda x: x < 50.0)) + 1", lambda a: S.rank_of_insert(a, F.lit(50.0), "min"))):
    query(_name, f"SELECT user_id, CAST({_sql} AS DOUBLE) AS place FROM {_A}")(
        lambda spark, d, f=_f: _arrays(spark, d).select("user_id", f(S.sorted_array(F.col("a"))).cast("double").alias("place")))


@query("bucket_sort", "SELECT event_id, rank() OVER (ORDER BY value) AS place FROM events")
def buckets(spark, d):
    """All rows in order: ranges of values are sorted apart, and only their sizes are added up."""
    from ..operators.scoring import with_place

    return with_place(table(spark, d, "events").select("event_id", (-F.col("value")).alias("v")), "v").select("event_id", "place")


for _name, _sql, _f in (
        ("tol_x_big_eq_y", "value >= 50 - 0.5", S.at_least), ("tol_x_sml_y", "value < 50 - 0.5", S.below), ("tol_x_sml_eq_y", "value <= 50 + 0.5", S.at_most)):
    query(_name, f"SELECT event_id, {_sql} AS y FROM events")(
        lambda spark, d, f=_f: table(spark, d, "events").select("event_id", f(F.col("value"), F.lit(50.0), 0.5).alias("y")))


@query("expand", "SELECT event_id, CAST(ceil(octet_length(encode(props)) / 16.0) * 16 AS BIGINT) AS size, md5(props || repeat(chr(1), CAST(ceil(octet_length(encode(props)) / 16.0) * 16 - octet_length(encode(props)) AS BIGINT))) AS digest FROM events")
def padded(spark, d):
    filled = S.padded(F.col("props"))
    text = F.replace(F.decode(filled, "UTF-8"), F.lit("\0"), F.lit("\x01"))
    return table(spark, d, "events").select("event_id", F.octet_length(filled).cast("long").alias("size"), F.md5(text).alias("digest"))


for _name, _f in (("en_aes_cbc", lambda x: S.decrypt_cbc(S.encrypt_cbc(x, "a key of 16 byte", "an iv of 16 byte"), "a key of 16 byte", "an iv of 16 byte")),
                  ("en_aes_ecb", lambda x: S.decrypt_ecb(S.encrypt_ecb(x, "a key"), "a key"))):
    query(_name, "SELECT event_id, props AS text FROM events")(lambda spark, d, f=_f: table(spark, d, "events").select("event_id", f(F.col("props")).alias("text")))
for _name, _sql, _f in (
        ("en_base64", "base64(encode(props))", lambda x: S.base64_text(x)), ("en_base64_url", "translate(base64(encode(props)), '+/', '-_')", lambda x: S.base64_url(x)),
        ("de_base64", "props", lambda x: S.from_base64(S.base64_text(x))), ("de_base64_url", "props", lambda x: S.from_base64_url(S.base64_url(x)))):
    query(_name, f"SELECT event_id, {_sql} AS text FROM events")(lambda spark, d, f=_f: table(spark, d, "events").select("event_id", f(F.col("props")).alias("text")))
