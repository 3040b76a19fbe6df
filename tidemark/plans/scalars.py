"""Scalar, array, map and string queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from .registry import query, table



def Q():
    return F.col("l_quantity")


def D():
    return F.col("l_discount")


def Z():
    return F.col("l_quantity") - 25


KEYS = ["l_orderkey", "l_linenumber"]


def _line(name, col, sql, places=9):
    expr = f"round(CAST({sql} AS DOUBLE), {places})" if places is not None else sql

    def run(spark, d):
        return table(spark, d, "lineitem").select(*KEYS, (F.round(col().cast("double"), places) if places is not None else col()).alias("y"))

    query(name, f"SELECT l_orderkey, l_linenumber, {expr} AS y FROM lineitem")(run)


_line("x_div_y", lambda: X.divide(D(), Z()), "CASE WHEN l_discount = 0 AND l_quantity = 25 THEN 1 WHEN l_quantity = 25 THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_discount / (l_quantity - 25) END")
_line("power", lambda: X.power(Z(), F.lit(3.0)), "(l_quantity - 25) ** 3")
_line("power_real", lambda: X.power(-Q(), F.lit(0.5)), "sqrt(l_quantity) * cos(pi() * 0.5)")
_line("log", lambda: X.log(Q(), 2), "log2(l_quantity)")
_line("log_natural", lambda: X.log(Q()), "ln(l_quantity)")
_line("cal_pct", lambda: X.pct(Z(), D()), "CASE WHEN l_quantity = 25 AND l_discount = 0 THEN 0 WHEN l_quantity = 25 THEN CASE WHEN l_discount > 0 THEN 1 ELSE -1 END ELSE (l_discount - (l_quantity - 25)) / abs(l_quantity - 25) END")
_line("s1divs2", lambda: X.ratio(Q(), D(), -1), "CASE WHEN l_discount = 0 THEN -1 ELSE l_quantity / l_discount END", 6)
_line("mcd2_tad", lambda: X.gcd(Q(), F.col("l_orderkey")), "gcd(CAST(l_quantity AS BIGINT), l_orderkey)")
_line("max_com_divisor", lambda: X.gcd_array(F.array(Q().cast("long"), F.col("l_partkey"), F.col("l_suppkey"))), "gcd(gcd(CAST(l_quantity AS BIGINT), l_partkey), l_suppkey)")
_line("min_com_multer", lambda: X.lcm_array(F.array(Q().cast("long"), F.col("l_linenumber").cast("long"), F.lit(6).cast("long"))), "lcm(lcm(CAST(l_quantity AS BIGINT), CAST(l_linenumber AS BIGINT)), 6)")
_line("get_num_decimal", lambda: X.decimals(D()), "CASE WHEN round(l_discount * 10, 6) % 10 = 0 THEN 0 WHEN round(l_discount * 100, 6) % 10 = 0 THEN 1 ELSE 2 END")
_line("isnull", lambda: X.is_null(F.nullif(F.col("l_returnflag"), F.lit("A"))), "l_returnflag = 'A'", None)
_line("tol2side_x_eq_y", lambda: X.within(Q(), F.lit(25.0), 3, 5), "l_quantity BETWEEN 22 AND 30", None)
_line("tol_eq", lambda: F.abs(Q() - 25) <= 2, "abs(l_quantity - 25) <= 2", None)
_line("tol_x_big_y", lambda: Q() > 25 + 2, "l_quantity > 27", None)
_line("replace_con_blank", lambda: X.collapse_blanks(F.concat_ws("   ", "l_returnflag", "l_linestatus"), "_"), "l_returnflag || '_' || l_linestatus", None)
_line("url2chn", lambda: F.url_decode(F.concat(F.lit("a%20b%2F"), F.col("l_returnflag"))), "'a b/' || l_returnflag", None)
_line("b64_encode", lambda: X.base64_text(F.concat_ws("-", "l_returnflag", "l_orderkey")), "to_base64(encode(l_returnflag || '-' || l_orderkey))", None)
_line("b64_round_trip", lambda: X.from_base64(X.base64_text(F.concat_ws("-", "l_returnflag", "l_orderkey"))), "l_returnflag || '-' || l_orderkey", None)
_line("aes_round_trip", lambda: X.decrypt(X.encrypt(F.concat_ws("-", "l_returnflag", "l_orderkey"), "some key"), "some key"), "l_returnflag || '-' || l_orderkey", None)
_line("md5", lambda: F.md5(F.concat_ws("-", "l_returnflag", "l_orderkey")), "md5(l_returnflag || '-' || l_orderkey)", None)


_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query("hmac_sha256", f"SELECT o_orderkey, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(CAST(o_orderkey AS VARCHAR))))) AS y FROM orders")
def hmac(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.hmac_sha256(F.col("o_orderkey").cast("string"), "secret").alias("y"))


def _lists(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"), F.sort_array(F.collect_list(F.col("l_quantity").cast("int") % 5)).alias("b"))


_LISTS = "(SELECT l_orderkey, list_sort(list(l_linenumber)) AS a, list_sort(list(CAST(l_quantity AS INTEGER) % 5)) AS b FROM lineitem GROUP BY 1)"


def _A():
    return F.col("a")


def _B():
    return F.col("b")


def _K():
    return F.sequence(F.lit(1), F.size("a"))


def _list(name, col, sql, text=True):
    query(name, f"SELECT l_orderkey, {f'array_to_string({sql}, chr(44))' if text else sql} AS y FROM {_LISTS}")(
        lambda spark, d: _lists(spark, d).select("l_orderkey", (F.array_join(F.transform(col(), lambda x: x.cast("string")), ",") if text else col()).alias("y")))


_list("check_l_allin_l0", lambda: X.subset(_B(), _A()), "len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0", False)
_list("list_eq", lambda: X.same_items(_A(), _B(), False), "list_sort(list_distinct(a)) = list_sort(list_distinct(b))", False)
_list("get_lists_inter", lambda: F.array_sort(F.array_intersect(_A(), _B())), "list_sort(list_distinct(list_intersect(a, b)))")
_list("link_lists", lambda: F.flatten(F.array(_A(), _B())), "list_concat(a, b)")
_list("cut_to_subs", lambda: F.transform(X.chunks(_A(), 3), lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "+")),
      "list_transform(range(CAST(ceil(len(a) / 3.0) AS BIGINT)), lambda i: array_to_string(list_slice(a, i * 3 + 1, i * 3 + 3), '+'))")
_list("insert_into_list", lambda: X.insert(_A(), 99, 2), "CASE WHEN list_contains(a, 2) THEN list_concat(list_concat(list_filter(a, lambda x: x < 2), [99]), list_filter(a, lambda x: x >= 2)) ELSE list_append(a, 99) END")
_list("count_list", lambda: F.transform(X.sorted_map(X.counts(_B())), lambda e: F.concat_ws(":", e["key"], e["value"])),
      "list_transform(list_sort(list_distinct(b)), lambda k: CAST(k AS VARCHAR) || ':' || len(list_filter(b, lambda x: x = k)))")
_list("sort_dict", lambda: F.transform(X.sorted_map(X.counts(_B()), "value", True), lambda e: F.concat_ws(":", e["key"], e["value"])),
      "list_transform(list_reverse_sort(list_transform(list_distinct(b), lambda k: {'n': len(list_filter(b, lambda x: x = k)), 'k': k})), lambda e: CAST(e.k AS VARCHAR) || ':' || e.n)")
_list("list2dict", lambda: F.transform(F.map_entries(F.map_from_arrays(_K(), _B())), lambda e: F.concat_ws(":", e["key"], e["value"])), "list_transform(range(1, len(a) + 1), lambda i: CAST(i AS VARCHAR) || ':' || b[i])")
_list("change_dict_key", lambda: F.transform(F.map_entries(F.transform_keys(F.map_from_arrays(_K(), _B()), lambda k, _: k * 10)), lambda e: F.concat_ws(":", e["key"], e["value"])), "list_transform(range(1, len(a) + 1), lambda i: CAST(i * 10 AS VARCHAR) || ':' || b[i])")
_list("merge_dicts", lambda: F.transform(F.map_entries(F.map_concat(F.map_from_arrays(_K(), _B()), F.create_map(F.lit(100), F.lit(7)))), lambda e: F.concat_ws(":", e["key"], e["value"])), "list_append(list_transform(range(1, len(a) + 1), lambda i: CAST(i AS VARCHAR) || ':' || b[i]), '100:7')")
_list("vote_label_int", lambda: X.vote(_B()), "list_transform(list_sort(list_transform(list_distinct(b), lambda k: {'n': -len(list_filter(b, lambda x: x = k)), 'k': k})), lambda e: e.k)[1]", False)
_list("cut_range_to_subs", lambda: F.transform(X.range_chunks(F.size(_A()), 3), lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "+")), "list_transform(range(CAST(ceil(len(a) / 3.0) AS BIGINT)), lambda i: CAST(i * 3 AS VARCHAR) || '+' || least(i * 3 + 3, len(a)))")


@query("vote_prob_bin_pcut", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount * 10 + l_tax * 10 >= 0.9 * 2 * 0.5 THEN 1 ELSE 0 END AS INTEGER) AS y FROM lineitem")
def vote_binary(spark, d):
    return table(spark, d, "lineitem").select(*KEYS, X.vote_binary(F.array(D() * 10, F.col("l_tax") * 10), 0.45).alias("y"))


@query("vote_prob_multi", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_tax + l_discount * 2 > l_discount + l_tax THEN 1 ELSE 0 END AS INTEGER) AS y FROM lineitem")
def vote_multi(spark, d):
    return table(spark, d, "lineitem").select(*KEYS, X.vote_multi(F.array(F.array(D(), F.col("l_tax")), F.array(F.col("l_tax"), D() * 2))).alias("y"))


@query("vote_prob_bin_rate1", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount + l_tax >= (SELECT quantile_cont(l_discount + l_tax, 0.7) FROM lineitem) THEN 1 ELSE 0 END AS INTEGER) AS y FROM lineitem")
def vote_rate(spark, d):
    df = table(spark, d, "lineitem").withColumn("s", D() + F.col("l_tax"))
    cut = df.agg(F.percentile("s", 0.7).alias("cut"))
    return df.join(F.broadcast(cut)).select(*KEYS, (F.col("s") >= F.col("cut")).cast("int").alias("y"))
