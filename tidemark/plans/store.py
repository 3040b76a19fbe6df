"""Queries through catalog tables: the sink modes of a database table, its structure, keys and partitions.

Each query works in a database of its own, whose folder is in the one that driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import database as D
from ..sources import tables as T
from .registry import query, table
from .storage import folder

_OLD = "(SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer WHERE c_custkey % 3 <> 2)"
_NEW = "(SELECT c_custkey AS k, -c_acctbal AS v, c_nationkey AS w FROM customer WHERE c_custkey % 3 <> 0)"


def _name(spark) -> str:
    home = f"tidemark_{uuid.uuid4().hex}"
    T.create_database(spark, home, folder(spark))
    return f"{home}.t"


def _old(spark, d):
    return table(spark, d, "customer").where("c_custkey % 3 <> 2").selectExpr("c_custkey AS k", "c_acctbal AS v", "c_mktsegment AS s")


def _new(spark, d):
    return table(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "-c_acctbal AS v", "c_nationkey AS w")


def _stored(spark, d) -> str:
    name = _name(spark)
    T.sink(_old(spark, d), name)
    return name


_FULL = f"FROM {_OLD} a FULL JOIN {_NEW} b ON a.k = b.k"
_NEW_WINS = f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, s, w {_FULL}"
_OLD_WINS = f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v, s, w {_FULL}"
for _mode, _sql in (("replace", _NEW_WINS), ("insert_ignore", _OLD_WINS), ("insert_ignore_new_columns", _OLD_WINS), ("ignore_table", f"SELECT * FROM {_OLD}"), ("new", f"SELECT * FROM {_NEW}"),
                    ("insert_new_columns", f"SELECT a.k, a.v, s, w FROM {_OLD} a LEFT JOIN {_NEW} b ON a.k = b.k")):
    def _sunk(spark, d, mode=_mode):
        name = _stored(spark, d)
        T.sink(_new(spark, d), name, mode, "k")
        return spark.table(name)

    query(f"df_to_sql_{_mode}", _sql)(_sunk)


@query("df_to_sql_insert", f"SELECT k, v, s, NULL AS w FROM {_OLD} UNION ALL SELECT k, v, NULL, w FROM {_NEW} WHERE k % 3 = 2")
def inserted(spark, d):
    name = _stored(spark, d)
    T.sink(_new(spark, d).where("k % 3 = 2"), name, "insert", "k")
    return spark.table(name)


@query("df_to_sql_by_row", f"SELECT k, v, s, NULL AS w FROM {_OLD} WHERE k % 3 = 0 UNION ALL SELECT k, v, NULL, w FROM {_NEW}")
def by_row(spark, d):
    name = _stored(spark, d)
    T.replace_rows(_new(spark, d), name, "k")
    return spark.table(name)


@query("merge_into", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, s {_FULL}")
def merged(spark, d):
    name = _stored(spark, d)
    T.merge(spark, name, _new(spark, d), "k", "v")
    return spark.table(name)


@query("merge_into1", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v, s {_FULL}")
def merged_kept(spark, d):
    name = _stored(spark, d)
    T.merge(spark, name, _new(spark, d), "k", "v", keep="target")
    return spark.table(name)


@query("get_data", f"SELECT k, s FROM {_OLD} WHERE v > 100")
def data(spark, d):
    return T.get(spark, _stored(spark, d), ["k", "s"], "v > 100")


@query("get_unique_values", f"SELECT DISTINCT s FROM {_OLD}")
def unique(spark, d):
    return T.values(spark, _stored(spark, d), "s")


@query("execute_sql", f"SELECT s, count(*) AS n FROM {_OLD} GROUP BY s")
def executed(spark, d):
    return T.execute(spark, f"SELECT s, count(*) AS n FROM {_stored(spark, d)} GROUP BY s")


@query("drop_data_by_where_str", f"SELECT * FROM {_OLD} WHERE NOT v > 100")
def removed(spark, d):
    name = _stored(spark, d)
    T.remove(spark, name, "v > 100")
    return spark.table(name)


@query("clear_data", "SELECT 0 AS rows, 3 AS columns")
def cleared(spark, d):
    name = _stored(spark, d)
    T.clear(spark, name)
    return T.info(spark, name).select(F.col("rows").cast("int").alias("rows"), "columns")


@query("get_db_info", f"SELECT count(*) AS rows, 3 AS columns FROM {_OLD}")
def info(spark, d):
    return T.info(spark, _stored(spark, d))


@query("copy_table", f"SELECT (SELECT count(*) FROM {_OLD}) AS rows, 0 AS empty")
def copied(spark, d):
    name = _stored(spark, d)
    T.copy(spark, name, f"{name}_full", True)
    T.copy(spark, name, f"{name}_empty")
    return spark.range(1).select(F.lit(spark.table(f"{name}_full").count()).alias("rows"), F.lit(spark.table(f"{name}_empty").count()).alias("empty"))


def _facts(spark, **facts):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])


@query("has_table", "SELECT TRUE AS first, FALSE AS second")
def there(spark, d):
    name = _stored(spark, d)
    return _facts(spark, first=T.has(spark, name), second=T.has(spark, f"{name}_other"))


@query("drop_table", "SELECT FALSE AS there")
def dropped(spark, d):
    name = _stored(spark, d)
    T.drop(spark, name)
    return _facts(spark, there=T.has(spark, name))


@query("show_tables", "SELECT name FROM (VALUES ('t'), ('t_copy')) x(name)")
def shown(spark, d):
    name = _stored(spark, d)
    T.copy(spark, name, f"{name}_copy")
    return spark.createDataFrame([(t,) for t in T.tables(spark, name.split(".")[0])], "name string")


@query("create_database", "SELECT TRUE AS before, FALSE AS after")
def databases(spark, d):
    home = _stored(spark, d).split(".")[0]
    before = spark.catalog.databaseExists(home)
    T.drop_database(spark, home)
    return _facts(spark, before=before, after=spark.catalog.databaseExists(home))


@query("get_now_database", "SELECT 'default' AS name")
def current(spark, d):
    return _facts(spark, name=T.database(spark))


@query("get_data_file_dir", "SELECT 't' AS folder")
def place(spark, d):
    return _facts(spark, folder=T.folder(spark, _stored(spark, d)).rstrip("/").rsplit("/", 1)[-1])


_TYPES = "SELECT name, type FROM (VALUES ('k', 'bigint'), ('v', 'double'), ('s', 'string')) x(name, type)"


@query("get_fields", _TYPES)
def fields(spark, d):
    return spark.createDataFrame(T.fields(spark, _stored(spark, d)), "name string, type string")


@query("get_cols_info_df", "SELECT CAST(place AS INTEGER) AS place, name, type FROM (VALUES (0, 'k', 'bigint'), (1, 'v', 'double'), (2, 's', 'string')) x(place, name, type)")
def columns(spark, d):
    return T.column_info(spark, _stored(spark, d))


@query("create_table", "SELECT k, w FROM (VALUES (1, 'a'), (2, NULL)) x(k, w)")
def created(spark, d):
    name = _name(spark)
    T.create(spark, name, {"k": "int", "w": "string"}, "k")
    T.sink(spark.createDataFrame([(1, "a"), (2, None)], "k int, w string"), name, "insert", "k")
    return spark.table(name)


@query("add_cols", f"SELECT k, v, s, CAST(NULL AS INTEGER) AS n FROM {_OLD}")
def widened(spark, d):
    name = _stored(spark, d)
    T.add_columns(spark, name, {"n": "int", "v": "double"})
    return spark.table(name)


@query("drop_cols", f"SELECT k, s FROM {_OLD}")
def narrowed(spark, d):
    name = _stored(spark, d)
    T.drop_columns(spark, name, "v")
    return spark.table(name)


@query("modify_cols_type", f"SELECT CAST(k AS VARCHAR) AS k, CAST(trunc(v) AS BIGINT) AS v, s FROM {_OLD}")
def retyped(spark, d):
    name = _stored(spark, d)
    T.retype_columns(spark, name, {"k": "string", "v": "long"})
    return spark.table(name)


@query("change_cols_info", f"SELECT k AS id, v, s AS segment FROM {_OLD}")
def renamed(spark, d):
    name = _stored(spark, d)
    T.rename_columns(spark, name, {"k": "id", "s": "segment"})
    return spark.table(name)


@query("set_primary_key", "SELECT 'k' AS first, '' AS second")
def primary(spark, d):
    name = _stored(spark, d)
    T.set_key(spark, name, "k")
    first = T.primary_key(spark, name)
    T.drop_key(spark, name)
    return _facts(spark, first=",".join(first), second=",".join(T.primary_key(spark, name)))


@query("get_primary_keys", "SELECT 'k' AS name")
def primary_after(spark, d):
    """The key outlives a rewriting of the table."""
    name = _stored(spark, d)
    T.set_key(spark, name, "k")
    T.sink(_new(spark, d), name, "replace", "k")
    return _facts(spark, name=",".join(T.primary_key(spark, name)))


@query("set_uni_index", "SELECT 'by_k' AS name, 'k,s' AS cols")
def indexes(spark, d):
    name = _stored(spark, d)
    T.set_key(spark, name, ["k", "s"], "by_k")
    T.set_key(spark, name, ["k"], "other")
    T.drop_key(spark, name, "other")
    return spark.createDataFrame([(k, ",".join(v)) for k, v in T.unique_indexes(spark, name).items()], "name string, cols string")


@query("get_id_fields", "SELECT name FROM (VALUES ('k'), ('s')) x(name)")
def key_fields(spark, d):
    name = _stored(spark, d)
    T.set_key(spark, name, "k")
    T.set_key(spark, name, ["k", "s"], "by_k")
    return spark.createDataFrame([(c,) for c in T.key_columns(spark, name)], "name string")


def _parted(spark, d) -> str:
    name = _name(spark)
    T.create(spark, name, {"k": "long", "v": "double", "s": "string"}, by="s")
    T.sink(_old(spark, d), name, "insert", "k")
    return name


@query("get_split_tabel_info", f"SELECT DISTINCT 's=' || s AS partition FROM {_OLD}")
def parts(spark, d):
    return T.partitions(spark, _parted(spark, d))


@query("drop_table_split", f"SELECT * FROM {_OLD} WHERE s <> 'BUILDING'")
def part_dropped(spark, d):
    name = _parted(spark, d)
    T.drop_partitions(spark, name, "s = 'BUILDING'")
    return spark.table(name)


@query("cancel_split_table", f"SELECT * FROM {_OLD}")
def unparted(spark, d):
    name = _parted(spark, d)
    T.unpartition(spark, name)
    return spark.table(name)


_MOVED = "(SELECT c_custkey AS k, -c_acctbal AS v, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS s, c_nationkey AS w FROM customer WHERE c_custkey % 3 <> 0)"
_BOTH = f"FROM {_OLD} a FULL JOIN {_MOVED} b ON a.k = b.k"


def _moved(spark, d):
    segment = "CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS s"
    return table(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "-c_acctbal AS v", segment, "c_nationkey AS w")


_WINS = "CASE WHEN b.k IS NOT NULL THEN b.{0} ELSE a.{0} END AS {0}"
for _mode, _sql in (("replace", f"SELECT coalesce(a.k, b.k) AS k, {_WINS.format('v')}, {_WINS.format('s')}, w {_BOTH}"),
                    ("insert_ignore", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v, CASE WHEN a.k IS NOT NULL THEN a.s ELSE b.s END AS s, w {_BOTH}")):
    def _split(spark, d, mode=_mode):
        """Rows move between the partitions of a table; its partitioning and key stay."""
        name = _parted(spark, d)
        T.set_key(spark, name, "k")
        T.sink(_moved(spark, d), name, mode)
        assert T.partition_columns(spark, name) == ["s"] and T.primary_key(spark, name) == ["k"]
        return spark.table(name)

    query(f"df_to_sql_{_mode}_split", _sql)(_split)


@query("drop_data_by_where_str_split", f"SELECT * FROM {_OLD} WHERE NOT (v > 100 OR s = 'MACHINERY')")
def removed_parts(spark, d):
    name = _parted(spark, d)
    T.remove(spark, name, "v > 100 OR s = 'MACHINERY'")
    return spark.table(name)


def _database(spark, d) -> dict:
    """A database file in the shared folder that holds one side."""
    import os

    home = folder(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(home)
    connect = {"database": f"{home}/base.db", "timeout": 600}
    D.write(_old(spark, d).coalesce(2), "t", connect, keys="k")
    return connect


@query("get_data_database", f"SELECT k, s FROM {_OLD} WHERE v > 100")
def from_database(spark, d):
    return D.read(spark, "t", _database(spark, d), schema="k long, v double, s string", column="k", partitions=4).where("v > 100").select("k", "s")


for _mode, _sql in (("replace", _NEW_WINS), ("insert_ignore", _OLD_WINS.replace("s, w", "s, CASE WHEN a.k IS NULL THEN w END AS w"))):
    def _into(spark, d, mode=_mode):
        connect = _database(spark, d)
        D.write(_new(spark, d).coalesce(2), "t", connect, keys="k", sink=mode)
        return D.read(spark, "t", connect, schema="k long, v double, s string, w int", column="k", partitions=4)

    query(f"df_to_sql_database_{_mode}", _sql)(_into)
