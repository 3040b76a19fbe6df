"""Catalog tables as a store: queries, structure, and the sink modes of a database table.

Sinks keep a table's partitioning and its noted keys, and of a partitioned table they rewrite only the partitions in
which a row can change: those that hold a key of the new rows, and those the new rows go to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import upsert
from ..operators.order import names

MODES = ("new", "ignore_table", "insert", "replace", "insert_ignore", "insert_new_columns", "insert_ignore_new_columns")


def execute(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """The stored tables; views of the session are none."""
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def has(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def fields(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return spark.table(table).dtypes


def get(spark: SparkSession, table: str, cols=None, where: str | None = None, limit: int | None = None) -> DataFrame:
    df = spark.table(table)
    df = df.where(where) if where else df
    df = df.select(*names(cols)) if cols else df
    return df if limit is None else df.limit(limit)


def values(spark: SparkSession, table: str, col: str) -> DataFrame:
    return spark.table(table).select(col).distinct()


def copy(spark: SparkSession, table: str, target: str, data: bool = False) -> None:
    source = spark.table(table)
    (source if data else source.limit(0)).write.saveAsTable(target)


def create(spark: SparkSession, table: str, columns: dict[str, str], keys=None, by=None) -> None:
    """An empty table of (name: type), with its keys noted and partitioned by ``by``."""
    made = ", ".join(f"`{c}` {k}" for c, k in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({made}) USING parquet" + (f" PARTITIONED BY ({', '.join(names(by))})" if by else ""))
    if keys:
        set_key(spark, table, keys)


def create_database(spark: SparkSession, database: str, folder: str | None = None) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{folder}'" if folder else ""))


def drop_database(spark: SparkSession, database: str) -> None:
    """The database with all its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def database(spark: SparkSession) -> str:
    return spark.catalog.currentDatabase()


def folder(spark: SparkSession, table: str) -> str:
    """Where the table's files are."""
    return next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Location")


def _provider(spark: SparkSession, table: str) -> str:
    return next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Provider")


def column_info(spark: SparkSession, table: str) -> DataFrame:
    """(place, name, type) of the columns."""
    return spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(fields(spark, table))], "place int, name string, type string")


# ---- keys: notes on a table that the sinks go by, as Spark's tables have none


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key.startswith("keys.")}


def _note(spark: SparkSession, table: str, properties: dict[str, str]) -> None:
    if properties:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")")


def set_key(spark: SparkSession, table: str, cols, index: str | None = None) -> None:
    """Note the primary key, or a unique index by name; rows that repeat it or lack it are an error."""
    rows = spark.table(table).select(*names(cols))
    missing = rows.where(" OR ".join(f"`{c}` IS NULL" for c in names(cols)))
    if not rows.groupBy(*names(cols)).count().where("count > 1").isEmpty() or (index is None and not missing.isEmpty()):
        raise ValueError("the columns are no key")
    _note(spark, table, {f"keys.{f'unique.{index}' if index else 'primary'}": ",".join(names(cols))})


def primary_key(spark: SparkSession, table: str) -> list[str]:
    return [c for c in _properties(spark, table).get("keys.primary", "").split(",") if c]


def unique_indexes(spark: SparkSession, table: str) -> dict[str, list[str]]:
    return {k[len("keys.unique.") :]: v.split(",") for k, v in _properties(spark, table).items() if k.startswith("keys.unique.")}


def key_columns(spark: SparkSession, table: str) -> list[str]:
    """Columns of the primary key and of all unique indexes."""
    return list(dict.fromkeys([*primary_key(spark, table), *(c for cols in unique_indexes(spark, table).values() for c in cols)]))


def drop_key(spark: SparkSession, table: str, index: str | None = None) -> None:
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('keys.{f'unique.{index}' if index else 'primary'}')")


# ---- columns


def add_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> None:
    """Columns that the table lacks, null in its rows; no row is rewritten."""
    new = {c: k for c, k in columns.items() if c not in spark.table(table).columns}
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS (" + ", ".join(f"`{c}` {k}" for c, k in new.items()) + ")")


def drop_columns(spark: SparkSession, table: str, cols) -> None:
    _rewrite(spark, table, spark.table(table).drop(*names(cols)))


def retype_columns(spark: SparkSession, table: str, kinds: dict[str, str]) -> None:
    """Other types for columns; values that the new type cannot hold become null."""
    _rewrite(spark, table, spark.table(table).withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items()}))


def rename_columns(spark: SparkSession, table: str, new: dict[str, str]) -> None:
    """Other names for columns, in noted keys and in the partitioning too."""
    noted = {k: ",".join(new.get(c, c) for c in v.split(",")) for k, v in _properties(spark, table).items()}
    _rewrite(spark, table, spark.table(table).withColumnsRenamed(new), [new.get(c, c) for c in partition_columns(spark, table)], noted)


# ---- partitions


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def partitions(spark: SparkSession, table: str) -> DataFrame:
    """(partition) of a partitioned table."""
    return spark.sql(f"SHOW PARTITIONS {table}")


def drop_partitions(spark: SparkSession, table: str, condition: str) -> None:
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({condition})")


def unpartition(spark: SparkSession, table: str) -> None:
    """The same rows in a table without partitions."""
    _rewrite(spark, table, spark.table(table), [])


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def clear(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")


def info(spark: SparkSession, table: str) -> DataFrame:
    """(rows, columns)."""
    df = spark.table(table)
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def prepared(df: DataFrame, upper: bool = True, infinite=None) -> DataFrame:
    """Names in capitals; NaN as null and infinite numbers as ``infinite``."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        x = F.col(c)
        if kinds[c] in ("double", "float"):
            x = F.when(F.isnan(x), None).when(F.abs(x) == float("inf"), F.lit(infinite).cast(kinds[c])).otherwise(x)
        out.append(x.alias(c.upper() if upper else c))
    return df.select(*out)


def _rewrite(spark: SparkSession, table: str, df: DataFrame, by: list[str] | None = None, noted: dict[str, str] | None = None) -> None:
    """Store a frame that reads the table in its place, partitioned as before or by ``by``.

    It is written beside the table first; then the old one is renamed aside, the new one takes its name, and only then
    the old one goes, so the rows are never in no table.  A table whose partitions are known by their folders is not
    renamed, as they would go by their old ones: it goes first, while the rows are in the table beside.  Noted keys stay if
    their columns do.
    """
    by = [c for c in partition_columns(spark, table) if c in df.columns] if by is None else by
    noted, mark = _properties(spark, table) if noted is None else noted, uuid.uuid4().hex
    noted = {k: v for k, v in noted.items() if set(v.split(",")) <= set(df.columns)}
    home, _, own = table.rpartition(".")
    home = f"{home}." if home else ""
    beside, aside = f"{home}{own}_new_{mark}", f"{home}{own}_old_{mark}"
    if by:
        df.limit(0).write.partitionBy(*by).saveAsTable(beside)
        df.write.mode("append").partitionBy(*by).format(_provider(spark, beside)).save(folder(spark, beside))
    else:
        df.write.saveAsTable(beside)
    _note(spark, beside, noted)
    parted = bool(partition_columns(spark, table))
    spark.sql(f"DROP TABLE {table}" if parted else f"ALTER TABLE {table} RENAME TO {aside}")
    spark.sql(f"ALTER TABLE {beside} RENAME TO {table}")
    if by:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    if not parted:
        spark.sql(f"DROP TABLE {aside}")


#: Up to so many partitions are read by a condition, which prunes; more by a join.
LISTED = 200


def _within(old: DataFrame, by: list[str], found: list[tuple]) -> DataFrame:
    """The rows of the partitions ``found``; a table's partitions are listed on the driver by the catalog as well."""
    if len(found) <= LISTED:
        one = lambda values: reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, values)])
        return old.where(reduce(Column.__or__, map(one, found), F.lit(False)))
    schema = old.select(*[F.col(c).alias(f"__{c}") for c in by]).schema
    listed = old.sparkSession.createDataFrame(found, schema)
    return old.join(F.broadcast(listed), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left_semi")


def _rewrite_partitions(spark: SparkSession, table: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Store ``change`` of the rows of the ``touched`` partitions in their place; files of other partitions stay.

    The rows are written beside the table first; then the partitions they belong to are exchanged, and partitions without
    rows now go last: stopped in between, some rows are in their old and their new partition until the sink runs again.
    """
    by, old = partition_columns(spark, table), spark.table(table)
    found = [tuple(r) for r in touched.select(*by).distinct().collect()]
    if not found:
        return
    home, _, own = table.rpartition(".")
    beside = f"{home}.{own}_new_{uuid.uuid4().hex}" if home else f"{own}_new_{uuid.uuid4().hex}"
    change(_within(old, by, found)).select(*old.columns).write.partitionBy(*by).saveAsTable(beside)
    made = spark.table(beside)
    filled = {tuple(r) for r in made.select(*by).distinct().collect()}
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(_provider(spark, table)).save(folder(spark, table))
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    for values in found:
        if values not in filled:
            spec = ", ".join(f"`{c}` = " + ("NULL" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'") for c, v in zip(by, values))
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(table)
    spark.sql(f"DROP TABLE {beside}")


def _update(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Store ``change`` of the table, which differs from it only at the keys of ``rows``."""
    by, old = partition_columns(spark, table), spark.table(table)
    fresh = {c: k for c, k in change(old).dtypes if c not in old.columns}
    if not by or not set(by) <= set(rows.columns):
        _rewrite(spark, table, change(old))
        return
    add_columns(spark, table, fresh)
    held = spark.table(table).join(rows.select(*keys), keys, "left_semi").select(*by)
    _rewrite_partitions(spark, table, held.union(rows.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in by])), lambda part: change(part.select(*old.columns)))


def remove(spark: SparkSession, table: str, where: str) -> None:
    """Delete rows; null conditions keep them."""
    by, old = partition_columns(spark, table), spark.table(table)
    if by:
        _rewrite_partitions(spark, table, old.where(where).select(*by), lambda part: part.where(f"NOT coalesce({where}, false)"))
    else:
        _rewrite(spark, table, old.where(f"NOT coalesce({where}, false)"))


def _check_keys(df: DataFrame, keys: list[str], stored: DataFrame | None = None, primary: bool = False) -> None:
    """Rows of ``df`` must not repeat a key, nor have one that is stored already, nor lack a primary one."""
    some = df.select(*keys).where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    if not some.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"new rows repeat a key of {keys}")
    if stored is not None and not stored.join(some, keys, "left_semi").isEmpty():
        raise ValueError(f"a key of {keys} is stored already")
    if primary and not df.where(" OR ".join(f"`{c}` IS NULL" for c in keys)).isEmpty():
        raise ValueError(f"new rows lack {keys}")


def sink(df: DataFrame, table: str, mode: str = "replace", keys=None) -> None:
    """Store rows in a table.

    new: the table starts anew; ignore_table: nothing, if it exists; insert: append (no key may come twice);
    replace: new rows win by key; insert_ignore: stored rows win; the new_columns modes fill only columns the table
    lacks, for keys it has (and insert other keys).  Columns that the table lacks are added.

    Without ``keys`` the noted primary key counts, or else the first noted unique index; without any of them rows are
    inserted.  New rows that repeat a key are an error; inserting holds all noted keys.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = df.sparkSession
    if not has(spark, table):
        if keys:
            _check_keys(df, names(keys))
        df.write.saveAsTable(table)
        return
    if mode == "ignore_table":
        return
    if mode == "new":
        _rewrite(spark, table, df)
        return
    old, noted = spark.table(table), [primary_key(spark, table), *unique_indexes(spark, table).values()]
    keys = names(keys) or next((k for k in noted if k), [])
    if mode == "insert" or not keys:
        for n, held in enumerate([*noted, keys]):
            if held and set(held) <= set(df.columns):
                _check_keys(df, held, old, n == 0)
            elif n == 0 and held:
                raise ValueError(f"new rows lack {held}")
        add_columns(spark, table, {c: k for c, k in df.dtypes if c not in old.columns})
        wide = spark.table(table).dtypes
        df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in wide]).write.insertInto(table)
        return
    _check_keys(df, keys)
    if mode in ("replace", "insert_ignore"):
        _update(spark, table, df, keys, lambda part: upsert(part, df, keys, "new" if mode == "replace" else "old"))
        return
    fresh = [c for c in df.columns if c not in old.columns]
    rows = df.join(old.select(*keys).distinct(), keys, "left_semi").select(*keys, *fresh) if mode == "insert_new_columns" else df
    _update(spark, table, rows, keys, lambda part: upsert(part, rows, keys, "old"))


def replace_rows(df: DataFrame, table: str, keys) -> None:
    """Stored rows with a new row's key go whole, also what the new row has no columns for; then the new rows are added."""
    keys = names(keys)
    _check_keys(df, keys)
    _update(df.sparkSession, table, df, keys, lambda part: part.join(df.select(*keys), keys, "left_anti").select(*part.columns).unionByName(df, allowMissingColumns=True))


def merge(spark: SparkSession, table: str, source: DataFrame, keys, cols, keep: str = "source") -> None:
    """Rows with a stored key set its ``cols`` (unless ``keep`` is "target"), others are inserted with keys and ``cols``."""
    keys, old = names(keys), spark.table(table)
    part = source.select(*keys, *names(cols))
    _check_keys(part, keys)
    _update(spark, table, part, keys, lambda held: upsert(held, part, keys, "new" if keep == "source" else "old").select(*old.columns))
