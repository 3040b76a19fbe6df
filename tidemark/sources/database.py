"""Databases with a Python DB-API module as a Spark data source: partitioned reads, filters pushed down, upserting writes.

    spark.dataSource.register(Database)
    spark.read.format("dbapi").options(module="pymysql", connect='{"host": ..}', table="t", column="id", partitions=8).load()
    df.write.format("dbapi").options(module=.., connect=.., table="t", keys="id", sink="replace").mode("append").save()

Reading: with ``column`` the table is read in ``partitions`` stretches of that column, between ``lower`` and ``upper`` (its
least and largest value, if not given); rows below, above and without a value are in the first and last.  With the option
``push`` (:func:`read` sets it if ``spark.sql.python.filterPushdown.enabled`` is on) filters that a database answers as
Spark does, or less strictly, go into its WHERE clause, and Spark applies all of them again.

Writing: each task puts its rows into a table beside the target, marked with the attempt; when all tasks are done, one
transaction takes the rows of the attempts that counted into the target by ``sink`` and drops the table beside it.  A
failed job drops it only.  So a lost executor leaves no row twice, and readers see all of a write or nothing.

sink: insert (a key that comes twice is an error), replace (new rows win by key, in the columns they have), insert_ignore
(stored rows win).  ``mode("overwrite")`` empties the target first, in the same transaction.  Tables and columns that the
target lacks are made.  The module's connections must be able to reach the database from every executor; a SQLite file
has to be in a folder that they share.
"""

from __future__ import annotations

import importlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
                                    LessThan, LessThanOrEqual, WriterCommitMessage)

SINKS = ("insert", "replace", "insert_ignore")
#: How a module's ``paramstyle`` writes the n-th parameter.
MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s", "numeric": ":{}", "named": ":{}"}
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "DOUBLE PRECISION", "float": "DOUBLE PRECISION", "string": "TEXT", "date": "TEXT", "timestamp": "TEXT", "binary": "BLOB"}
TAKEN = "attempt_of_write"


def connection(options: dict):
    """A DB-API connection: ``connect`` holds the module's arguments as JSON."""
    return importlib.import_module(options.get("module", "sqlite3")).connect(**json.loads(options.get("connect", "{}")))


def _marks(options: dict, n: int, first: int = 1) -> list[str]:
    mark = MARKS[importlib.import_module(options.get("module", "sqlite3")).paramstyle]
    return [mark.format(first + k) for k in range(n)]


def _name(column: str) -> str:
    if '"' in column:
        raise ValueError(f"a name has quotes: {column}")
    return f'"{column}"'


def _run(options: dict, sql: str, values: tuple = ()) -> list[tuple]:
    held = connection(options)
    try:
        cursor = held.cursor()
        cursor.execute(sql, values)
        return cursor.fetchall() if cursor.description else []
    finally:
        held.close()


def _source(options: dict) -> str:
    return f"({options['query']}) q" if "query" in options else _name(options["table"])


def _to_spark(value, kind: T.DataType):
    """A value of the database as the column's type has it."""
    if value is None or isinstance(kind, (T.StringType, T.BinaryType)):
        return value if value is None or isinstance(kind, T.BinaryType) else str(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, T.TimestampType):
        return value if isinstance(value, datetime) else datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return value if isinstance(value, date) else date.fromisoformat(value[:10])
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else Decimal(str(value)) if isinstance(kind, T.DecimalType) else int(value)


def _to_database(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None  # few databases have them
    if isinstance(value, (date, datetime)):
        return value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    return str(value) if isinstance(value, Decimal) else int(value) if isinstance(value, bool) else bytes(value) if isinstance(value, bytearray) else value


class Database(DataSource):
    """The data source ``dbapi``."""

    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def schema(self) -> str:
        """Types of the first rows' values; give a schema where that is not enough."""
        options = dict(self.options)
        held = connection(options)
        try:
            cursor = held.cursor()
            cursor.execute(f"SELECT * FROM {_source(options)}")
            names, rows = [c[0] for c in cursor.description], cursor.fetchmany(1000)
        finally:
            held.close()
        kinds = []
        for k in range(len(names)):
            found = {type(r[k]) for r in rows if r[k] is not None}
            kinds.append("bigint" if found == {int} else "double" if found and found <= {int, float} else "binary" if found == {bytes} else "string")
        return ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds))

    def reader(self, schema: T.StructType) -> Reader:
        return (FilteredReader if self.options.get("push") == "true" else Reader)(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


@dataclass
class Stretch(InputPartition):
    where: str
    values: tuple


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.columns, self.pushed = options, schema, []

    def partitions(self) -> list[Stretch]:
        column, n = self.options.get("column"), int(self.options.get("partitions", 1))
        if not column or n < 2:
            return [Stretch("", ())]
        low, high = self.options.get("lower"), self.options.get("upper")
        if low is None or high is None:
            least, largest = _run(self.options, f"SELECT min({_name(column)}), max({_name(column)}) FROM {_source(self.options)}")[0]
            low, high = least if low is None else low, largest if high is None else high
        if low is None:
            return [Stretch("", ())]
        low, high = float(low), float(high)
        cuts = sorted({low + (high - low) * k / n for k in range(1, n)})
        held = _name(column)
        return [Stretch(f"({held} < {{}} OR {held} IS NULL)", (cuts[0],)), *[Stretch(f"{held} >= {{}} AND {held} < {{}}", pair) for pair in zip(cuts, cuts[1:])], Stretch(f"{held} >= {{}}", (cuts[-1],))]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        parts = [(w, v) for w, v in [(partition.where, partition.values), *self.pushed] if w]
        values = tuple(x for _, v in parts for x in v)
        where = " AND ".join(w for w, _ in parts).format(*_marks(self.options, len(values)))
        kinds = [f.dataType for f in self.columns.fields]
        held = connection(self.options)
        try:
            cursor = held.cursor()
            cursor.execute(f"SELECT {', '.join(_name(f.name) for f in self.columns.fields)} FROM {_source(self.options)}" + (f" WHERE {where}" if where else ""), values)
            while rows := cursor.fetchmany(10_000):
                for row in rows:
                    yield tuple(map(_to_spark, row, kinds))
        finally:
            held.close()


class FilteredReader(Reader):
    COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters):
        """Take equality, order of numbers, membership and nullness; databases may compare texts more loosely, so all are left to Spark too."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) != 1:
                continue
            name, value = _name(column[0]), getattr(f, "value", None)
            number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
            if type(f) in self.COMPARED and (number or isinstance(value, str) and type(f) is EqualTo):
                self.pushed.append((f"{name} {self.COMPARED[type(f)]} {{}}", (value,)))
            elif isinstance(f, In) and value and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in value):
                self.pushed.append((f"{name} IN ({', '.join(['{}'] * len(value))})", tuple(value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.pushed.append((f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", ()))
        return filters


@dataclass
class Attempt(WriterCommitMessage):
    attempt: str


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.kinds = {f.name: KINDS.get(f.dataType.simpleString(), "DECIMAL" if isinstance(f.dataType, T.DecimalType) else None) for f in schema.fields}
        self.keys, self.sink = [k for k in options.get("keys", "").split(",") if k], options.get("sink", "insert")
        if self.sink not in SINKS or None in self.kinds.values():
            raise ValueError(f"sink must be one of {SINKS}, and columns must be numbers, texts, dates or bytes")
        if not set(self.keys) <= set(self.kinds) or self.sink != "insert" and not self.keys:
            raise ValueError("keys must be columns of the rows")
        self.beside = f"{options['table']}_{uuid.uuid4().hex}"

    def _make(self, cursor, table: str, *more: str) -> None:
        columns = [f"{_name(c)} {k}" for c, k in self.kinds.items()]
        cursor.execute(f"CREATE TABLE IF NOT EXISTS {_name(table)} ({', '.join([*columns, *more])})")

    def _index(self, held) -> None:
        """An index on the keys of the table beside the target, so that a target's row finds its new row without reading all."""
        if not self.keys:
            return
        try:
            held.cursor().execute(f"CREATE INDEX {_name(f'{self.beside}_keys')} ON {_name(self.beside)} ({', '.join(map(_name, self.keys))})")
            held.commit()
        except importlib.import_module(self.options.get("module", "sqlite3")).Error:
            held.rollback()  # some databases have no index on texts of any length; the sinks do without, slower

    def write(self, iterator) -> Attempt:
        attempt, held = uuid.uuid4().hex, connection(self.options)
        try:
            cursor = held.cursor()
            self._make(cursor, self.beside, f"{TAKEN} TEXT")
            held.commit()
            insert = f"INSERT INTO {_name(self.beside)} VALUES ({', '.join(_marks(self.options, len(self.kinds) + 1))})"
            some = []
            for row in iterator:
                some.append((*map(_to_database, row), attempt))
                if len(some) == 10_000:
                    cursor.executemany(insert, some)
                    some = []
            if some:
                cursor.executemany(insert, some)
            held.commit()
        finally:
            held.close()
        return Attempt(attempt)

    def commit(self, messages) -> None:
        attempts = [m.attempt for m in messages if m is not None]
        target, beside, columns = _name(self.options["table"]), _name(self.beside), ", ".join(map(_name, self.kinds))
        held = connection(self.options)
        try:
            cursor = held.cursor()
            self._make(cursor, self.options["table"])
            self._make(cursor, self.beside, f"{TAKEN} TEXT")  # a job without tasks has none
            cursor.execute(f"SELECT * FROM {target} WHERE 1 = 0")
            stored = [c[0] for c in cursor.description]
            for c in [c for c in self.kinds if c not in stored]:
                cursor.execute(f"ALTER TABLE {target} ADD COLUMN {_name(c)} {self.kinds[c]}")
            held.commit()
            self._index(held)
            cursor.execute(f"SELECT DISTINCT {TAKEN} FROM {beside}")
            for (left,) in [r for r in cursor.fetchall() if r[0] not in attempts]:
                cursor.execute(f"DELETE FROM {beside} WHERE {TAKEN} = {_marks(self.options, 1)[0]}", (left,))
            same = " AND ".join(f"b.{_name(k)} = {target}.{_name(k)}" for k in self.keys)
            if self.overwrite:
                cursor.execute(f"DELETE FROM {target}")
            if self.keys:
                listed = ", ".join(map(_name, self.keys))
                cursor.execute(f"SELECT count(*) FROM (SELECT {listed} FROM {beside} GROUP BY {listed} HAVING count(*) > 1) r")
                twice = cursor.fetchone()[0]
                if self.sink == "insert" and not twice:
                    cursor.execute(f"SELECT count(*) FROM {target} WHERE EXISTS (SELECT 1 FROM {beside} b WHERE {same})")
                    twice = cursor.fetchone()[0]
                if twice:
                    raise ValueError(f"a key of {self.keys} comes twice")
            rest = [c for c in self.kinds if c not in self.keys]
            if self.sink == "replace" and rest:
                sets = ", ".join(f"{_name(c)} = (SELECT b.{_name(c)} FROM {beside} b WHERE {same})" for c in rest)
                cursor.execute(f"UPDATE {target} SET {sets} WHERE EXISTS (SELECT 1 FROM {beside} b WHERE {same})")
            # a join, for which databases sort or hash a target without an index once; NOT EXISTS may read it for each row
            fresh = f" LEFT JOIN {target} ON {same} WHERE {target}.{_name(self.keys[0])} IS NULL" if self.keys else ""
            cursor.execute(f"INSERT INTO {target} ({columns}) SELECT {', '.join(f'b.{_name(c)}' for c in self.kinds)} FROM {beside} b{fresh}")
            held.commit()
        except BaseException:
            held.rollback()
            raise
        finally:
            held.close()
        self.abort(messages)

    def abort(self, messages) -> None:
        held = connection(self.options)
        try:
            held.cursor().execute(f"DROP TABLE IF EXISTS {_name(self.beside)}")
            held.commit()
        finally:
            held.close()


def read(spark: SparkSession, table: str, connect: dict, module: str = "sqlite3", schema: str | None = None, **options) -> DataFrame:
    """A table of a database; options: query, column, partitions, lower, upper."""
    spark.dataSource.register(Database)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("dbapi").options(table=table, connect=json.dumps(connect), module=module, push=push, **options)
    return (reader.schema(schema) if schema else reader).load()


def write(df: DataFrame, table: str, connect: dict, module: str = "sqlite3", keys=(), sink: str = "insert", overwrite: bool = False) -> None:
    """Store rows in a table of a database by ``sink``."""
    df.sparkSession.dataSource.register(Database)
    writer = df.write.format("dbapi").options(table=table, connect=json.dumps(connect), module=module, keys=",".join([keys] if isinstance(keys, str) else keys), sink=sink)
    writer.mode("overwrite" if overwrite else "append").save()
