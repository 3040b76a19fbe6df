"""Scans and sinks by file format, text search, and upserts into stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import upsert, upsert_rows
from ..operators.order import names

FORMATS = {"csv": "csv", "txt": "text", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "xml": "xml"}

#: What gives back the texts that were written, quotes, line ends and outer blanks included.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _format(path: str, kind: str | None) -> str:
    ending = (kind or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ending not in FORMATS:
        raise ValueError(f"no reader or writer for {ending!r}")
    return FORMATS[ending]


def load(spark: SparkSession, paths, kind: str | None = None, schema=None, mark: str | None = None, keep_unnamed: bool = False, **options) -> DataFrame:
    """One or several files or folders of one format; ``mark`` adds each row's file. Give a schema to save a pass."""
    paths = names(paths)
    form = _format(paths[0], kind)
    reader = spark.read.format(form)
    if form == "csv":
        reader = reader.options(multiLine=True, **CSV)
    reader = reader.options(**options)
    df = (reader.schema(schema) if schema else reader).load(paths)
    if not keep_unnamed:
        df = df.drop(*[c for c in df.columns if c.lower().startswith(("unnamed:", "_c0")) and form == "csv"])
    return df.withColumn(mark, F.input_file_name()) if mark else df


def load_sorted(spark: SparkSession, paths, by=None, unique=None, **options) -> DataFrame:
    """Files as one frame without repeats in ``unique`` (the first in order of ``by`` stays), in order of ``by``."""
    df = load(spark, paths, **options)
    if unique:
        rest = [c for c in df.columns if c not in names(unique)]
        first = F.min_by(F.struct(*rest), F.struct(*(names(by) or rest))).alias("__r")
        df = df.groupBy(*names(unique)).agg(first).select(*names(unique), *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(df.columns)
    return df.orderBy(*names(by)) if by else df


def save(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite", by=None, max_rows: int | None = None, **options) -> None:
    """Write by format; ``by`` partitions by columns, ``max_rows`` limits the rows of a file."""
    form = _format(path, kind)
    writer = df.write.mode(mode).format(form).options(**(CSV if form == "csv" else {}), **options)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    (writer.partitionBy(*names(by)) if by else writer).save(path)


def save_by_year(df: DataFrame, path: str, date: str, kind: str | None = None, **options) -> None:
    """A folder for each year of ``date``; rows meet by year and a salt, so one long year is written by several tasks."""
    salted = df.withColumn("year", F.year(date))
    spread = salted.repartition("year", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    save(spread, path, kind, by="year", **options)


def lines(spark: SparkSession, paths) -> DataFrame:
    """(file, value): the lines of text files."""
    return spark.read.text(names(paths)).select(F.input_file_name().alias("file"), "value")


def load_text(spark: SparkSession, paths, sep: str = ",", header: bool = True, drop_first_col: bool = False, drop_last_col: bool = False) -> DataFrame:
    """Delimited text as strings, as it stands; ``header``: the first line names the columns, else they are _c0, _c1, ..."""
    df = spark.read.options(**{**CSV, "header": header}).csv(names(paths), sep=sep)
    cols = df.columns[1 if drop_first_col else 0 : -1 if drop_last_col else None]
    return df.select(*[f"`{c}`" for c in cols])


def save_lines(text: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one text column of ``text`` as lines."""
    text.write.mode(mode).text(path)


def file_info(spark: SparkSession, paths, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, length, modified) of files; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(names(paths))
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def per_batch(df: DataFrame, func, schema: str) -> DataFrame:
    """A Python function on pandas frames of some thousand rows each, wherever they are."""

    def run(frames):
        for frame in frames:
            yield func(frame)

    return df.mapInPandas(run, schema)


def merged(old: DataFrame, new: DataFrame, unique, by, keep: str = "last") -> DataFrame:
    """Both frames' rows, of rows equal in ``unique`` the first or last in order of ``by``."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in names(unique)]
    pick = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), F.struct(*names(by)))
    return both.groupBy(*names(unique)).agg(pick.alias("__r")).select(*names(unique), *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def find_lines(text: DataFrame, target: str, regex: bool = False, all_hits: bool = True) -> DataFrame:
    """(file, value): lines that hold the text or match the pattern; one a file, if not ``all_hits``."""
    hits = text.where(F.col("value").rlike(target) if regex else F.contains("value", F.lit(target)))
    return hits if all_hits else hits.groupBy("file").agg(F.min("value").alias("value"))


def replace_text(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def column_bounds(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("least"), F.max(col).alias("most"))


def archive(spark: SparkSession, new: DataFrame, path: str, keys=None, keep: str = "new", kind: str = "parquet") -> DataFrame:
    """The stored rows and the new ones by key, written over the stored ones; the first call stores the new rows.

    The union is written beside the old folder and takes its place by a rename, so readers never see half of it.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    at = jvm_path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        save(new, path, kind, "errorifexists")
        return load(spark, path, kind)
    old = load(spark, path, kind)
    both = upsert(old, new, keys, keep) if keys else upsert_rows(old, new, keep=keep)
    beside, aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    save(both, beside, kind, "errorifexists")
    if not fs.rename(at, jvm_path(aside)):
        raise OSError(f"{path} could not be renamed; the union is in {beside}")
    if not fs.rename(jvm_path(beside), at):
        fs.rename(jvm_path(aside), at)
        raise OSError(f"{beside} could not be renamed to {path}")
    fs.delete(jvm_path(aside), True)
    return load(spark, path, kind)
