"""Queries through files and text; each writes into the shared folder and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files
from .registry import query, table


def folder(spark) -> str:
    """A new folder in the one that driver and executors share."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-files-")
    return f"{root}/files-{uuid.uuid4().hex}"


for _kind in ("csv", "json", "orc", "parquet"):
    def _round_trip(spark, d, kind=_kind):
        df, path = table(spark, d, "supplier"), folder(spark)
        files.save(df, path, kind)
        return files.load(spark, path, kind, schema=df.schema)

    query({"csv": "load_csv", "json": "load_json", "orc": "load_dfs_pd", "parquet": "df2file_pd"}[_kind], "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(_round_trip)


@query("cut_dffile_by_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def by_year(spark, d):
    path = folder(spark)
    files.save_by_year(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate", "parquet")
    return spark.read.parquet(path).select("o_orderkey", "year")


@query("cut_dffile_by_maxline", "SELECT o_orderkey FROM orders")
def by_rows(spark, d):
    path = folder(spark)
    files.save(table(spark, d, "orders").select("o_orderkey"), path, "parquet", max_rows=1000)
    return files.load(spark, path, "parquet")


@query("archive_df", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
def archive(spark, d):
    path, c = folder(spark), table(spark, d, "customer")
    files.archive(spark, c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_acctbal AS v"), path, "k")
    return files.archive(spark, c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS k", "-c_acctbal AS v"), path, "k")


@query("find_files_include_str", "SELECT page_id FROM pages WHERE contains(html, '<title>')")
def find(spark, d):
    return files.find_lines(table(spark, d, "pages").selectExpr("page_id", "html AS value"), "<title>").select("page_id")


@query("replace_str_in_file", "SELECT page_id, md5(replace(html, '<p>', '<div>')) AS digest FROM pages")
def replace(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(files.replace_text(F.col("html"), "<p>", "<div>")).alias("digest"))


@query("get_csv_df_colmaxmin", "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def bounds(spark, d):
    return files.column_bounds(table(spark, d, "orders"), "o_totalprice")


_S = "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier"


def _suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name")


@query("load_text", _S)
def load_text(spark, d):
    path = folder(spark)
    files.save(_suppliers(spark, d), path, "csv", sep="|")
    return files.load_text(spark, path, "|")


@query("load_text_multi", "SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer")
def load_texts(spark, d):
    one, two = folder(spark), folder(spark)
    files.save(_suppliers(spark, d), one, "csv")
    files.save(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("s_name")), two, "csv")
    return files.load_text(spark, [one, two], drop_first_col=True)


@query("read_lines", "SELECT s_name AS value FROM supplier")
def read_lines(spark, d):
    path = folder(spark)
    files.save_lines(_suppliers(spark, d).select(F.col("s_name").alias("value")), path)
    return files.lines(spark, path).select("value")


@query("write_txt", "SELECT upper(s_name) AS value FROM supplier")
def write_lines(spark, d):
    path = folder(spark)
    files.save_lines(_suppliers(spark, d).select(F.upper("s_name").alias("value")), path)
    return files.lines(spark, path).select("value")


@query("write_json", "SELECT s_suppkey, s_name FROM supplier")
def write_json(spark, d):
    path = folder(spark)
    files.save(_suppliers(spark, d), path, "jsonl")
    return files.load(spark, path, "jsonl", schema="s_suppkey long, s_name string")


@query("load_csvs", "SELECT k, max(v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY k")
def load_csvs(spark, d):
    one, two, c = folder(spark), folder(spark), table(spark, d, "customer")
    files.save(c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_acctbal AS v"), one, "csv")
    files.save(c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS k", "c_acctbal + 1 AS v"), two, "csv")
    df = files.load(spark, [one, two], "csv", schema="k long, v double").withColumn("neg", -F.col("v"))
    return df.groupBy("k").agg(F.min_by("v", "neg").alias("v"))


@query("load_csvs_dir", "SELECT c_custkey AS k, c_nationkey AS n FROM customer")
def load_csvs_dir(spark, d):
    path = folder(spark)
    files.save(table(spark, d, "customer").selectExpr("c_custkey AS k", "c_nationkey AS n"), path, "csv")
    return files.load_sorted(spark, f"{path}/*.csv", by="k", unique="k", kind="csv", schema="k long, n int")


@query("cut_csv_by_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def csv_by_year(spark, d):
    path = folder(spark)
    files.save_by_year(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate", "csv")
    return files.load(spark, path, "csv", schema="o_orderkey long, o_orderdate timestamp, year int").select("o_orderkey", "year")


@query("cut_bigdffile_by_maxline", "SELECT TRUE AS good, count(*) AS n FROM orders")
def rows_a_file(spark, d):
    """No file has more rows than asked for, and none is lost."""
    path = folder(spark)
    files.save(table(spark, d, "orders").select("o_orderkey"), path, "csv", max_rows=500)
    sizes = files.load(spark, path, "csv", schema="o_orderkey long", mark="file").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") <= 500).alias("good"), F.sum("n").alias("n"))


@query("process_df_pd_big", "SELECT event_id, round(value * 2 + 1, 6) AS v FROM events")
def batches(spark, d):
    def double(frame):
        return frame.assign(v=frame["value"] * 2 + 1)[["event_id", "v"]]

    return files.per_batch(table(spark, d, "events").select("event_id", "value"), double, "event_id long, v double").withColumn("v", F.round("v", 6))


@query("archive_data", "SELECT k, max(v) AS v FROM (SELECT c_custkey % 100 AS k, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey % 100, -c_acctbal FROM customer) GROUP BY k")
def archived(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey % 100 AS k", "c_acctbal AS v")
    return files.merged(old, old.selectExpr("k", "-v AS v"), "k", "v").select("k", "v")


def _files(spark, d):
    path = folder(spark)
    for k in range(3):
        files.save(_suppliers(spark, d).where(F.col("s_suppkey") % 3 == k).coalesce(1), f"{path}/part{k}", "csv")
    return path


@query("get_all_paths", "SELECT k AS folder FROM (VALUES ('part0'), ('part1'), ('part2')) t(k)")
def paths(spark, d):
    found = files.file_info(spark, _files(spark, d), "*.csv")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"))


@query("get_files_info_dir", "SELECT 3 AS n, TRUE AS filled, TRUE AS dated")
def files_of(spark, d):
    found = files.file_info(spark, _files(spark, d), "*.csv")
    return found.agg(F.count(F.lit(1)).cast("int").alias("n"), (F.min("length") > 0).alias("filled"), (F.min("modified") > "2000-01-01").alias("dated"))


@query("get_files_info", "SELECT 2 AS n")
def files_info(spark, d):
    path = _files(spark, d)
    return files.file_info(spark, [f"{path}/part0", f"{path}/part2"], "*.csv").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("find_dir_include_str", "SELECT count(*) AS n FROM supplier WHERE contains(s_name, '7')")
def find_in_folder(spark, d):
    found = files.find_lines(files.lines(spark, f"{_files(spark, d)}/*"), '[^,]*,.*7', regex=True)
    return found.agg(F.count(F.lit(1)).alias("n"))


@query("get_file_info", "SELECT 1 AS n, TRUE AS filled")
def one_file(spark, d):
    path = f"{_files(spark, d)}/part1"
    return files.file_info(spark, path, "*.csv").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.min("length") > 0).alias("filled"))


@query("replace_str_in_files", "SELECT replace(s_name, '#', '-') AS value FROM supplier")
def replace_in_files(spark, d):
    path = folder(spark)
    for k in range(2):
        files.save_lines(_suppliers(spark, d).where(F.col("s_suppkey") % 2 == k).select(F.col("s_name").alias("value")), f"{path}/old{k}")
    new = files.lines(spark, [f"{path}/old0", f"{path}/old1"]).select(files.replace_text(F.col("value"), "#", "-").alias("value"))
    files.save_lines(new, f"{path}/new")
    return files.lines(spark, f"{path}/new").select("value")


@query("load_df_pd", "SELECT kind, s_suppkey AS k, s_name AS name FROM supplier, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) t(kind)")
def every_format(spark, d):
    path, rows = folder(spark), _suppliers(spark, d).selectExpr("s_suppkey AS k", "s_name AS name")
    done = []
    for kind in ("csv", "json", "orc", "parquet"):
        files.save(rows, f"{path}/t.{kind}")
        done.append(files.load(spark, f"{path}/t.{kind}", schema="k long, name string").withColumn("kind", F.lit(kind)))
    return done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3])
