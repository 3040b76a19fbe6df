"""What the corpus operators share: the shared folder, lineage cuts, column names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder, for what is read more than once.

    ``drop`` deletes one of them; results may read the others until the application ends, which deletes what is left.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str, besides: tuple[str, ...] = ()) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` and none of ``besides`` has, in any case of letters."""
    taken = {c.lower() for c in (*df.columns, *besides)}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *new: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns named like one of ``new``, in any case, renamed to ``<name>_in``; its names, old to now."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in new}]
    free = dict(zip(clash, free_names(df, *[f"{c}_in" for c in clash], besides=new)))
    names = {c: free.get(c, c) for c in df.columns}
    return df.withColumnsRenamed(free), names


def pinned(df: DataFrame) -> DataFrame:
    """``df``, which is split over tasks in the same way whenever it is read, if it is a written table.

    How a table is split depends on the number of cores, which changes as executors are lost, unless
    ``spark.sql.files.minPartitionNum`` is set; so that is set here to what it is now, if it is not yet.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(df.sparkSession.sparkContext.defaultParallelism))
    return df


def _is_table(df: DataFrame) -> bool:
    """Whether the rows come from written files as they are, through selections and filters at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.children().isEmpty() and node.nodeName().startswith("Relation") or node.getClass().getSimpleName() == "LogicalRelation"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's place in it as a long, the same in every reading.

    A frame that is no written table would be computed for each reading, with other places after a shuffle: it is written first.
    """
    held = df if _is_table(df) else Scratch(df.sparkSession).put(df, "rows")
    return pinned(held).withColumn(name, F.monotonically_increasing_id())


def text_of(col: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold_of(col: str, parts: int):
    """crc32 of the id written as text, modulo ``parts``; a null id is in no held-out fold (it gives null)."""
    return F.crc32(F.col(f"`{col}`").cast("string").cast("binary")) % F.lit(parts)
