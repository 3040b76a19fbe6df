"""Sessions with settings that the plans are made for, and the package for the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``conf`` adds to that (keys with __ for dots)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.python.filterPushdown.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _checkpoints(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that ``spark.checkpoint.dir`` names: the plan is short, a lost executor costs nothing."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


class Latest:
    """As cut for rows that are replaced again and again: a compressed table in the same folder, of which only the last one stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.root = spark, "", f"{_checkpoints(spark)}/latest-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        """The rows, written; those put before, which they may be made from, are deleted."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        if self.path:
            self._delete(self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-package-"), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
