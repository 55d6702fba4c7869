"""Intermediate tables in the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``; only where a local session leaves that unset (tests,
notebooks) is a temporary folder made and set.  A cluster without one is an error.  Intermediate results are written as Parquet, so a lost executor
costs a re-read and not a recomputation, and they are removed when the application's file system closes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets one of its own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="evigraph-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: Spark's setting for what is to become of a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A fresh folder for the tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False) -> None:
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def put(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``frame`` and return it as read back: a cut in the lineage that outlives executors.

        A tidy workspace deletes the write's shuffle files at its end, not when the driver next collects garbage.
        """
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            frame.write.options(**options).parquet(path)
        finally:
            if self.tidy and before is None:
                self.spark.conf.unset(CLEANUP)
            elif self.tidy:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


#: Columns that tell the rows of a table in files apart, and are the same each time it is read: file and place in it.
ROW_KEY = ("__file", "__row")


def _where(docs: DataFrame, names: tuple[str, str]) -> list[Column]:
    found = docs.metadataColumn("_metadata")
    return [F.xxhash64(found["file_path"]).alias(names[0]), found["row_index"].alias(names[1])]


def filed(docs: DataFrame, space: Workspace) -> DataFrame:
    """``docs`` if its rows come straight from Parquet files; else as written to such and read again."""
    try:
        docs.select(*_where(docs, ROW_KEY))
    except AnalysisException:
        return space.put(docs, "filed")
    return docs


def located(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of a table in files, and ROW_KEY."""
    return docs.select(*columns, *_where(docs, ROW_KEY))


def keyed(docs: DataFrame, space: Workspace | None) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with columns as in ROW_KEY, and the names of these: such as no other column has."""
    taken, end = {c.lower() for c in docs.columns}, ""
    while any(name + end in taken for name in ROW_KEY):
        end += "_"
    names = (ROW_KEY[0] + end, ROW_KEY[1] + end)
    docs = filed(docs, space) if space else docs
    return docs.select("*", *_where(docs, names)), names


def kept_rows(docs: DataFrame, kept: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The rows of keyed ``docs`` whose keys are in ``kept``, without the keys."""
    return docs.join(kept.select(*names).hint("merge"), list(names), "left_semi").drop(*names)
