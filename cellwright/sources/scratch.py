"""Intermediate tables in the folder that driver and executors share, and which plans may be read twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir, as a full path.

    Where that is unset, a local session gets a temporary folder and any other session a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = "file://" + tempfile.mkdtemp(prefix="cellwright-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cellwright"
        spark.conf.set("spark.checkpoint.dir", named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    # Qualified, so that the workers' own readers don't take another file system for the default one.
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


_watched: list[list[str]] = []


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for made in _watched:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders named by new_folder within: for work whose result is written elsewhere before the end."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched[:] = [x for x in _watched if x is not made]
        for path in made:
            remove(spark, path)


def file_system(path: str):
    """pyarrow's file system for a path that Spark knows, and the path there; for workers."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://")
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, what: str = "cut", instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation.

    instead_of: earlier cuts that nothing but df reads; they are deleted once df is written."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    forget(*instead_of)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for old in cuts:
        remove(old.sparkSession, old.cut_path)


def plain_read(df: DataFrame) -> str | None:
    """The format, if df is no more than a projection and a selection of files: its rows then come in the same partitions and order each time."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return None
    return plan.toString().split("\n")[0].rsplit("]", 1)[-1].strip().lower() or None
