"""Tables written between steps, in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset, on a single machine
(tests), a temporary folder of that machine is used; on a cluster that is an error.  The tables of an
application lie in one folder, which is deleted when its JVM ends; steps that have been read for the
last time can be deleted sooner (:func:`discard`).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the folder for intermediate tables and files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lexforge.scratch.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("lexforge.scratch.dir", root)
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    context = spark.sparkContext
    own = f"{shared_root(spark)}/lexforge/{context.applicationId}"
    if getattr(context, "_lexforge_folder", None) != own:
        files, at = _files(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
        context._lexforge_folder = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (a file set for each value of ``by``) and return a reader of it.

    This cuts lineage: a lost executor costs a re-read, not the work before it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**(options or {})).partitionBy(*(by or [])).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lexforge_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise`, of which everything that reads them has been written."""
    for table in tables:
        files, at = _files(table.sparkSession, table._lexforge_path)
        files.delete(at, True)
