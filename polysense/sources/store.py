"""Durable scratch tables.

A table that several later stages read (vocabulary, noise table, model
versions) is written once as parquet and read back. That cuts lineage, survives
lost executors, and gives Catalyst true file sizes to choose join strategies by.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="polysense-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), "polysense", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` under a fresh path and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.parquet(path)


def _place(spark: SparkSession, path: str):
    """The file system of a path and the path in its form, whatever the store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; one that is not there is no fault."""
    files, place = _place(spark, path)
    files.delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it is not there."""
    files, place = _place(spark, path)
    return sorted(entry.getPath().getName() for entry in files.listStatus(place)) if files.exists(place) else []


def move_once(spark: SparkSession, source: str, target: str) -> bool:
    """Rename ``source`` to ``target`` unless that exists; of two callers one gets True.

    Unlike a plain rename it neither replaces a file nor moves into a folder that is there.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(new.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(new).toUri(), spark._jsc.hadoopConfiguration())
    files.mkdir(new.getParent(), None, True)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # no option: refuse
    try:
        files.rename(old, new, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def write_text_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with all of ``text`` in one step; False if it is there already."""
    aside = f"{path}.{uuid.uuid4().hex}.aside"
    files, place = _place(spark, aside)
    out = files.create(place)
    out.write(bytearray(text.encode()))
    out.close()
    if move_once(spark, aside, path):
        return True
    remove(spark, aside)
    return False


class Versions:
    """Named tables that are rewritten again and again, as in a training loop.

    A new version goes to a fresh path, so it may read the one before; that one is
    deleted once the new one is complete.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def fresh_path(self, name: str) -> str:
        return scratch_path(self.spark, name)

    def put(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = self.fresh_path(name)
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def drop(self, name: str) -> None:
        path = self.paths.pop(name, None)
        if path:
            remove(self.spark, path)

    def drop_all(self) -> None:
        for name in list(self.paths):
            self.drop(name)
