"""Corpus readers: one row per line, a line being one sentence."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LINES_PER_DOC = 1 << 24
FILE_BITS = 40  # lines of a text file
SMALL_SPLIT = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; one below ``SMALL_SPLIT`` bytes a core is dealt out over the cores, a larger one never moves."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_SPLIT and len(df.inputFiles()) < cores else df


def line_key(doc_id: Column, line_no: Column) -> Column:
    """Document id and line number in one bigint; raises rather than collide."""
    return F.when(
        line_no < LINES_PER_DOC, doc_id.cast("bigint") * F.lit(LINES_PER_DOC) + line_no
    ).otherwise(F.raise_error(F.lit("document has too many lines for one line_id")).cast("bigint"))


def corpus_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Split each text on newlines -> ``(line_id, line)``."""
    return docs.select(
        F.col(id_col).alias("_doc"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_no", "line")
    ).select(line_key(F.col("_doc"), F.col("_no")).alias("line_id"), "line")


def _numbered(batches):
    """Each line's number within its block: the lines of a block come one after another."""
    block, at = None, 0
    for batch in batches:
        file, start = (batch.column(c).to_pylist() for c in ("file", "start"))
        number = []
        for here in zip(file, start):
            if here != block:
                block, at = here, 0
            number.append(at)
            at += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, "number"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain-text files -> ``(line_id, line)``, lines ending at a newline alone.

    ``line_id`` is the number of the file, by path, above 40 bits of the line's number in it,
    so ids and the draws they key depend neither on how files are split nor on the
    number of tasks. Files are read twice: to count the lines of each block of a file,
    which gives the number its first line has, and to number the lines. Only a row per
    block is joined.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    read = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = read.groupBy("file", "start").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = blocks.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)  # a row per file
    firsts = blocks.select("file", "start", "first").join(files, "file")
    numbered = read.mapInArrow(_numbered, "value string, file string, start bigint, number bigint")
    return numbered.join(firsts, ["file", "start"]).select(
        (F.shiftleft(F.col("file_no").cast("bigint"), FILE_BITS) + F.col("first") + F.col("number")).alias("line_id"), F.col("value").alias("line"))


def first_lines(lines: DataFrame, n: int = 2) -> DataFrame:
    """The sample that is printed when a corpus is opened."""
    return lines.orderBy("line_id").limit(n)


def corpus_summary(lines: DataFrame) -> DataFrame:
    """Number of lines and characters, and the first line by id."""
    first = F.struct("line_id", "line")
    return (
        lines.agg(
            F.count("*").alias("n_lines"),
            F.sum(F.length("line").cast("bigint")).alias("n_chars"),
            F.min("line_id").alias("first_line_id"),
            F.min(first)["line"].alias("first_line"),
        )
    )
