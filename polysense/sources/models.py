"""The model store: versioned snapshots, the word2vec-style text export, the run history.

Layout of a run: ``<root>/<run>/it=<n>/{vocab,model}`` (parquet), ``<root>/<run>/history``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.functions.vecmath import as_floats

HISTORY_SCHEMA = (
    "it int, epoch int, shard int, vali_loss double, vali_adjust double, train_loss double, lr double, "
    "words bigint, limited bigint, reset bigint"
)


def save_model(model: DataFrame, vocab: DataFrame, path: str) -> None:
    """Word index and both matrices under ``path``, replacing what is there."""
    vocab.select("word_id", "word", "cn", "n_senses").write.mode("overwrite").parquet(f"{path}/vocab")
    model.select("tbl", "word_id", "sense", "vec").write.mode("overwrite").partitionBy("tbl").parquet(f"{path}/model")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocab")


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """``(tbl, word_id, sense, vec)``; a filter on ``tbl`` prunes the other matrix."""
    return spark.read.parquet(f"{path}/model").select("tbl", "word_id", "sense", "vec")


def named_vectors(model: DataFrame, vocab: DataFrame, table: str = "in") -> DataFrame:
    """``(word, sense, vec)`` of one matrix."""
    rows = model.filter(F.col("tbl") == table)
    return rows.join(vocab.select("word_id", "word"), "word_id").select("word", "sense", "vec")


def load_vectors(spark: SparkSession, path: str, table: str = "in") -> DataFrame:
    return named_vectors(load_model(spark, path), load_vocab(spark, path), table)


def vector_lines(vectors: DataFrame) -> DataFrame:
    """``(value)``: ``word sense v0 v1 ..`` separated by spaces, one row per word sense."""
    numbers = F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")
    return vectors.select(F.concat_ws(" ", "word", F.col("sense").cast("string"), numbers).alias("value"))


def parse_vector_lines(lines: DataFrame) -> DataFrame:
    """Inverse of :func:`vector_lines`."""
    parts = F.split("value", " ", -1)
    numbers = F.slice(F.col("_p"), F.lit(3), F.size("_p") - 2)
    return lines.select(parts.alias("_p")).select(
        F.col("_p")[0].alias("word"), F.col("_p")[1].cast("int").alias("sense"), as_floats(numbers).alias("vec")
    )


def save_vectors_text(vectors: DataFrame, path: str) -> None:
    vector_lines(vectors).write.mode("overwrite").text(path)


def load_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_vector_lines(spark.read.text(path))


def index_lines(vocab: DataFrame) -> DataFrame:
    """``(value)``: ``word_id_nSenses`` entries of the word index."""
    return vocab.select(F.concat_ws("_", "word", F.col("word_id").cast("string"), F.col("n_senses").cast("string")).alias("value"))


def load_word_index(spark: SparkSession, path: str) -> DataFrame:
    """``(word, word_id, n_senses)`` of files of :func:`index_lines`."""
    entry = "^(.*)_([0-9]+)_([0-9]+)$"
    part = lambda i: F.regexp_extract("value", entry, i)
    return spark.read.text(path).filter(F.col("value").rlike(entry)).select(
        part(1).alias("word"), part(2).cast("int").alias("word_id"), part(3).cast("int").alias("n_senses"))


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(tbl, word, sense, vec)`` of a saved model, the form that a warm start takes."""
    rows = load_model(spark, path).join(load_vocab(spark, path).select("word_id", "word"), "word_id")
    return rows.select("tbl", "word", "sense", "vec")


def save_word2vec_text(vectors: DataFrame, path: str) -> None:
    """The plain text form of other tools: a header ``words dim``, then ``word v0 v1 ..``.

    A word has one line, of its lowest sense. The header is the first part file, so the
    parts in the order of their names make one file.
    """
    plain = vectors.groupBy("word").agg(F.min(F.struct("sense", "vec")).alias("_first")).select("word", F.col("_first.vec").alias("vec"))
    size = vectors.agg(F.count_distinct("word").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim"))
    header = size.select(F.concat_ws(" ", "n", "dim").alias("value")).coalesce(1)
    numbers = F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")
    header.union(plain.select(F.concat_ws(" ", "word", numbers))).write.mode("overwrite").text(path)


def load_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vec)`` of the plain text form; a line of two whole numbers is its header."""
    rows = spark.read.text(path).filter(~F.col("value").rlike("^[0-9]+ [0-9]+$")).select(F.split("value", " ", -1).alias("_p"))
    return rows.select(F.col("_p")[0].alias("word"), as_floats(F.slice("_p", F.lit(2), F.size("_p") - 1)).alias("vec"))


def write_history(spark: SparkSession, path: str, row: tuple) -> None:
    """One row per iteration, in a partition of its own, so that an iteration done again replaces
    its row; values of iterations that were not validated are null."""
    spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("it").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).select(*[c.split()[0] for c in HISTORY_SCHEMA.split(", ")])
