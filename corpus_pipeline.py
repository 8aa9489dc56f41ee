"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read again; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.llm import mixing, packing, pii, queries, simhash, toxicity
from polysense.sources.store import materialize


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more; a bounded sample of the labelled documents teaches.

    Null and empty texts stay, as do null ids; each row is judged by its own text, so
    repeated rows share a verdict. Without labels of both kinds nothing is rejected.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component, the one of the smallest id.

    A row without an id is kept if no row of its component has one; of rows that repeat an
    id in one component a single one is kept, while other texts of that id count by their own components.
    """
    return simhash.one_per_component(docs)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data in the text; ``n_chars`` follows.

    No row goes. A null text stays null, with null ``n_chars``; rows without ids and
    repeated rows are redacted like any other.
    """
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics get their target shares.

    Null sources and languages are groups of their own. A row is drawn by its id and its
    text: rows equal in both share their fate, other rows of an id, or without one, do not.
    """
    return mixing.sampled(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens of the documents into training sequences; one row per piece.

    A null or empty text is its end token alone; rows that repeat an id are packed apart.
    """
    path, pattern = queries.vocabulary()
    return packing.pack(packing.token_lengths(docs, path, pattern, queries.SPECIAL))


STAGES = [
    ("toxicity", toxic_documents_out),
    ("simhash", one_of_near_duplicates),
    ("pii", personal_data_out),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: the stages tokenize, boost and hash bit by bit, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
