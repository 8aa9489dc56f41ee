"""Registered queries of the operators, over whole tables, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.llm import centroid, divergence, embed_dedup, license_scan, mixing, packing, pii, quality, rollup, simhash, substring, toxicity, warc
from polysense.sources.store import scratch_path

#: the vocabulary of the token counts, the same in both files; its pattern comes with it
RANKS = "byte_bpe_50k.tiktoken"
OTHER_RANKS = "byte_bpe_multi_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = RANKS) -> tuple[str, str]:
    """Path and pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@_register
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_register
def op2_token_rollup(spark, sf_dir):
    """Count all documents, then revise every tenth with another vocabulary and delete every thirteenth, replaying a batch."""
    path, pattern = vocabulary()
    other, _ = vocabulary(OTHER_RANKS)
    docs = _table(spark, sf_dir, "documents")
    store = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    counted = rollup.counted_table(docs, path, pattern, SPECIAL, "byte_bpe_50k")
    store.commit("load", rollup.signed(counted, 1))
    old = counted.filter("doc_id % 10 = 0")
    new = rollup.token_counts(docs.filter("doc_id % 10 = 0"), other, pattern, SPECIAL, "byte_bpe_multi_50k")
    for _ in range(2):
        store.commit("revise", lambda: rollup.revised(old, new))
    store.commit("delete", lambda: rollup.signed(counted.filter("doc_id % 13 = 0 AND doc_id % 10 != 0"), -1))
    return store.totals()


@_register
def op3_packing(spark, sf_dir):
    path, pattern = vocabulary()
    return packing.pack(packing.token_lengths(_table(spark, sf_dir, "documents"), path, pattern, SPECIAL))


@_register
def op4_warc(spark, sf_dir):
    return warc.page_rows(warc.archive_round_trip(_table(spark, sf_dir, "pages")))


@_register
def op5_substring(spark, sf_dir):
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


@_register
def op6_toxicity(spark, sf_dir):
    """Labels are learned from rows whose crc32(doc_id) is not divisible by 5."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.fit(docs, labels.filter(rest != 0))
    return toxicity.score(docs, model).select(
        "doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("segments").alias("n_segments"))


@_register
def op7_quality(spark, sf_dir):
    return quality.clean_lines(_table(spark, sf_dir, "documents")).drop("clean_text")


@_register
def op8_embeddings(spark, sf_dir):
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_register
def op9_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


@_register
def op10_mixing(spark, sf_dir):
    found = mixing.mixture(_table(spark, sf_dir, "documents"))
    return found.withColumn("weight", F.round("weight", 3)).withColumn("probability", F.round("probability", 9))


@_register
def op11_licenses(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


@_register
def op12_centroids(spark, sf_dir):
    return centroid.clusters(_table(spark, sf_dir, "embeddings"))


@_register
def op13_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
