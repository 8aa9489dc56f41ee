"""Token counts as delta-maintained rollups.

A store holds, per batch, additive changes of totals by source, language and tokenizer
version. A batch is a table of signed rows: an insert adds a document's count, a delete
takes it away, a revision is both. Batches are committed under an id of the caller, by
one directory rename at most once each, so a repeated commit changes nothing. Totals are
sums over committed batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.llm.common import batch_of, rows_of
from polysense.llm.packing import load_encoder
from polysense.sources.store import materialize, move_once, remove

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

_COUNTED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("n_chars", pa.int64())])


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], version: str, id_col: str = "doc_id",
                 text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, source, lang, tokenizer, n_tokens, n_chars)`` per row; a null text has no tokens, null keys stay null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path, pattern, special)
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            yield batch_of(_COUNTED, batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2),
                           [len(encode(t)) for t in texts], [len(t) for t in texts])
    rows = rows_of(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col)
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_chars long").select(
        "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", "n_chars")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Inserts (+1) or deletes (-1) of counted documents."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"),
                         (sign * F.col("n_chars")).alias("n_chars"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace counts of documents by new ones, under any keys."""
    return signed(before, -1).unionByName(signed(after, 1))


@dataclass
class TokenRollup:
    """A rollup store under ``path``, a folder all executors share."""

    spark: SparkSession
    path: str

    def _place(self, *parts: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def committed(self, batch: str) -> bool:
        files, place = self._place("batches", f"batch={batch}", "_SUCCESS")
        return files.exists(place)

    def commit(self, batch: str, changes: DataFrame | Callable[[], DataFrame]) -> bool:
        """Add a batch of signed rows; False, and no work, if the id is committed already.

        Rows are added up per key before anything is kept, with map-side combining, so
        a source with a third of all rows is no hot key. The sums are written aside and
        become the batch by one rename, which refuses a batch that is there: of two committers
        of an id, one adds its rows. What a lost driver left aside is never read.
        """
        if not batch or set(batch) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."):
            raise ValueError("a batch id is made of letters, digits and -_.")
        if self.committed(batch):
            return False
        rows = changes() if callable(changes) else changes
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        aside, target = f"{self.path}/aside/{batch}-{uuid.uuid4().hex}", f"{self.path}/batches/batch={batch}"
        sums.write.parquet(aside)
        if move_once(self.spark, aside, target):
            return True
        remove(self.spark, aside)
        return False

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens, n_chars)``; keys whose every sum is zero are left out."""
        files, folder = self._place("batches")
        if not files.exists(folder) or not files.listStatus(folder):
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(folder.toString())
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        return sums.filter("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")


def counted_table(docs: DataFrame, *args, **columns: str) -> DataFrame:
    """``token_counts`` written once, for batches that use it again."""
    return materialize(token_counts(docs, *args, **columns), "tokencounts")
