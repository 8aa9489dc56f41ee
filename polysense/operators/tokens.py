"""Tokenizing, encoding by vocabulary, and the combined word-sense code."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

# from the first to the last letter of a space-separated piece
WORD_PATTERN = r"(\p{L}(?:[^ ]*\p{L})?)"
SENSE_BASE = 100
HEAD_WORDS = 65_536
HEAD_WORD_BYTES = 256
VOCAB_BYTES = 64 << 20  # a vocabulary of so many bytes is all head
VOCAB_ROW_BYTES = 64    # of a word besides its letters


def tokenize(lines: DataFrame) -> DataFrame:
    """``(line_id, line) -> (line_id, raw_pos, word)``: split on single spaces,
    strip non-letters from both ends, lowercase, drop what is left empty."""
    return lines.select(
        "line_id", F.posexplode(F.regexp_extract_all("line", F.lit(WORD_PATTERN), F.lit(1))).alias("raw_pos", "_w")
    ).select("line_id", "raw_pos", F.lower("_w").alias("word"))


def _numbered(batches):
    """``pos`` of tokens that come line by line, in place of ``raw_pos``."""
    line, at = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lines = batch.column("line_id").to_numpy()
        cuts = np.flatnonzero(np.r_[lines[0] != line, lines[1:] != lines[:-1]])
        begin = np.r_[-at, cuts] if not len(cuts) or cuts[0] else cuts
        pos = np.arange(n) - np.repeat(begin, np.diff(np.r_[np.maximum(begin, 0), n]))
        line, at = lines[-1], int(pos[-1]) + 1
        columns = [batch.column("line_id"), pa.array(pos, pa.int32()), batch.column("word_id"), batch.column("n_senses")]
        yield pa.RecordBatch.from_arrays(columns, ["line_id", "pos", "word_id", "n_senses"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def _distinct_ids(lines: DataFrame) -> bool:
    """Whether no two lines share an id and none lacks one."""
    return lines.groupBy("line_id").count().filter(F.col("line_id").isNull() | (F.col("count") > 1)).isEmpty()


def filter_vocab(tokens: DataFrame, vocab: DataFrame, head: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Keep tokens of the vocabulary and number them densely within their line
    -> ``(line_id, pos, word_id, n_senses)``.

    A vocabulary of at most ``VOCAB_BYTES`` is broadcast whole, and tokens are made once. Of a
    larger one, or with ``head``, head words are found by a broadcast of at most ``head``
    bounded strings; what is not found there is rare by rank and goes through a shuffle join.

    ``lines`` are those that :func:`tokenize` made ``tokens`` of. Its tokens come line by line, and a broadcast
    join keeps them so: lines of different ids are numbered where they stand, and no token moves.
    """
    table = vocab.select("word", "word_id", "n_senses")
    whole = head is None and (table.agg(F.sum(F.octet_length("word") + VOCAB_ROW_BYTES)).first()[0] or 0) <= VOCAB_BYTES
    is_head = (F.col("word_id") < (HEAD_WORDS if head is None else head)) & (F.octet_length("word") <= HEAD_WORD_BYTES)
    rest = table.filter(~is_head)
    if whole or rest.isEmpty():
        found = tokens.join(F.broadcast(table), "word")
        if lines is not None and dict(tokens.dtypes)["line_id"] == "bigint" and _distinct_ids(lines):
            rows = found.select("line_id", "word_id", "n_senses")
            return rows.mapInArrow(_numbered, "line_id bigint, pos int, word_id int, n_senses int")
    else:
        first = table.filter(is_head)
        marked = tokens.join(F.broadcast(first), "word", "left")
        missing = marked.filter(F.col("word_id").isNull()).select(*tokens.columns)
        found = marked.filter(F.col("word_id").isNotNull()).unionByName(missing.join(rest, "word"))
    # one line is one input cell (2 GB at most), so this window stays bounded
    order = Window.partitionBy("line_id").orderBy("raw_pos")
    return found.select("line_id", (F.row_number().over(order) - 1).alias("pos"), "word_id", "n_senses")


def encode_ws(word_id: Column, sense: Column) -> Column:
    return word_id.cast("bigint") * SENSE_BASE + sense


def decode_ws(ws: Column) -> tuple[Column, Column]:
    """``ws -> (word_id, sense)``."""
    sense = ws % SENSE_BASE
    return ((ws - sense) / SENSE_BASE).cast("int"), sense.cast("int")
