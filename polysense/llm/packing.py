"""Packing token sequences into windows by minimum bin slack.

Texts are tokenized once, next to their rows; only lengths and checksums go on. Full
windows are cut from the front of a document. What is left, one length per document,
is packed by length alone: a histogram of at most ``window - 1`` lengths is planned
on the driver, then every document finds its place by its rank within its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from polysense.llm.common import batch_of, rows_of
from polysense.sources.store import materialize

WINDOW = 2048
END_ID = 1
TEXTS = 1024


def load_encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """The public byte-level BPE as a function text -> ids."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


_DOC = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])


def _encode(ranks_path: str, pattern: str, special: dict[str, int], window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path, pattern, special)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):  # so many texts are Python objects at a time
                part = batch.slice(s, TEXTS)
                sizes, crcs = [], []
                for text in part.column(1):
                    ids = np.concatenate([encode(text.as_py() or "").astype("<u4", copy=False), end])
                    sizes.append(len(ids))
                    crcs.append([zlib.crc32(ids[i : i + window].data) for i in range(0, len(ids), window)])
                yield batch_of(_DOC, part.column(0).cast(pa.int64()), sizes, crcs)
                del part
            del batch
    return run


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], id_col: str = "doc_id",
                  text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, doc_tokens, crcs)``: ids of a document with the end id, and one CRC-32 per window of them."""
    return rows_of(docs, doc_id=id_col, text=text_col).mapInArrow(
        _encode(ranks_path, pattern, special, window, end_id), "doc_id long, doc_tokens long, crcs array<long>")


def fill_window(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, with the largest sum up to ``room``.

    Subset sums are bits of one integer; a length's copies are added in powers of two.
    The sets after each step are kept, so that the counts can be traced back.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(times, {length: copies})`` that use up the histogram, by minimum bin slack.

    Each pattern starts from the longest length left and takes the filling closest to
    the window; it is repeated while its counts last. The number of patterns depends on
    the window, not on the documents: each repeat leaves some length short of one use.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fill_window(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[length] // copies for length, copies in pattern.items())
        patterns.append((times, pattern))
        for length, copies in pattern.items():
            left[length] -= copies * times
            if not left[length]:
                del left[length]
    return patterns


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, times, first sequence, offset)`` in the order of ranks."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence, used = 0, {}
    for times, pattern in patterns:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            for _ in range(copies):
                slots.setdefault(length, []).append((used.get(length, 0), times, sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


_PLACE = pa.schema([(n, pa.int64()) for n in ("doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset")])


def _place(slots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n in ("length", "rank")}
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for length in np.unique(column["length"]):
                rows = np.flatnonzero(column["length"] == length)
                table = slots[int(length)]
                rank = column["rank"][rows]
                at = np.searchsorted(table[:, 0], rank, side="right") - 1
                sequence[rows] = table[at, 2] + rank - table[at, 0]
                offset[rows] = table[at, 3]
            c = dict(zip(batch.schema.names, batch.columns))
            yield batch_of(_PLACE, c["doc_id"], c["doc_tokens"], c["start"], c["length"], c["crc"], sequence, offset)
    return run


def pack(lengths: DataFrame, window: int = WINDOW, buckets: int = 256) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of ``token_lengths``.

    Every id is in exactly one piece and every sequence is gapless from 0. Full windows
    have sequences after the packed ones. Ranks within a length come from counts per
    (length, bucket), so a length that many documents share is spread over the
    buckets. Documents may repeat and ids may be null; an empty table gives no piece.
    """
    spark = lengths.sparkSession
    docs = materialize(lengths.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    rest = F.col("doc_tokens") % window
    tails = docs.filter(rest > 0).select(
        "doc_id", "doc_tokens", (F.col("doc_tokens") - rest).alias("start"), rest.alias("length"),
        F.element_at("crcs", -1).alias("crc"), "_row", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = materialize(tails.groupBy("length", "bucket").count(), "lengthcounts")  # at most (window - 1) * buckets rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    patterns = plan_windows(histogram, window)
    packed = sum(times for times, _ in patterns)
    before = counts.select("length", "bucket", (F.sum("count").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = tails.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("_row")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0)))
    placed = ranked.select("doc_id", "doc_tokens", "start", "length", "crc", "rank").mapInArrow(
        _place(_slots(patterns)), "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # full windows: their rank is a running count by partition of the stored rows
    whole = docs.select("doc_id", "doc_tokens", "crcs", F.floor(F.col("doc_tokens") / window).cast("long").alias("n"), "_row").filter("n > 0")
    part = F.shiftrightunsigned(F.col("_row"), 33)
    per_part = whole.groupBy(part.alias("part")).agg(F.sum("n").alias("total"))  # one row per task that read the input
    first = per_part.select("part", F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("first"))
    numbered = whole.withColumn("part", part).withColumn("own", F.sum("n").over(
        Window.partitionBy("part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = numbered.join(first, "part").withColumn(
        "base", F.lit(packed).cast("long") + F.coalesce("first", F.lit(0)) + F.coalesce("own", F.lit(0)))
    full = numbered.select("doc_id", "doc_tokens", "base", F.posexplode(F.slice("crcs", F.lit(1), F.col("n").cast("int"))).alias("i", "crc")).select(
        "doc_id", "doc_tokens", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), (F.col("base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
