"""Duplicate passages by relative Lempel-Ziv parsing.

Every document is factored against the indexed reference blocks of the corpus itself: a
factor is a run of words that also starts earlier (in a document of smaller id, or at an
earlier place of the same one). Factors of at least ``window`` words become duplicate
spans; around their boundaries every window is looked up on its own, so that spans
are exact.

Three steps keep the work near the amount of repetition. Wholly equal documents are
settled by their digest. Each remaining document sends a winnowed choice of short word
runs, its anchors, such that any window holds one; a document goes on with anchors that
occur twice. Only windows whose own anchor does are looked up, first in the index of
the block at hand, then in that of all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from polysense.llm.common import batch_of, byte_texts, rows_of
from polysense.sources.store import materialize

WINDOW = 20
ANCHOR = 6
#: rows of a block's index; only the number of blocks depends on it
BLOCK_ROWS = 1 << 20

# fixed odd multipliers of the word and window hashes
_BYTE, _RUN, _CHECK = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(joined: bytes, n: int) -> np.ndarray:
    """64-bit hashes of the ``n`` words of a text whose words are joined by one space each.

    A word's hash is a polynomial of its bytes modulo 2^64, read off prefix sums, then mixed with its length.
    """
    if not n:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(data + np.uint64(1)) * _powers(_BYTE, len(data)), dtype=np.uint64)))
    value = (sums[ends] - sums[starts]) * _powers(_inverse(_BYTE), len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _MIX2)


def run_hashes(words: np.ndarray, k: int, base: np.uint64 = _RUN) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)))
    return mix((sums[k:] - sums[:-k]) * _powers(_inverse(base), n))


def anchors(runs: np.ndarray, span: int) -> np.ndarray:
    """Place of the winnowed run of every window: the smallest hash of ``span`` neighbours, the first of equals."""
    if len(runs) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    return np.concatenate([view[at : at + 4096].argmin(axis=1) + np.arange(at, min(at + 4096, len(view))) for at in range(0, len(view), 4096)])


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchors", pa.list_(pa.int64()))])


def _profile(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = text.split()
                joined = b" ".join(words)
                runs = run_hashes(word_hashes(joined, len(words)), k)
                found = runs[np.unique(anchors(runs, window - k + 1))].view(np.int64)
                rows.append((doc, len(words), hashlib.sha256(joined).digest(), found))
            if rows:
                yield batch_of(_PROFILE, *zip(*rows))
    return run


class _Buffer:
    """Arrays of a block, emitted when it is full."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.rows += len(columns[0])
        return self.rows >= BLOCK_ROWS

    def take(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.rows = [], 0
        return out


_ANCHOR = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("known", pa.bool_()), ("probe", pa.bool_())])


def _block_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a block. A hash that occurs twice in the block is known to repeat; one row of it asks the other blocks."""
    buffer = _Buffer()

    def out():
        h, doc = buffer.take()
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.append(True, h[1:] != h[:-1])
        twice = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1] > 1
        keep = first | np.append(True, (doc[1:] != doc[:-1]))
        return batch_of(_ANCHOR, h[keep], doc[keep], twice[keep], first[keep])

    for batch in batches:
        lists = batch.column(1)
        h = lists.flatten().to_numpy()
        doc = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        if len(h) and buffer.add(h, doc):
            yield out()
    if buffer.rows:
        yield out()


PROBE = "w long, c long, doc_id long, start int, length int, ref_doc long, ref_start int"
_PROBE = pa.schema([("w", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()),
                    ("ref_doc", pa.int64()), ("ref_start", pa.int32())])


def greedy_factors(doc, start, length, ref_doc, ref_start, window: int):
    """Chain factors whose windows follow each other in the document and in the reference.

    Rows are sorted by document and start; returns the same columns, one row per longest chain.
    """
    if not len(doc):
        return doc, start, length, ref_doc, ref_start
    step = length[:-1] - window + 1
    chained = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + step) & (ref_doc[1:] == ref_doc[:-1]) & (ref_start[1:] == ref_start[:-1] + step)
    head = np.flatnonzero(np.append(True, ~chained))
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], start[tail] + length[tail] - start[head], ref_doc[head], ref_start[head]


def _block_windows(window: int, k: int):
    """Look up the windows of a block in its own index; the first of each goes to the index of all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer()

        def out():
            w, c, doc, start = buffer.take()
            order = np.lexsort((start, doc, c, w))
            w, c, doc, start = w[order], c[order], doc[order], start[order]
            first = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
            ref = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = np.flatnonzero((doc != doc[ref]) | (start != start[ref]))
            ask = np.flatnonzero((doc == doc[ref]) & (start == start[ref]))
            ask = ask[np.append(True, ref[ask][1:] != ref[ask][:-1])] if len(ask) else ask
            ask = ask[np.lexsort((start[ask], doc[ask]))]  # rows of a document side by side compress well in the shuffle
            yield batch_of(_PROBE, w[ask], c[ask], doc[ask], start[ask].astype(np.int32), np.full(len(ask), window, np.int32),
                           pa.nulls(len(ask), pa.int64()), pa.nulls(len(ask), pa.int32()))
            if len(later):
                by = later[np.lexsort((start[later], doc[later]))]
                d, s, n, rd, rs = greedy_factors(doc[by], start[by], np.full(len(by), window), doc[ref[by]], start[ref[by]], window)
                spread = mix(d.view(np.uint64) * _RUN + s.astype(np.uint64)).view(np.int64)  # factors are settled: any place will do
                yield batch_of(_PROBE, spread, np.full(len(d), -1), d, s.astype(np.int32), n.astype(np.int32), rd, rs.astype(np.int32))

        for batch in batches:
            for doc, text, hits in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2)):
                split = text.split()
                words = word_hashes(b" ".join(split), len(split))
                runs = run_hashes(words, k)
                own = anchors(runs, window - k + 1)  # equal windows have equal anchors
                start = np.flatnonzero(np.isin(runs[own].view(np.int64), hits.values.to_numpy()))
                if not len(start):
                    continue
                w = run_hashes(words, window)[start].view(np.int64)
                c = (run_hashes(words, window, _CHECK)[start] >> np.uint64(33)).astype(np.int64)
                if buffer.add(w, c, np.full(len(start), doc, np.int64), start):
                    yield from out()
        if buffer.rows:
            yield from out()
    return run


def profiles(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    return docs.mapInArrow(_profile(window, k), "doc_id long, n_words long, sha binary, anchors array<long>")


def window_factors(texts: DataFrame, profile: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Factors ``(doc_id, start, length, ref_doc, ref_start)`` of documents ``texts(doc_id, text)``.

    ``profile`` lists the documents to be factored, with anchors. A hot anchor or window
    leaves each block once, however many documents of the block hold it.
    """
    asked = profile.filter(F.size("anchors") > 0).select("doc_id", "anchors").mapInArrow(
        _block_anchors, "h long, doc_id long, known boolean, probe boolean")
    # a hash has one asking row in each block; rows that need no answer are spread by document
    at = F.when(F.col("probe"), F.col("h")).otherwise(F.xxhash64("doc_id", "h"))
    counted = asked.withColumn("at", at).withColumn("n", F.count("*").over(Window.partitionBy("at", "probe")))
    hits = counted.filter("known OR n > 1").groupBy("doc_id").agg(F.collect_list("h").alias("hits"))
    found = texts.join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(_block_windows(window, k), PROBE)
    same = Window.partitionBy("w", "c")
    place = F.struct("doc_id", "start")
    earliest = F.min(F.when(F.col("ref_doc").isNull(), place)).over(same)
    met = found.withColumn("e", earliest).withColumn("asks", F.col("ref_doc").isNull())
    met = met.filter("NOT asks OR struct(doc_id, start) != e").select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
        F.when(F.col("asks"), F.col("e.doc_id")).otherwise(F.col("ref_doc")).alias("ref_doc"),
        F.when(F.col("asks"), F.col("e.start")).otherwise(F.col("ref_start")).cast("long").alias("ref_start"))
    return met


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0


_KEPT = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("kept_sha", pa.binary()), ("kept_text", pa.string())])


def _cut(window: int, with_text: bool):
    """Parse each document into factors and take out the words they cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2)):
                words = text.split()
                start, length, ref_doc, ref_start = (found.values.field(i).to_numpy() for i in range(4))
                by = np.lexsort((length, start))
                _, start, length, _, _ = greedy_factors(np.zeros(len(by)), start[by], length[by], ref_doc[by], ref_start[by], window)
                gone = covered(start, length, len(words))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((doc, hashlib.sha256(b" ".join(words)).digest(), int(gone.sum()), hashlib.sha256(kept).digest(),
                             kept.decode() if with_text else None))
            if rows:
                yield batch_of(_KEPT, *zip(*rows))
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = ANCHOR,
                   with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept_text])``, one row per document.

    Words that a window of ``window`` words covers are removed if its sequence also starts
    earlier; windows are judged on the input. ``kept_text`` is null where nothing was
    removed. Null and empty texts have no words. Rows that repeat an id and its words give
    one row each, of equal content; if one id has different texts, the spans found in
    any of them are cut from all. A row without an id is not judged: nothing of it is
    removed, and it is no reference. An empty table gives an empty result.
    """
    texts = rows_of(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    profile = materialize(profiles(texts, window, k), "profiles")
    named = profile.filter(F.col("doc_id").isNotNull())
    # joined on the id too, so that a large group of copies is spread
    heads = named.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    first = named.join(heads, ["sha", "doc_id"], "left_semi").select("doc_id", "anchors")
    factors = window_factors(texts, first, window, k)
    spans = factors.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "ref_doc", "ref_start")).alias("spans"))
    cut = texts.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _cut(window, with_text), "doc_id long, sha binary, n_removed long, kept_sha binary, kept_text string").dropDuplicates(["doc_id", "sha"])
    base = named.select("doc_id", "n_words", "sha").join(heads.withColumn("head", F.lit(True)), ["sha", "doc_id"], "left")
    base = base.select("doc_id", "n_words", "sha", (F.col("head").isNull() & (F.col("n_words") >= window)).alias("copy"))
    nobody = profile.filter(F.col("doc_id").isNull()).select("doc_id", "n_words", "sha", F.lit(False).alias("copy"))
    done = base.join(cut, ["doc_id", "sha"], "left").unionByName(nobody, allowMissingColumns=True)
    sha = F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha"))))
    out = [F.col("doc_id"), F.col("n_words"),
           F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
           sha.alias("kept_sha256")]
    return done.select(*out, *([F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
