"""A corpus with one row per chunk of a line, so that windows are whole wherever a row is read.

Tokens that come line by line are packed where they stand. Later steps that look a few tokens
around then read the chunks in place: no token is shuffled or sorted to find its neighbours.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

LISTS = ("word_id", "sense", "n_senses")
#: ``start`` is the position of the first token held, ``lead`` tokens before the ``own`` ones belong to the chunk before
_CHUNK = pa.schema([("line_id", pa.int64()), ("chunk", pa.int32()), ("start", pa.int32()), ("lead", pa.int32()), ("own", pa.int32()),
                    *[(c, pa.list_(pa.int32())) for c in LISTS]])
CHUNK = "line_id bigint, chunk int, start int, lead int, own int, word_id array<int>, sense array<int>, n_senses array<int>"
#: tokens that are packed at a time
PACK_TOKENS = 65_536
#: tokens of the chunks that are opened at a time, one chunk at least
OPEN_TOKENS = 16_384
_NO_LINE = -(1 << 63)  # stands for a missing id

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def is_chunked(rows: DataFrame) -> bool:
    return "lead" in rows.columns


def line_chunks(occ: DataFrame, window: int, chunk_tokens: int) -> DataFrame:
    """Tokens ``(line_id, pos, word_id, n_senses, sense)`` as rows ``CHUNK`` of ``chunk_tokens`` own ones and ``window`` more on each side.

    Those of a line must follow each other by ``pos``, in one partition, as ``tokens.filter_vocab`` gives them.
    """
    size = max(chunk_tokens, window)
    columns = ["line_id", "pos", *LISTS]

    def packed(held: list[np.ndarray], lead: int, last: bool):
        """The chunks that are complete, and what is left with its own lead."""
        line, pos = held[:2]
        n, home = len(line), pos // size
        new_line = np.r_[True, line[1:] != line[:-1]]
        begin = np.flatnonzero(np.r_[True, new_line[1:] | (home[1:] != home[:-1])])
        begin = np.r_[lead, begin[begin > lead]]
        end = np.r_[begin[1:], n]
        lines = np.flatnonzero(new_line)
        of = np.searchsorted(lines, begin, "right") - 1
        low = np.maximum(begin - window, lines[of])
        high = np.minimum(end + window, np.r_[lines[1:], n][of])
        # of the last line more may come, so a chunk of it waits for the tokens after it
        done = len(begin) if last else int(np.searchsorted((of == len(lines) - 1) & (end + window >= n), True))
        rest = [c[low[done] :] for c in held] if done < len(begin) else [c[:0] for c in held]
        left = int(begin[done] - low[done]) if done < len(begin) else 0
        begin, end, low, high = (x[:done] for x in (begin, end, low, high))
        sizes = high - low
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.arange(ends[-1]) + np.repeat(low - ends[:-1], sizes)
        plain = [home[begin], pos[low], begin - low, end - begin]
        out = [pa.array(line[begin], mask=line[begin] == _NO_LINE), *[pa.array(c, pa.int32()) for c in plain],
               *[pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(c[at], pa.int32())) for c in held[2:]]]
        return pa.RecordBatch.from_arrays(out, schema=_CHUNK), rest, left

    def pack(batches):
        waiting, rows, lead = [], 0, 0
        for batch in batches:
            columns = [batch.column(0).fill_null(_NO_LINE), *batch.columns[1:]]
            waiting.append([c.to_numpy() for c in columns])
            rows += batch.num_rows
            if rows >= PACK_TOKENS:
                found, rest, lead = packed([np.concatenate(c) for c in zip(*waiting)], lead, False)
                yield found
                waiting, rows = [rest], len(rest[0])
        if rows:
            yield packed([np.concatenate(c) for c in zip(*waiting)], lead, True)[0]

    return occ.select(*columns).mapInArrow(pack, CHUNK)


def chunk_tokens(chunks: DataFrame, halo: bool = False) -> DataFrame:
    """Each token once -> ``(line_id, pos, word_id, n_senses, sense)``; with ``halo`` every token of every chunk, with ``chunk`` and ``own``."""
    more = [c for c in chunks.columns if c not in (f.name for f in _CHUNK)]
    own = (F.col("_i") >= F.col("lead")) & (F.col("_i") < F.col("lead") + F.col("_own"))
    rows = chunks.select(*more, "line_id", "chunk", "start", "lead", F.col("own").alias("_own"), F.col("sense").alias("_s"), F.col("n_senses").alias("_n"),
                         F.posexplode("word_id").alias("_i", "word_id"))
    rows = rows if halo else rows.filter(own)
    marks = ["chunk", own.alias("own")] if halo else []
    return rows.select(*more, "line_id", (F.col("start") + F.col("_i")).alias("pos"), "word_id", F.get("_n", "_i").alias("n_senses"),
                       F.get("_s", "_i").alias("sense"), *marks)


def opened(batches):
    """Arrow batches of chunks as batches of all their tokens, with ``chunk`` and ``own``; a few chunks at a time."""
    for batch in batches:
        ends = np.cumsum(batch.column("word_id").value_lengths().to_numpy(), dtype=np.int64)
        s = 0
        while s < len(ends):
            room = OPEN_TOKENS + (ends[s - 1] if s else 0)
            e = max(s + 1, int(np.searchsorted(ends, room, "right")))
            yield _opened(batch.slice(s, e - s))
            s = e


def _opened(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = [batch.column(c) for c in LISTS]
    start, lead, own = (batch.column(c).to_numpy() for c in ("start", "lead", "own"))
    sizes = lists[0].value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mine = (at >= lead[row]) & (at < (lead + own)[row])
    line, chunk = (batch.column(c).take(pa.array(row)) for c in ("line_id", "chunk"))
    return pa.RecordBatch.from_arrays([line, chunk, pa.array((start[row] + at).astype(np.int32)), *[x.flatten() for x in lists], pa.array(mine)],
                                      ["line_id", "chunk", "pos", *LISTS, "own"])
