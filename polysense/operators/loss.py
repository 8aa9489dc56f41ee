"""Skip-gram loss with negative sampling, per pair, line and corpus.

Tokens travel once, as rows of their word sense, to tasks that hold the model and draw the noise
words; a model too large for that is brought, row by row, to groups of tokens of bounded size. In
there a context's vectors are multiplied with all the centres around it at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from polysense.functions import kernels
from polysense.operators.chunks import chunk_tokens, is_chunked
from polysense.operators.training import GROUP_TOKENS, grouped, held_model, per_block, per_group, window_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PAIR = pa.schema([("line_id", pa.int64()), ("pos", pa.int32()), ("ctx_pos", pa.int32()), ("word_id", pa.int32()), ("sense", pa.int32()),
                   ("loss", pa.float64()), ("n", pa.int64())])
PAIR = "line_id bigint, pos int, ctx_pos int, word_id int, sense int, loss double, n bigint"
_CENTRE = pa.schema([f for f in _PAIR if f.name != "ctx_pos"])
CENTRE = "line_id bigint, pos int, word_id int, sense int, loss double, n bigint"


@dataclass(frozen=True)
class Scored:
    """What is needed to score every (centre, context, target) of a corpus.

    ``rows`` are tokens in chunks, as of ``training.window_chunks``, or rows of ``chunks.line_chunks``. A context position asks
    its centres to predict its own word sense and its noise words. ``all_senses`` takes
    every candidate sense of the ambiguous words as centres instead of the current one.
    ``draw`` makes the noise words where they are used (``noise.in_place``).
    """

    rows: DataFrame
    model: DataFrame
    dim: int
    window: int
    all_senses: bool
    tokens: int
    block: int
    draw: Callable | None

    def groups(self, run: Callable, schema: str) -> DataFrame:
        held = held_model(self.model, self.dim)
        if held is not None:
            return per_block(self.rows, held, self.all_senses, run, schema, self.tokens, self.block, self.draw)
        rows = chunk_tokens(self.rows, halo=True) if is_chunked(self.rows) else self.rows
        return per_group(grouped(rows, self.tokens, self.block), self.model, self.all_senses, run, schema, self.dim, draw=self.draw)


def scored_pairs(
    occ: DataFrame, negatives: DataFrame | None, model: DataFrame, dim: int, window: int, all_senses: bool = False,
    group_tokens: int = GROUP_TOKENS, draw: Callable | None = None,
) -> Scored:
    """Scores of ``occ``, whose noise words are its own column ``noise``, or the rows ``negatives``, or drawn by ``draw``.

    With ``draw``, ``occ`` may be the rows of ``chunks.line_chunks``, cut to ``group_tokens`` with this ``window``.
    """
    if is_chunked(occ):
        return Scored(occ, model, dim, window, all_senses, occ.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0], group_tokens, draw)
    rows = window_chunks(occ, negatives, window, group_tokens, draw)
    return Scored(rows, model, dim, window, all_senses, occ.count(), group_tokens, draw)


def _losses(scored: Scored, reduce: Callable, per_pair: int | None, pairs: bool) -> DataFrame:
    """Losses of pairs or centres; a pair counts ``per_pair`` predictions, or one per target."""
    window, all_senses = scored.window, scored.all_senses

    def run(g):
        n = per_pair or 1 + g.negatives.shape[1]
        out = []
        for sense in range(int(g.n_senses.max()) if all_senses else 1):
            wanted = g.own & (g.n_senses > max(sense, 1)) if all_senses else g.own
            cand = np.minimum(sense, g.n_senses - 1) if all_senses else g.senses
            loss, ctx, inside = kernels.pair_losses(g.words, g.senses, g.first, g.last, g.negatives, g.inputs, g.outputs,
                                                    window, reduce, cand, wanted)
            if pairs:
                c, i = np.nonzero(inside)
                columns = [g.line[c], g.pos[c], g.pos[ctx[c, i]], g.words[c], cand[c], loss[c, i], np.full(len(c), n)]
            else:
                c = np.flatnonzero(inside.any(axis=1))
                columns = [g.line[c], g.pos[c], g.words[c], cand[c], (loss * inside)[c].sum(axis=1), inside[c].sum(axis=1) * n]
            schema = _PAIR if pairs else _CENTRE
            out.append(pa.table([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(out)

    return scored.groups(run, PAIR if pairs else CENTRE)


def pair_loss_sigmoid(scored: Scored, exact: bool = False) -> DataFrame:
    """``(line_id, pos, ctx_pos, word_id, sense, loss, n)``; every target is one prediction."""
    return _losses(scored, kernels.exact_loss if exact else kernels.sigmoid_loss, None, pairs=True)


def pair_loss_softmax(scored: Scored) -> DataFrame:
    """Sampled-softmax loss; a pair is one prediction."""
    return _losses(scored, kernels.softmax_loss, 1, pairs=True)


def centre_loss(scored: Scored, softmax: bool = False) -> DataFrame:
    """``(line_id, pos, word_id, sense, loss, n)`` summed over a centre's contexts."""
    return _losses(scored, kernels.softmax_loss, 1, False) if softmax else _losses(scored, kernels.sigmoid_loss, None, False)


def sentence_loss(scored: Scored, softmax: bool = False) -> DataFrame:
    """``(line_id, loss, n)``."""
    return centre_loss(scored, softmax).groupBy("line_id").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def loss_summary(losses: DataFrame) -> DataFrame:
    """``(loss, n, loss_per_prediction, sentences)`` of a table with ``line_id, loss, n``."""
    loss, n = F.coalesce(F.sum("loss"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    return losses.agg(
        loss.alias("loss"), n.alias("n"), F.try_divide(loss, n.cast("double")).alias("loss_per_prediction"),
        F.count("*").alias("sentences"),
    )


def candidate_sense_loss(
    occ: DataFrame, negatives: DataFrame | None, model: DataFrame, dim: int, window: int, softmax: bool = False, draw: Callable | None = None
) -> DataFrame:
    """Loss of every candidate sense of each ambiguous token, its context held fixed."""
    return centre_loss(scored_pairs(occ, negatives, model, dim, window, all_senses=True, draw=draw), softmax)


def assign_senses_sync(
    occ: DataFrame, negatives: DataFrame | None, model: DataFrame, dim: int, window: int, softmax: bool = False, draw: Callable | None = None
) -> DataFrame:
    """One synchronous pass: each ambiguous token takes its cheapest sense, lowest first
    on ties -> ``(line_id, pos, word_id, old_sense, sense)``.

    The losses of a token's candidates stand side by side in the task that found them, and a
    token is own in one chunk only, so nothing is joined back.
    """
    reduce = kernels.softmax_loss if softmax else kernels.sigmoid_loss
    scored = scored_pairs(occ, negatives, model, dim, window, all_senses=True, draw=draw)
    size = max(scored.block, window)

    def run(g):
        found = np.full((len(g.line), int(g.n_senses.max())), np.inf)
        usable = np.zeros(found.shape, bool)  # losses that there are and that are numbers
        for sense in range(found.shape[1]):
            wanted = g.own & (g.n_senses > max(sense, 1))
            loss, _, inside = kernels.pair_losses(g.words, g.senses, g.first, g.last, g.negatives, g.inputs, g.outputs,
                                                  window, reduce, np.minimum(sense, g.n_senses - 1), wanted)
            some = inside.any(axis=1)
            found[some, sense] = (loss * inside)[some].sum(axis=1)
            usable[some, sense] = ~np.isnan(found[some, sense])
        found[~usable] = np.inf
        least = usable & (found == found.min(axis=1, keepdims=True))
        # without a number among the losses the lowest candidate stands first
        scored_rows = g.own & (g.n_senses > 1) & (g.last > g.first)
        best = np.where(usable.any(axis=1), least.argmax(axis=1), np.where(scored_rows, 0, g.senses))
        columns = [g.line, g.pos, g.words, g.senses, best]
        home = g.chunk == g.pos // size
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, _SYNC)], schema=_SYNC).filter(pa.array(home))

    return scored.groups(run, SYNC)


_SYNC = pa.schema([("line_id", pa.int64()), ("pos", pa.int32()), ("word_id", pa.int32()), ("old_sense", pa.int32()), ("sense", pa.int32())])
SYNC = "line_id bigint, pos int, word_id int, old_sense int, sense int"


def adjust_rate(assigned: DataFrame) -> DataFrame:
    """Share of lines in which a pass changed a sense, with the counts."""
    changed = F.max(F.when(F.col("sense") != F.col("old_sense"), 1).otherwise(0))
    lines = assigned.groupBy("line_id").agg(changed.alias("_changed"))
    total = F.coalesce(F.sum("_changed"), F.lit(0)).cast("bigint")
    return lines.agg(
        total.alias("adjusted"), F.count("*").alias("sentences"),
        F.try_divide(total.cast("double"), F.count("*").cast("double")).alias("rate"),
    )
