"""Sense assignment, gradient descent and exact gradients on groups of sentences.

The first two are sequential inside a sentence. Over chunks of lines, with a model that tasks can hold, they
run as compiled loops (``functions.compiled``). Else each group of sentences runs in one Arrow
task; for sense assignment, very long sentences are cut into chunks. Spark does the rest: it
forms groups of bounded size, finds which model rows a group can touch, brings exactly
those to it, and merges what comes out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from polysense.config import TrainConfig
from polysense.functions import compiled, kernels
from polysense.functions.draws import SEED_GROUP, below, with_draw
from polysense.functions.vecsum import vector_sums
from polysense.operators.chunks import CHUNK, LISTS, chunk_tokens, is_chunked, line_chunks, opened
from polysense.operators.noise import with_noise_field, with_words
from polysense.operators.tokens import SENSE_BASE, encode_ws
from polysense.sources.store import Versions, materialize

cloudpickle.register_pickle_by_value(kernels)  # tasks need no copy of this package

_ASSIGNED = pa.schema([("line_id", pa.int64()), ("pos", pa.int32()), ("word_id", pa.int32()), ("n_senses", pa.int32()), ("sense", pa.int32()),
                       ("passes", pa.int64()), ("loss", pa.float64()), ("n", pa.int64())])
ASSIGNED = "line_id bigint, pos int, word_id int, n_senses int, sense int, passes bigint, loss double, n bigint"
_LEARNED = pa.schema([("tbl", pa.string()), ("word_id", pa.int32()), ("sense", pa.int32()), ("delta", pa.list_(pa.float64())),
                      ("loss", pa.float64()), ("n", pa.int64()), ("words", pa.int64())])
LEARNED = "tbl string, word_id int, sense int, delta array<double>, loss double, n bigint, words bigint"
_GRADIENT = pa.schema([("tbl", pa.string()), ("word_id", pa.int32()), ("sense", pa.int32()), ("grad", pa.list_(pa.float64()))])


def grouped_sample(occ: DataFrame, negatives: DataFrame | None, num_groups: int, cfg: TrainConfig, draw: Callable | None = None) -> DataFrame:
    """Tokens with their noise words, dealt to groups -> ``(grp, line_id, pos, word_id, sense, n_senses, noise, own)``.

    ``noise`` holds the codes of a token's noise words: a token is one row, whatever their
    number. They come with ``occ`` (``noise.with_noise_words``) or as rows of ``negatives``.
    A line stays whole in one group, since every step of it may depend on the one before;
    sense assignment cuts very long ones itself. ``own`` marks the tokens that are worked
    on as centres: all. With ``draw`` the noise words are left to the steps that use them.
    Rows of ``chunks.line_chunks`` stay such.
    """
    rows = occ if draw else with_words(occ, negatives)
    if not is_chunked(rows):
        rows = rows.select("line_id", "pos", "word_id", "sense", "n_senses", *([] if draw else ["noise"]), F.lit(True).alias("own"))
    return with_draw(rows, "grp", cfg.seed + SEED_GROUP, "line_id").withColumn("grp", below(F.col("grp"), num_groups))


def window_chunks(occ: DataFrame, negatives: DataFrame | None, window: int, chunk_tokens: int, draw: Callable | None = None) -> DataFrame:
    """Tokens in chunks, for work that looks ``window`` tokens around.

    Lines are cut into chunks of ``chunk_tokens`` positions: a ``chunk`` holds its tokens, which
    are ``own``, and the ``window`` tokens on each side, which are not. So no line, however
    long, lies in one task. With ``draw`` tokens travel without noise words.
    """
    rows = occ if draw else with_words(occ, negatives)
    own = F.col("own") if "own" in rows.columns else F.lit(True)
    rows = rows.select("line_id", "pos", "word_id", "sense", "n_senses", *([] if draw else ["noise"]), own.alias("own"))
    return _cut(rows, window, chunk_tokens)


def _cut(rows: DataFrame, window: int, chunk_tokens: int) -> DataFrame:
    """Each row in its own chunk and, not ``own``, in the next ones it is a neighbour of."""
    size = max(chunk_tokens, window)
    home, place = F.floor(F.col("pos") / size).cast("int"), F.col("pos") % size
    before = F.when((place < window) & (home > 0), home - 1)
    after = F.when(place >= size - window, home + 1)
    cut = rows.withColumn("_home", home).withColumn("chunk", F.explode(F.array_compact(F.array(before, home, after))))
    return cut.withColumn("own", F.col("own") & (F.col("chunk") == F.col("_home"))).drop("_home")


def touched_rows(sample: DataFrame, model: DataFrame, all_senses: bool) -> DataFrame:
    """Model rows each group can touch -> ``(grp, tbl, code, vec)``.

    A word sense is wanted at most once per group, so even the most frequent one cannot
    skew this join. ``all_senses`` brings those of tokens, whose sense may change.
    """
    own = F.array(encode_ws(F.col("word_id"), F.col("sense")))
    if all_senses:
        own = F.concat(own, F.transform(F.sequence(F.lit(0), F.col("n_senses") - 1), lambda s: encode_ws(F.col("word_id"), s)))
    wanted = F.array(F.struct(F.lit("in").alias("tbl"), own.alias("codes")), F.struct(F.lit("out").alias("tbl"), F.concat(own, "noise").alias("codes")))
    needed = sample.select("grp", F.explode(wanted).alias("_w")).select("grp", "_w.tbl", F.explode("_w.codes").alias("code")).distinct()
    rows = model.select("tbl", encode_ws(F.col("word_id"), F.col("sense")).alias("code"), "vec")
    found = needed.join(rows, ["tbl", "code"])
    # fresh column identities, since both sides of the cogroup come from ``sample``
    return found.select(*[F.col(c).alias(c) for c in ("grp", "tbl", "code", "vec")])


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _as_lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))


def _drawn(tokens: pa.Table, draw: Callable | None) -> pa.Table:
    return pa.Table.from_batches(draw(tokens.to_batches())) if draw and tokens.num_rows else tokens


class _Group:
    """The arrays of one group, ordered by line and position; chunks of a line stand as lines.

    ``tables`` gives the model rows that the group can touch, by the codes of its tokens and of its targets.
    """

    def __init__(self, tokens: pa.Table, tables: Callable, all_senses: bool = False):
        col = lambda name: tokens.column(name).to_numpy()
        line = col("line_id")
        chunk = col("chunk") if "chunk" in tokens.column_names else np.zeros(len(line), np.int64)
        tokens = tokens.take(np.lexsort((col("pos"), chunk, line)))
        self.line, self.pos, self.words, self.senses, self.n_senses, self.own = (
            col(c) for c in ("line_id", "pos", "word_id", "sense", "n_senses", "own"))
        self.chunk = col("chunk") if "chunk" in tokens.column_names else np.zeros(len(line), np.int64)
        self.tokens = tokens
        starts = np.r_[True, (self.line[1:] != self.line[:-1]) | (self.chunk[1:] != self.chunk[:-1])]
        at = np.flatnonzero(starts)
        which = np.cumsum(starts) - 1
        self.first = at[which]
        self.last = np.r_[at[1:], len(line)][which] - 1
        noise = tokens.column("noise").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        k = len(noise) // max(1, len(line))
        base = self.words.astype(np.int64) * SENSE_BASE
        codes = [base + self.senses]
        if all_senses:
            codes += [(base + s)[self.n_senses > s] for s in range(int(self.n_senses.max()))]
        codes = np.concatenate(codes)
        self.inputs, self.outputs = tables(codes, np.concatenate([codes, noise]))
        self.negatives = self.outputs.of(noise).reshape(len(line), k)


def _tables(params: pa.Table, dim: int) -> list[kernels.Rows]:
    """The input and the output rows of model rows ``(tbl, code, vec)``."""
    found = []
    for table in ("in", "out"):
        rows = params.filter(pc.equal(params.column("tbl"), table))
        found.append(kernels.Rows(rows.column("code").to_numpy(), _lists(rows.column("vec"), dim)))
    return found


#: bytes of model rows that every task may hold
MODEL_BYTES = 128 << 20


def held_model(model: DataFrame, dim: int) -> list[kernels.Rows] | None:
    """Both tables of a model of at most ``MODEL_BYTES``, for tasks to hold; None for a larger one."""
    if model.count() * (4 * dim + 8) > MODEL_BYTES:
        return None
    return _tables(model.select("tbl", encode_ws(F.col("word_id"), F.col("sense")).alias("code"), "vec").toArrow(), dim)


def _of_held(held: list[kernels.Rows]) -> Callable:
    return lambda own, out: (held[0].part(own), held[1].part(out))


cloudpickle.register_pickle_by_value(sys.modules[__name__])


SLOTS_PER_GROUP = 4  # so that few groups share a task by hash and idle cores pick up the next


def per_group(sample: DataFrame, model: DataFrame, all_senses: bool, run: Callable, schema: str, dim: int, groups: int | None = None,
              draw: Callable | None = None) -> DataFrame:
    """``run(group)`` of each group, as Arrow tables.

    A model of at most ``MODEL_BYTES`` is held by the tasks, and only tokens move. Of a larger one
    each group gets the rows it can touch; those go through a join and a shuffle.
    """
    held = held_model(model, dim)
    if held is not None:
        def alone(tokens):
            return run(_Group(_drawn(tokens, draw), _of_held(held), all_senses))

        sample = sample.repartition(SLOTS_PER_GROUP * groups, "grp") if groups else sample
        return sample.groupBy("grp").applyInArrow(alone, schema)
    if draw:
        sample = sample.mapInArrow(draw, with_noise_field(sample.schema))

    def together(tokens, params):
        found = _tables(params, dim)
        return run(_Group(tokens, lambda own, out: found, all_senses))

    params = touched_rows(sample, model, all_senses)
    if groups:
        slots = SLOTS_PER_GROUP * groups
        sample, params = sample.repartition(slots, "grp"), params.repartition(slots, "grp")
    return sample.groupBy("grp").cogroup(params.groupBy("grp")).applyInArrow(together, schema)


#: tokens of a chunk of ``chunks.line_chunks``
GROUP_TOKENS = 8192

#: tokens of a task that streams blocks of whole chunks
TASK_TOKENS = 1 << 21


def _blocks(batches, size: int):
    """Tables of about ``size`` rows of a sorted stream, cut between chunks of lines."""
    waiting, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(waiting).combine_chunks()
            keys = [table.column(c).to_numpy() for c in ("line_id", "chunk") if c in table.column_names]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end:
                yield table.slice(0, end)
            waiting, rows = table.slice(end).to_batches(), table.num_rows - end
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks()


def per_block(rows: DataFrame, held: list[kernels.Rows], all_senses: bool, run: Callable, schema: str, tokens: int, block: int,
              draw: Callable | None = None, finish: Callable | None = None) -> DataFrame:
    """``run(group)`` of blocks of about ``block`` tokens, whole lines or chunks, in tasks that hold the model.

    ``tokens`` is the number of all rows. ``finish`` gives what a task hands on after its last block; with it
    there are as many tasks as cores, whatever the corpus, so that what they hand on does not grow with it.
    Rows of ``chunks.line_chunks`` are read where they stand.
    """
    keys = [c for c in ("line_id", "chunk") if c in rows.columns]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    whole = is_chunked(rows)

    def task(batches):
        state: dict = {}
        for table in _blocks(opened(batches) if whole else batches, block):
            found = run(_Group(_drawn(table, draw), _of_held(held), all_senses), *([state] if finish else []))
            if found is not None:
                yield from found.to_batches()
        if finish and state:
            yield from finish(state)

    if whole:
        return (rows.coalesce(cores) if finish else rows).mapInArrow(task, schema)
    tasks = min(cores, -(-tokens // 8192)) if finish else max(-(-tokens // TASK_TOKENS), min(2 * cores, -(-tokens // 8192)))
    return rows.repartition(max(1, tasks), *keys).sortWithinPartitions(*keys, "pos").mapInArrow(task, schema)


def grouped(rows: DataFrame, tokens: int, block: int) -> DataFrame:
    """``grp`` for chunks of a corpus whose model no task can hold."""
    return rows.withColumn("grp", F.pmod(F.xxhash64("line_id", "chunk"), F.lit(max(1, -(-tokens // block)))))


def _loss_of(cfg: TrainConfig) -> tuple[Callable, int]:
    """The loss of a pair's scores, and its predictions."""
    return (kernels.softmax_loss, 1) if cfg.softmax else (kernels.sigmoid_loss, 0)


#: tokens whose lines a task that holds the model advances side by side
ASSIGN_TOKENS = 1 << 19
#: bytes of their vectors in double precision
ASSIGN_BYTES = 128 << 20


#: tokens of a line that a compiled step takes whole
LINE_TOKENS = 1 << 20


def assign_senses(
    sample: DataFrame, model: DataFrame, cfg: TrainConfig, with_loss: bool = False, groups: int | None = None,
    draw: Callable | None = None, as_chunks: bool = False,
) -> DataFrame:
    """Sequential sense assignment -> ``(line_id, pos, word_id, n_senses, sense, passes, loss, n)``.

    ``passes`` stands at the first token of a sentence and counts the passes that changed
    it; ``loss`` and ``n`` are filled with ``with_loss``, from the senses found. Lines above
    ``cfg.chunk_tokens`` tokens are cut into chunks, with the same result. Lines do not influence each
    other, so tasks that hold the model take many at once, whatever their groups. Rows of ``chunks.line_chunks`` are
    read where they stand; with ``as_chunks`` such rows are returned, with the senses found.
    """
    window, dim, softmax = cfg.window, cfg.dim, cfg.softmax
    passes = 0 if cfg.one_sense else cfg.max_passes
    if is_chunked(sample):
        found = _assign_in_place(sample, model, cfg, with_loss, draw, as_chunks)
        if found is not None:
            return found
        sample = _tokens(sample)
    if as_chunks:
        tokens = assign_senses(sample, model, cfg, with_loss, groups, draw)
        return line_chunks(tokens.repartition("line_id").sortWithinPartitions("line_id", "pos"), window, GROUP_TOKENS)

    def run(g):
        senses, changed = kernels.assign(g.words, g.senses, g.n_senses, g.first, g.last, g.own, g.negatives,
                                         g.inputs, g.outputs, window, passes, softmax)
        out = [g.line, g.pos, g.words, g.n_senses, senses, changed, *_losses(g, senses, cfg, with_loss)]
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _ASSIGNED)], schema=_ASSIGNED).filter(pa.array(g.own))

    held = held_model(model, dim)

    def short(rows):
        if held is None:
            return per_group(rows, model, True, run, ASSIGNED, dim, groups, draw)
        block = max(1, min(ASSIGN_TOKENS, ASSIGN_BYTES // (8 * dim)))
        return per_block(rows.drop("grp"), held, True, run, ASSIGNED, rows.count(), block, draw)

    long_lines = sample.filter(F.col("pos") >= cfg.chunk_tokens).select("line_id").distinct()
    if long_lines.isEmpty():
        return short(sample)
    long_lines = materialize(long_lines, "longlines")
    rest = sample.join(long_lines, "line_id", "left_anti")
    cut = _cut(sample.join(long_lines, "line_id", "left_semi").drop("grp"), window, cfg.chunk_tokens)
    return short(rest).unionByName(_assign_chunks(cut, model, cfg, with_loss, draw))


def _tokens(sample: DataFrame) -> DataFrame:
    """Chunks as single tokens."""
    return chunk_tokens(sample).withColumn("own", F.lit(True))


def _assign_in_place(sample: DataFrame, model: DataFrame, cfg: TrainConfig, with_loss: bool, draw: Callable | None, as_chunks: bool) -> DataFrame | None:
    """:func:`assign_senses` by the compiled step, or None.

    Only chunks of lines that have several move, to each other; lines above ``LINE_TOKENS`` tokens are cut as they are elsewhere.
    """
    held = held_model(model, cfg.dim) if draw else None
    step = held and compiled.steps(sample.sparkSession, held, draw, "chunks" if as_chunks else "assign", cfg.dim, cfg.window,
                                   0 if cfg.one_sense else cfg.max_passes, 1, cfg.softmax, with_loss)
    if not step:
        return None
    rows, rest = sample.select("line_id", "chunk", "start", "lead", "own", *LISTS), None
    huge = rows.filter(F.col("start") >= LINE_TOKENS).select("line_id").distinct()
    if not huge.isEmpty():
        huge = materialize(huge, "hugelines")
        rest = assign_senses(_tokens(rows.join(huge, "line_id", "left_semi")), model, cfg, with_loss, None, draw, as_chunks)
        rows = rows.join(huge, "line_id", "left_anti")
    several = (F.col("chunk") > 0) | (F.size("word_id") > F.col("lead") + F.col("own"))
    together = rows.filter(several).repartition("line_id").sortWithinPartitions("line_id", "chunk")
    found = compiled.run(rows.filter(~several).unionByName(together), step, CHUNK if as_chunks else ASSIGNED)
    return found if rest is None else found.unionByName(rest)


def _losses(g: _Group, senses: np.ndarray, cfg: TrainConfig, wanted: bool) -> tuple:
    """Loss and predictions of the own tokens, or nulls."""
    if not wanted:
        return [None] * len(senses), [None] * len(senses)
    reduce, per_pair = _loss_of(cfg)
    return kernels.centre_losses(g.words, senses, g.first, g.last, g.own, g.negatives, g.inputs, g.outputs, cfg.window,
                                 reduce, per_pair or 1 + g.negatives.shape[1])


CHUNK_ASSIGNED = f"{ASSIGNED}, chunk int, history array<int>"
_CHUNK_ASSIGNED = pa.schema([*_ASSIGNED, ("chunk", pa.int32()), ("history", pa.list_(pa.int32()))])
_EDGE = ["line_id", "chunk", "pos"]


def _assign_chunks(cut: DataFrame, model: DataFrame, cfg: TrainConfig, with_loss: bool, draw: Callable | None = None) -> DataFrame:
    """Sense assignment of long lines, all chunks at once; those of a group go side by side, a token of each at a time.

    A chunk needs the senses of its halo after each pass. At first they are taken to stay as
    they are; then every chunk whose neighbours showed something else is done again, until none
    is. What a token does in a pass depends only on earlier passes and on tokens to its left,
    so the result is that of one run through the whole line. Influence fades within a few
    tokens, so few chunks are done more than twice.
    """
    window, dim, softmax = cfg.window, cfg.dim, cfg.softmax
    passes = 0 if cfg.one_sense else cfg.max_passes
    size = max(cfg.chunk_tokens, window)

    def run(g):
        around = np.flatnonzero(~g.own)
        told = np.array(g.tokens.column("history").take(around).to_pylist(), dtype=np.int64).reshape(len(around), passes)
        halo = kernels.Halo(around, told, g.senses[around], g.pos[around] < g.chunk[around] * size)
        edge = np.flatnonzero(g.own & ((g.pos % size < window) | (g.pos % size >= size - window)))
        senses, changed, seen = kernels.assign(g.words, g.senses, g.n_senses, g.first, g.last, g.own, g.negatives,
                                               g.inputs, g.outputs, window, passes, softmax, halo, edge)
        history: list = [None] * len(senses)
        for row, after in zip(edge.tolist(), seen.tolist()):
            history[row] = after
        out = [g.line, g.pos, g.words, g.n_senses, senses, changed[g.first], *_losses(g, senses, cfg, with_loss), g.chunk, history]
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _CHUNK_ASSIGNED)], schema=_CHUNK_ASSIGNED).filter(pa.array(g.own))

    tables = Versions(cut.sparkSession)
    cut = tables.put("chunks", cut)
    groups = -(-cut.count() // cfg.group_tokens)
    cut = cut.withColumn("grp", F.pmod(F.xxhash64("line_id", "chunk"), F.lit(groups)))
    halos = cut.filter("NOT own")
    told = tables.put("told", halos.select(*_EDGE, F.array_repeat("sense", passes).alias("history")))
    again, done = cut.filter("own").select("line_id", "chunk").distinct(), None
    while True:
        rows = cut.join(again, ["line_id", "chunk"], "left_semi").join(told, _EDGE, "left")
        fresh = per_group(rows, model, True, run, CHUNK_ASSIGNED, dim, draw=draw)
        if done is not None:
            fresh = done.join(again, ["line_id", "chunk"], "left_anti").unionByName(fresh)
        done = tables.put("done", fresh)
        shown = done.filter("history IS NOT NULL").select("line_id", "pos", "history")
        new = halos.select(*_EDGE).join(shown, ["line_id", "pos"]).select(*_EDGE, "history")
        other = new.join(told.withColumnRenamed("history", "_told"), _EDGE).filter("history <> _told").select("line_id", "chunk").distinct()
        again = tables.put("again", other)
        if again.isEmpty():
            break
        told = tables.put("told", new)
    for name in ("chunks", "told", "again"):
        tables.drop(name)
    counted = done.select("line_id", "chunk", "passes").distinct().groupBy("line_id").agg(F.max("passes").alias("_passes"))
    return done.join(counted, "line_id").select(
        "line_id", "pos", "word_id", "n_senses", "sense", F.when(F.col("pos") == 0, F.col("_passes")).otherwise(0).alias("passes"), "loss", "n")


def learn_shard(
    sample: DataFrame, model: DataFrame, alpha: float, cfg: TrainConfig, groups: int | None = None, draw: Callable | None = None,
    summed: bool = False,
) -> DataFrame:
    """One pass of gradient descent, each group on its own copy of the rows it touches.

    Returns the changes ``(tbl, word_id, sense, delta)`` and one row per group with ``tbl``
    'group' holding its loss, predictions and words. ``summed`` is for those who add the changes up anyway: a task
    that holds the model then gives one row per model row, the sum of its groups, and there are as many tasks as cores.
    """
    window, dim, softmax, lockstep = cfg.window, cfg.dim, cfg.softmax, cfg.lockstep
    if is_chunked(sample):
        groups = groups or sample.select("grp").distinct().count()
        found = _learn_in_place(sample, model, alpha, cfg, groups, draw, summed)
        if found is not None:
            return found
        sample = _tokens(sample)

    def descend(gs):
        """Groups side by side: the rows of each stand behind those of the group before it."""
        rows = [[getattr(g, t) for g in gs] for t in ("inputs", "outputs")]
        before = [np.concatenate([r.vec for r in of]) for of in rows]
        after = [b.copy() for b in before]  # what Arrow holds cannot be written
        ends = [np.cumsum([0] + [len(r.code) for r in of]) for of in rows]
        at = np.cumsum([0] + [len(g.words) for g in gs])
        joined = lambda parts, shift: np.concatenate([x + d for x, d in zip(parts, shift.tolist())])
        centre = joined([g.inputs.at(g.words, g.senses) for g in gs], ends[0])
        target = joined([kernels.targets(g.words, g.senses, g.negatives, g.outputs) for g in gs], ends[1])
        first, last = joined([g.first for g in gs], at), joined([g.last for g in gs], at)
        own, copy = np.concatenate([g.own for g in gs]), np.repeat(np.arange(len(gs)), np.diff(at))
        loss, n = kernels.learn_copies(centre, target, first, last, own, copy, len(gs), *after, window, np.float32(alpha), softmax, lockstep)
        none = [None] * len(gs)
        out = [pa.table([["group"] * len(gs), [-1] * len(gs), [-1] * len(gs), none, loss, n, [int(g.own.sum()) for g in gs]], schema=_LEARNED)]
        for table, of, end, old, now in zip(("in", "out"), rows, ends, before, after):
            for r, s, e in zip(of, end[:-1], end[1:]):
                delta = now[s:e].astype(np.float64) - old[s:e]
                moved = np.flatnonzero(delta.any(axis=1))
                none = pa.nulls(len(moved))
                out.append(pa.table([pa.array([table] * len(moved), pa.string()), *_words(r.code[moved]), _as_lists(delta[moved]),
                                     *[none.cast(f.type) for f in list(_LEARNED)[4:]]], schema=_LEARNED))
        return pa.concat_tables(out)

    held = held_model(model, dim)
    if held is None:
        return per_group(sample, model, False, lambda g: descend([g]), LEARNED, dim, groups, draw)
    return side_by_side(sample, held, descend, LEARNED, cfg, groups or sample.select("grp").distinct().count(), draw)


def _learn_in_place(sample: DataFrame, model: DataFrame, alpha: float, cfg: TrainConfig, groups: int, draw: Callable | None, summed: bool) -> DataFrame | None:
    """:func:`learn_shard` by the compiled step, or None. Chunks travel to their groups as they are, a few bytes a token."""
    held = held_model(model, cfg.dim) if draw else None
    step = held and compiled.steps(sample.sparkSession, held, draw, "sum" if summed else "learn", cfg.dim, cfg.window, 0, cfg.lockstep, cfg.softmax, False, alpha)
    if not step:
        return None
    cores = sample.sparkSession.sparkContext.defaultParallelism
    parts = _parts(groups, cfg, cores)
    rows = sample.select("grp", "line_id", "chunk", "start", "lead", "own", "word_id", "sense")
    dealt = rows.repartitionById(parts, F.pmod(F.col("grp"), F.lit(parts)).cast("int")).sortWithinPartitions("grp", "line_id", "chunk")
    return compiled.run(dealt.coalesce(cores) if summed else dealt, step, LEARNED)


def _parts(groups: int, cfg: TrainConfig, cores: int) -> int:
    """Equal tasks for so many groups, as many at a time as there are cores."""
    rounds = max(1, -(-groups * cfg.group_tokens // (TASK_TOKENS * cores)))
    return max(1, min(groups, cores * rounds))


#: bytes that a task may hold of the groups it advances side by side, one group at least
SIDE_BYTES = 512 << 20


def side_by_side(sample: DataFrame, held: list[kernels.Rows], run: Callable, schema: str, cfg: TrainConfig, groups: int, draw: Callable | None) -> DataFrame:
    """``run(groups)`` of several whole groups at a time, in tasks that hold the model."""
    # a token's columns, target rows and pairs, and the vectors of its rows before and after
    targets = 1 + cfg.num_negative
    token = 80 + 16 * targets + 80 * cfg.window + 8 * cfg.dim * (1 + targets)
    room = SIDE_BYTES // token
    cores = sample.sparkSession.sparkContext.defaultParallelism
    tasks = _parts(groups, cfg, cores)

    def task(batches):
        waiting, rows = [], 0
        for table in _whole_groups(batches):
            if waiting and rows + table.num_rows > room:
                yield from run(waiting).to_batches()
                waiting, rows = [], 0
            waiting.append(_Group(_drawn(table, draw), _of_held(held)))
            rows += table.num_rows
        if waiting:
            yield from run(waiting).to_batches()

    dealt = sample.repartitionById(tasks, F.pmod(F.col("grp"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("grp").mapInArrow(task, schema)


def _whole_groups(batches):
    """One table per group of a stream that is sorted by ``grp``."""
    waiting, group = [], None
    for batch in batches:
        of = batch.column("grp").to_numpy()
        cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else []
        for s, e in zip(cuts[:-1], cuts[1:]):
            if waiting and of[s] != group:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            group = of[s]
            waiting.append(batch.slice(s, e - s))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _words(code: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array((code // SENSE_BASE).astype(np.int32)), pa.array((code % SENSE_BASE).astype(np.int32))


def gradient_parts(rows: DataFrame, model: DataFrame, dim: int, window: int, weight: Callable, tokens: int, block: int,
                   draw: Callable | None = None, groups: int | None = None) -> DataFrame:
    """The full-batch gradient ``(tbl, word_id, sense, grad)``, summed inside each task first.

    A task that holds the model hands on one row per model row that its pairs reached, one that
    does not a row per group and model row; never one per scored pair.
    """
    names, schema = ("in", "out"), "tbl string, word_id int, sense int, grad array<double>"

    def summed(g):
        of = g.words, g.senses, g.first, g.last, g.own, g.negatives, g.inputs, g.outputs, window
        return kernels.gradient(*of, weight), kernels.reached(*of)

    def part(table, code, grad):
        return pa.table([pa.array([table] * len(code), pa.string()), *_words(code), _as_lists(grad)], schema=_GRADIENT)

    held = held_model(model, dim)
    if held is not None:
        def add(g, state):
            sums, reached = summed(g)
            for table, whole, r, grad, some in zip(names, held, (g.inputs, g.outputs), sums, reached):
                total, seen = state.setdefault(table, (np.zeros(whole.vec.shape), np.zeros(len(whole.code), bool)))
                at = r.place[some]
                total[at] += grad[some]
                seen[at] = True

        def finish(state):
            for table, whole in zip(names, held):
                total, seen = state[table]
                some = np.flatnonzero(seen)
                for s in range(0, len(some), SLICE_ROWS):
                    at = some[s : s + SLICE_ROWS]
                    yield from part(table, whole.code[at], total[at]).to_batches()

        parts = per_block(rows.drop("grp"), held, False, add, schema, tokens, block, draw, finish)
        return vector_sums(parts, ["tbl", "word_id", "sense"], "grad", combine=False).drop("n")

    def run(g):
        sums, reached = summed(g)
        return pa.concat_tables([part(t, r.code[some], grad[some]) for t, r, grad, some in zip(names, (g.inputs, g.outputs), sums, reached)])

    rows = chunk_tokens(rows, halo=True) if is_chunked(rows) else rows
    rows = rows if "grp" in rows.columns else grouped(rows, tokens, block)
    return vector_sums(per_group(rows, model, False, run, schema, dim, groups, draw), ["tbl", "word_id", "sense"], "grad").drop("n")


SLICE_ROWS = 65_536  # rows of sums handed on at a time


def batch_gradient_by_group(sample: DataFrame, model: DataFrame, cfg: TrainConfig, groups: int | None = None, draw: Callable | None = None) -> DataFrame:
    """The gradient over the groups that descent uses, with the table sigmoid or softmax."""
    weight = kernels.softmax_weight if cfg.softmax else kernels.sigmoid_weight
    tokens = groups * cfg.group_tokens if groups else sample.count()
    return gradient_parts(sample, model, cfg.dim, cfg.window, weight, tokens, GRADIENT_TOKENS, draw, groups)


#: tokens of a block whose gradient is summed at a time
GRADIENT_TOKENS = 32_768
