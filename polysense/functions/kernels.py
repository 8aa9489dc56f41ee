"""Numpy helpers for loss, gradients and the two steps that are sequential inside a sentence.

They work on what one Arrow task holds: the tokens of a bounded group of sentences and
the model rows those tokens can touch. ``words``/``senses`` are aligned with the rows;
``first``/``last`` bound the sentence of each row.
"""

from __future__ import annotations

from itertools import cycle

import numpy as np

from polysense.functions.draws import MULTIPLIERS, P
from polysense.functions.vecmath import SIGMOID_FACTOR, SIGMOID_MAX, SIGMOID_SIZE

_T = np.exp((np.arange(SIGMOID_SIZE) * 2.0 / SIGMOID_SIZE - 1.0) * SIGMOID_MAX)
SIGMOID = _T / (_T + 1.0)
LOSS_TRUE, LOSS_NOISE = -np.log(SIGMOID), -np.log(1.0 - SIGMOID)
NEGATED = (-SIGMOID).astype(np.float32)
SENSE_BASE = 100

# 6.0 itself falls below the end of the table, anything larger on its last entry
ABOVE = SIGMOID_MAX + 1.0 / SIGMOID_FACTOR
_TOP = int(2 * SIGMOID_MAX * SIGMOID_FACTOR)
BIN_AT = np.r_[np.arange(_TOP + 1), SIGMOID_SIZE - 1, SIGMOID_SIZE - 1].astype(np.intp)


def bins(x: np.ndarray) -> np.ndarray:
    """Row of the sigmoid table for each x."""
    x = np.where(x > SIGMOID_MAX, ABOVE, np.maximum(x, -SIGMOID_MAX, dtype=np.float64))
    return BIN_AT[((x + SIGMOID_MAX) * SIGMOID_FACTOR).astype(np.intp)]


def mix(x: np.ndarray) -> np.ndarray:
    """``x^5 mod P`` of the portable draws."""
    square = x * x % P
    return square * square % P * x % P


def draw(state: np.ndarray | int, *keys: tuple[np.ndarray, int]) -> np.ndarray:
    """A chain of draws continued with keys and their multipliers."""
    for key, multiplier in keys:
        state = mix((state + key % P * multiplier) % P)
    return state


def noise_words(keys, word, hi, n_senses, k: int, word_state: int, sense_state: int) -> np.ndarray:
    """Codes of ``k`` noise words of each token, ``(tokens, k)``: the draws of ``negative_samples``.

    ``keys`` name a token in its draws; ``hi`` and ``n_senses`` belong to all words by id,
    ``hi`` being the running sum of their weights. The part of the chain that a token's
    draws share is computed once.
    """
    item = (np.arange(k, dtype=np.int64), MULTIPLIERS[len(keys) % len(MULTIPLIERS)])
    token = list(zip(keys, cycle(MULTIPLIERS)))
    dw, ds = (draw(draw(state, *token)[:, None], item) for state in (word_state, sense_state))
    dx = mix((dw + MULTIPLIERS[0]) % P)
    lo = np.concatenate(([0], hi))[word]
    wt = hi[word] - lo
    rest = (hi[-1] - wt)[:, None]
    fine = (dw.astype(np.float64) + dx.astype(np.float64) / float(P)) / float(P)
    r = np.floor(fine * rest).astype(np.int64)
    r += np.where(r >= lo[:, None], wt[:, None], 0)
    drawn = np.searchsorted(hi, r, side="right")
    return drawn * SENSE_BASE + ds % n_senses[drawn]


class Rows:
    """Model rows of one table, found by word-sense code."""

    def __init__(self, code: np.ndarray, vecs: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.code, self.vec = code[order], vecs[order]

    def of(self, code: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.code, code)
        if code.size and (not len(self.code) or (self.code[np.minimum(at, len(self.code) - 1)] != code).any()):
            raise KeyError("a word sense has no model row")
        return at

    def part(self, code: np.ndarray) -> Rows:
        """Only the rows of these codes; ``place`` says where they stand here."""
        code = np.unique(code)
        at = np.minimum(np.searchsorted(self.code, code), max(0, len(self.code) - 1))
        known = self.code[at] == code if len(self.code) else np.zeros(len(code), bool)
        found = Rows(code[known], self.vec[at[known]])
        found.place = at[known]
        return found

    def at(self, words: np.ndarray, senses: np.ndarray) -> np.ndarray:
        return self.of(np.asarray(words, dtype=np.int64) * SENSE_BASE + senses)


def offsets(window: int) -> list[int]:
    return [d for d in range(-window, window + 1) if d]


def context(pos: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each centre's contexts and which of them exist."""
    at = pos[:, None] + np.array(offsets(window))
    inside = (at >= first[pos][:, None]) & (at <= last[pos][:, None])
    return np.where(inside, at, pos[:, None]), inside


# ---- scores of all pairs within a window


#: context positions whose target vectors are held at a time
BLOCK = 1024


def windows(values: np.ndarray, window: int) -> np.ndarray:
    """For each row a view of the rows around it, ``(n, dim, 2 * window + 1)``; zeros beyond the ends."""
    padded = np.pad(values, ((window, window), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * window + 1, axis=0)


def by_centre(at_context: np.ndarray, window: int) -> np.ndarray:
    """Values by context and place of the centre around it -> by centre and offset of the context."""
    n = len(at_context)
    out = np.zeros((n, 2 * window))
    for i, d in enumerate(offsets(window)):
        low, high = max(0, -d), n - max(0, d)
        if high > low:
            out[low:high, i] = at_context[low + d : high + d, window - d]
    return out


def pair_values(centre, target, inputs, outputs, window, reduce, wanted=None) -> np.ndarray:
    """``reduce`` of the scores of each (centre, context) pair -> ``(n, 2 * window)`` by centre and offset.

    The target vectors of a context position are fetched once and multiplied with all the
    centres around it; scores of rows of other sentences come out too and are to be masked.
    ``wanted`` marks the centres that matter.
    """
    near = windows(inputs.vec[centre].astype(np.float64), window)
    at_context = np.zeros((len(centre), 2 * window + 1))
    rows = np.arange(len(centre))
    if wanted is not None:
        rows = np.flatnonzero(np.convolve(wanted, np.ones(2 * window + 1), "full")[window : window + len(centre)] > 0)
    for s in range(0, len(rows), BLOCK):
        part = rows[s : s + BLOCK]
        at_context[part] = reduce(outputs.vec[target[part]].astype(np.float64) @ near[part])
    return by_centre(at_context, window)


def noise_loss(x: np.ndarray) -> np.ndarray:
    return LOSS_NOISE[bins(x)].sum(axis=1)


def noise_log(x: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of the noise scores, -inf without any."""
    return np.logaddexp.reduce(x, axis=1, initial=-np.inf)


def sigmoid_loss(x: np.ndarray) -> np.ndarray:
    return LOSS_TRUE[bins(x[:, 0])] + noise_loss(x[:, 1:])


def exact_loss(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -x[:, 0]) + np.logaddexp(0.0, x[:, 1:]).sum(axis=1)


def softmax_loss(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[:, 0], noise_log(x[:, 1:])) - x[:, 0]


def targets(words, senses, negatives, outputs) -> np.ndarray:
    """Output rows a context position asks for: its own word sense, then its noise words."""
    return np.concatenate([outputs.at(words, senses)[:, None], negatives], axis=1)


def pair_losses(words, senses, first, last, negatives, inputs, outputs, window, reduce, cand=None, wanted=None):
    """Loss of each pair by centre and offset, the rows of the contexts, and which exist.

    ``cand`` replaces the centres' own senses, ``wanted`` marks the centres that matter.
    """
    centre = inputs.at(words, senses if cand is None else cand)
    loss = pair_values(centre, targets(words, senses, negatives, outputs), inputs, outputs, window, reduce, wanted)
    ctx, inside = context(np.arange(len(words)), first, last, window)
    return loss, ctx, inside if wanted is None else inside & wanted[:, None]


def centre_losses(words, senses, first, last, own, negatives, inputs, outputs, window, reduce, per_pair):
    """Loss and number of predictions of each own row as a centre."""
    loss, _, inside = pair_losses(words, senses, first, last, negatives, inputs, outputs, window, reduce, wanted=own)
    return (loss * inside).sum(axis=1), inside.sum(axis=1) * per_pair


def gradient(words, senses, first, last, own, negatives, inputs, outputs, window, weight):
    """Summed loss gradient of the own rows as centres -> arrays shaped like the two tables.

    ``weight`` turns scores ``(n, targets, centres)`` into derivatives.
    """
    target, centre = targets(words, senses, negatives, outputs), inputs.at(words, senses)
    d_in, d_out = np.zeros(inputs.vec.shape), np.zeros(outputs.vec.shape)
    near = windows(inputs.vec[centre].astype(np.float64), window)
    pulled = np.zeros((len(centre) + 2 * window, d_in.shape[1]))
    n, places = len(centre), np.arange(2 * window + 1) - window
    for s in range(0, n, BLOCK):
        rows = np.arange(s, min(s + BLOCK, n))
        around = rows[:, None] + places
        real = (around >= first[rows][:, None]) & (around <= last[rows][:, None]) & (places != 0)
        real &= own[np.clip(around, 0, n - 1)]
        t, u = outputs.vec[target[rows]].astype(np.float64), near[rows]
        push = weight(t @ u) * real[:, None, :]
        add_rows(d_out, target[rows].ravel(), (push @ u.transpose(0, 2, 1)).reshape(-1, d_in.shape[1]))
        back = push.transpose(0, 2, 1) @ t
        for j in range(2 * window + 1):
            pulled[s + j : s + j + len(rows)] += back[:, j]
    add_rows(d_in, centre, pulled[window : window + n])
    return d_in, d_out


def reached(words, senses, first, last, own, negatives, inputs, outputs, window):
    """Rows of the two tables that some pair of an own centre and its context touches."""
    ctx, inside = context(np.flatnonzero(own), first, last, window)
    centre = np.flatnonzero(own)[inside.any(axis=1)]
    around = np.unique(ctx[inside])
    target = targets(words, senses, negatives, outputs)
    return np.unique(inputs.at(words[centre], senses[centre])), np.unique(target[around])


def sigmoid_weight(x: np.ndarray) -> np.ndarray:
    g = SIGMOID[bins(x)]
    g[:, 0] -= 1.0
    return g


def exact_weight(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = 1.0 / (1.0 + np.exp(-x))
    g[:, 0] -= 1.0
    return g


def softmax_weight(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    g = e / e.sum(axis=1, keepdims=True)
    g[:, 0] -= 1.0
    return g


# ---- sense assignment


class Halo:
    """Tokens of the neighbouring chunks of a long line, whose senses after each pass are given.

    ``rows`` are their row numbers, ``history`` their senses after each pass. A pass goes from
    left to right: it finds those on the left as the same pass left them, those on the
    right as the pass before did.
    """

    def __init__(self, rows: np.ndarray, history: np.ndarray, start: np.ndarray, left: np.ndarray):
        self.rows, self.left = rows, left
        self.history = np.concatenate([start[:, None], history], axis=1)  # column p: after p passes

    def enter(self, senses: np.ndarray, turn: int) -> None:
        """Senses as pass ``turn`` finds them, counted from 0."""
        senses[self.rows] = self.history[np.arange(len(self.rows)), turn + self.left]

    def leave(self, senses: np.ndarray) -> None:
        senses[self.rows] = self.history[:, -1]

    def last_change(self) -> np.ndarray:
        """Number of the last pass at which a row has a new sense to show, 0 if it never has."""
        moved = self.history[:, 1:] != self.history[:, :-1]
        late = np.where(moved.any(axis=1), moved.shape[1] - moved[:, ::-1].argmax(axis=1), 0) if moved.shape[1] else np.zeros(len(self.rows), int)
        return np.where(late > 0, late - 1 + ~self.left, -1)


def assign(words, senses, n_senses, first, last, own, negatives, inputs, outputs, window, max_passes, softmax, halo=None, watched=None):
    """Left-to-right sense assignment, repeated until a pass changes nothing.

    Sentences do not influence each other, so the i-th ambiguous token of all of them is
    decided together; within a sentence each decision sees the ones before it. The noise
    part of a candidate's loss does not depend on the senses of the context and is
    computed once. Returns the senses and, per row, the changing passes of its sentence.

    With a ``halo``, sentences are chunks of long lines, a pass that changes nothing ends
    them only if the halo brings nothing new, and the number of the last changing pass is
    given in place of their count. The senses of the rows ``watched`` after each pass come third.
    """
    senses = senses.copy()
    changed_passes = np.zeros(len(words), dtype=np.int64)
    seen = np.repeat(senses[watched][:, None], max_passes, axis=1) if watched is not None else None
    todo = np.flatnonzero(own & (n_senses > 1))
    if not len(todo):
        if halo is not None:
            halo.leave(senses)
        return (senses, changed_passes) if watched is None else (senses, changed_passes, seen)
    sizes = n_senses[todo]
    options = np.arange(sizes.max())
    real = options < sizes[:, None]
    cand = inputs.at(words[todo][:, None], np.where(real, options, 0))
    ctx, inside = context(todo, first, last, window)
    fixed = np.empty((len(todo), len(options), 2 * window))
    for option in options:
        wanted = np.zeros(len(words), bool)
        wanted[todo[real[:, option]]] = True
        centre = inputs.at(words, np.minimum(option, n_senses - 1))
        fixed[:, option] = pair_values(centre, negatives, inputs, outputs, window, noise_log if softmax else noise_loss, wanted)[todo]
    if not softmax:
        fixed = (fixed * inside[:, None, :]).sum(axis=2)
    _, sentence = np.unique(first[todo], return_inverse=True)
    starts = np.r_[True, sentence[1:] != sentence[:-1]]
    turn = np.arange(len(todo)) - np.flatnonzero(starts)[sentence]
    order = np.argsort(turn, kind="stable")
    by_turn = np.split(order, np.flatnonzero(np.diff(turn[order])) + 1)
    active = np.ones(sentence.max() + 1, dtype=bool)
    awaits = np.full(len(active), -1)  # the last pass at which a halo has something new
    if halo is not None and len(halo.rows):
        of = np.searchsorted(first[todo[starts]], first[halo.rows])
        of = np.minimum(of, len(active) - 1)
        here = first[todo[starts]][of] == first[halo.rows]  # a chunk without ambiguous words waits for nothing
        np.maximum.at(awaits, of[here], halo.last_change()[here])
    for turn in range(max_passes):
        if halo is not None:
            halo.enter(senses, turn)
        changed = np.zeros(len(active), dtype=bool)
        for rows in by_turn:
            rows = rows[active[sentence[rows]]]
            if not len(rows):
                continue
            v = outputs.vec[outputs.at(words[ctx[rows]], senses[ctx[rows]])].astype(np.float64)
            x = inputs.vec[cand[rows]].astype(np.float64) @ v.transpose(0, 2, 1)
            if softmax:
                loss = ((np.logaddexp(x, fixed[rows]) - x) * inside[rows][:, None, :]).sum(axis=2)
            else:
                loss = fixed[rows] + (LOSS_TRUE[bins(x)] * inside[rows][:, None, :]).sum(axis=2)
            loss = np.where(real[rows] & ~np.isnan(loss), loss, np.inf)
            old = senses[todo[rows]]
            best = np.where(np.isfinite(loss).any(axis=1), loss.argmin(axis=1), old)
            senses[todo[rows]] = best
            changed[sentence[rows[best != old]]] = True
        begin = first[todo[starts][changed]]
        changed_passes[begin] = turn + 1
        if watched is not None:
            seen[:, turn:] = senses[watched][:, None]
        active = changed | (awaits > turn)
        if not active.any():
            break
    if halo is not None:
        halo.leave(senses)
    return (senses, changed_passes) if watched is None else (senses, changed_passes, seen)


# ---- gradient descent


class _Sigmoid:
    """Weights ``label - sigma`` of the scores; column 0 is the true word. Losses are added up by copy."""

    def __init__(self, negated: np.ndarray, copies: int = 1):
        self.negated, self.seen, self.total = negated, [], np.zeros(copies)

    def record(self, at: np.ndarray, copy: np.ndarray) -> None:
        self.seen.append((at, copy))
        if len(self.seen) == 4096:
            self.flush()

    def pull(self, x: np.ndarray, copy: np.ndarray) -> np.ndarray:
        at = bins(x)
        self.record(at, copy)
        pull = self.negated[at]
        pull[..., 0] += 1.0
        return pull

    def flush(self) -> None:
        if self.seen:
            at, copy = (np.concatenate(x) for x in zip(*self.seen))
            self.total += np.bincount(copy, LOSS_TRUE[at[:, 0]] + LOSS_NOISE[at[:, 1:]].sum(axis=1), len(self.total))
            self.seen = []

    def loss(self) -> np.ndarray:
        self.flush()
        return self.total


class _Softmax:
    def __init__(self, kind: type, copies: int = 1):
        self.kind, self.total = kind, np.zeros(copies)

    def pull(self, x: np.ndarray, copy: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        p = e / e.sum(axis=-1, keepdims=True)
        self.total -= np.bincount(copy, np.log(p[..., 0]), len(self.total))
        p[..., 0] -= 1.0
        return (-p).astype(self.kind)

    def loss(self) -> np.ndarray:
        return self.total


def add_rows(table: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """``table[rows] += change`` with repeated rows added up."""
    order = rows.argsort(kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    table[rows[starts]] += np.add.reduceat(change[order], starts, axis=0)


def turns(rows: np.ndarray) -> list[np.ndarray]:
    """Places of the first, second, .. occurrences of each row number."""
    order = rows.argsort(kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
    nth = np.empty(len(rows), dtype=np.intp)
    nth[order] = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return [np.flatnonzero(nth == t) for t in range(nth.max() + 1)]


def visits(first, last, own, copy, window, lockstep):
    """All (centre, context) pairs by visit: ``(centre rows, context rows, bounds)``.

    The visits of a copy follow each other. One is a context place of one step of ``lockstep``
    sentences; the n-th visits of all copies stand together, between two of the ``bounds``.
    """
    rows = np.flatnonzero(own)
    ctx, inside = context(rows, first, last, window)
    begin = np.flatnonzero(first == np.arange(len(first)))
    nth = np.arange(len(begin)) - np.searchsorted(copy[begin], copy[begin])  # of a sentence in its copy
    which, place = np.nonzero(inside)
    c, p = rows[which].astype(np.int32), ctx[inside].astype(np.int32)
    block = nth[np.searchsorted(begin, first[c])] // lockstep
    step = (c - first[c]) * (2 * window) + place
    order = np.lexsort((c, step, block, copy[c])) if lockstep > 1 else np.arange(len(c))  # rows stand so already
    c, p, block, step = c[order], p[order], block[order], step[order]
    of = copy[c]
    new = np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1]) | (step[1:] != step[:-1])][: len(c)]
    visit = np.cumsum(new)
    visit -= visit[np.searchsorted(of, of)]  # counted from 0 in each copy
    order = np.argsort(visit, kind="stable")
    return c[order], p[order], np.r_[0, np.cumsum(np.bincount(visit))]


def learn(words, senses, first, last, own, negatives, inputs, outputs, window, alpha, softmax, lockstep):
    """:func:`learn_copies` of one copy: its loss and number of predictions."""
    target, centre = targets(words, senses, negatives, outputs), inputs.at(words, senses)
    loss, n = learn_copies(centre, target, first, last, own, np.zeros(len(words), np.int64), 1, inputs.vec, outputs.vec, window, alpha, softmax, lockstep)
    return float(loss[0]), int(n[0])


def learn_copies(centre, target, first, last, own, copy, copies, ins, outs, window, alpha, softmax, lockstep):
    """Gradient descent over the sentences of each copy in order, updating the rows in place.

    A centre visits its contexts from left to right; each visit moves the output rows of
    the context and its noise words, then the centre's input row. A noise word that was drawn
    twice is scored the second time after its first update (softmax needs all scores at
    once and adds such changes up). With ``lockstep`` > 1 that many sentences advance side by side and their simultaneous visits see the same
    rows; 1 is strictly sequential. Copies share no row of ``ins`` and ``outs``, so the n-th visits of
    all of them are made together, with the result of one copy after another. ``copy`` is that
    of each token, in ascending order. Returns loss and number of predictions by copy.
    """
    act = _Softmax(np.float32, copies) if softmax else _Sigmoid(NEGATED, copies)
    ordered = np.sort(target, axis=1)
    repeats = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)

    def visit_repeated(c: int, p: int) -> None:
        rows, u = target[p], ins[centre[c]]
        at, move = np.empty(len(rows), dtype=np.intp), np.zeros_like(u)
        for places in turns(rows):  # rows of one turn differ, so their order does not matter
            out = outs[rows[places]]
            at[places] = bins(out @ u)
            pull = act.negated[at[places]]
            if places[0] == 0:
                pull[0] += 1.0
            pull = alpha * pull
            move += pull @ out
            outs[rows[places]] = out + pull[:, None] * u
        act.record(at[None], copy[c : c + 1])
        u += move

    def visit(c: np.ndarray, p: np.ndarray, shared: bool) -> None:
        """``shared``: a row may stand in several places."""
        rows, own_rows = target[p], centre[c]
        u, out = ins[own_rows], outs[rows]
        pull = alpha * act.pull((out @ u[:, :, None])[:, :, 0], copy[c])
        change, move = pull[:, :, None] * u[:, None, :], (pull[:, None, :] @ out)[:, 0, :]
        if shared:
            add_rows(outs, rows.ravel(), change.reshape(-1, u.shape[1]))
            add_rows(ins, own_rows, move)
        else:
            outs[rows] = out + change
            ins[own_rows] = u + move

    centres, contexts, bounds = visits(first, last, own, copy, window, lockstep)
    again = repeats[contexts]
    any_again = np.add.reduceat(again, bounds[:-1], dtype=np.int64) > 0 if len(contexts) else again
    for v, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        c, p = centres[s:e], contexts[s:e]
        if lockstep > 1:
            visit(c, p, True)
        elif not any_again[v]:
            visit(c, p, False)
        else:
            twice = again[s:e]
            if not twice.all():
                visit(c[~twice], p[~twice], False)
            if softmax:
                visit(c[twice], p[twice], True)
            else:
                for a, b in zip(c[twice].tolist(), p[twice].tolist()):
                    visit_repeated(a, b)
    return act.loss(), np.bincount(copy[centres], minlength=copies) * (1 if softmax else target.shape[1])
