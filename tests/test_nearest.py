"""The k best vectors of each query, scored a few columns at a time."""

import tracemalloc

import numpy as np
import pytest

from polysense.operators import similarity


def _all_at_once(u, m, mine, k):
    scores = np.round(u @ m.T, similarity.SCORE_DIGITS)
    found = []
    for row, own in enumerate(mine):
        order = [c for c in np.lexsort((np.arange(len(m)), -scores[row])) if c != own][:k]
        found += [(row, c, scores[row, c]) for c in order]
    return found


@pytest.mark.parametrize("columns", [1, 3, 64, 4096])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_best_columns_are_those_of_all_scores(monkeypatch, columns, k):
    monkeypatch.setattr(similarity, "SLICE_COLUMNS", columns)
    rng = np.random.default_rng(3)
    m = rng.choice(rng.normal(size=(40, 3)), 200)  # many copies, so many ties
    u, mine = m[::7] + 0.0, np.arange(0, 200, 7)
    mine[::2] = -1
    found = list(zip(*similarity.top_columns(u, m, mine, k)))
    assert found == [(r, c, pytest.approx(s)) for r, c, s in _all_at_once(u, m, mine, k)]


def test_scores_held_do_not_grow_with_the_vectors():
    rng = np.random.default_rng(4)
    u, held = rng.normal(size=(256, 8)), []
    for n in (20_000, 80_000):
        m = rng.normal(size=(n, 8))
        tracemalloc.start()
        similarity.top_columns(u, m, np.full(256, -1), 5)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert held[1] < 1.2 * held[0] and held[1] < 40 << 20
