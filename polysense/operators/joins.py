"""Lookups of skewed facts in tables that are keyed by frequency rank.

Word ids are ranks by count, so the frequent words are exactly the small ids. The
head of a lookup table (ids below a fixed bound) is broadcast, at most ``head``
ids whatever the corpus size; the rare rest, where no key is hot, is joined by
shuffle. No hot key is ever sent to one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HEAD_BYTES = 8 << 20


def head_size(row_bytes: int, rows_per_id: int = 1) -> int:
    """How many leading ids fit the broadcast budget."""
    return max(1, HEAD_BYTES // max(1, row_bytes * rows_per_id))


def rank_lookup(facts: DataFrame, table: DataFrame, on: list[str], rank: str, head: int) -> DataFrame:
    """Inner join on ``on`` (which contains ``rank``), head by broadcast, tail by shuffle."""
    first = table.filter(F.col(rank) < head)
    rest = table.filter(F.col(rank) >= head)
    if rest.isEmpty():
        return facts.join(F.broadcast(first), on)
    hot = facts.filter(F.col(rank) < head).join(F.broadcast(first), on)
    cold = facts.filter(F.col(rank) >= head).join(rest, on)
    return hot.unionByName(cold)
