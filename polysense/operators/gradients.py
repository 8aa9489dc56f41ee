"""Exact full-batch gradients of the skip-gram loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from polysense.functions import kernels
from polysense.operators.loss import Scored
from polysense.operators.training import gradient_parts


def batch_gradient_sigmoid(scored: Scored, dim: int, exact: bool = True) -> DataFrame:
    """Gradient of the sigmoid loss ``(tbl, word_id, sense, grad)``: weight ``sigma - 1`` on the true word, ``sigma`` on noise."""
    weight = kernels.exact_weight if exact else kernels.sigmoid_weight
    return _gradient(scored, dim, weight)


def batch_gradient_softmax(scored: Scored, dim: int) -> DataFrame:
    """Gradient of the sampled-softmax loss: ``p - 1`` on the true word, ``p`` on noise."""
    return _gradient(scored, dim, kernels.softmax_weight)


def _gradient(scored: Scored, dim: int, weight: Callable) -> DataFrame:
    return gradient_parts(scored.rows, scored.model, dim, scored.window, weight, scored.tokens, scored.block, scored.draw)
