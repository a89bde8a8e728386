"""Ensemble blending (M8/M9) as a column expression over member predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast.functions.labels import clip


def normalized_weights(models: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Uniform when absent; weights not summing to 1 (isclose) are divided by the
    sum of *all* supplied weights; a member without a weight gets 0."""
    if not models:
        raise ValueError("a blend needs at least one member")
    if weights is None:
        weights = {m: 1.0 / len(models) for m in models}
    total = sum(weights.values())
    if abs(total - 1.0) > 1e-08 + 1e-05 * 1.0:  # numpy isclose defaults
        weights = {m: w / total for m, w in weights.items()}
    return {m: float(weights.get(m, 0.0)) for m in models}


def blend(predictions: dict[str, Column], weights: dict[str, float] | None = None,
          clip_range: tuple[float, float] | None = None) -> Column:
    w = normalized_weights(list(predictions), weights)
    expr = None
    for m, c in predictions.items():
        term = c * F.lit(w[m])
        expr = term if expr is None else expr + term
    if clip_range is not None:
        expr = clip(expr, clip_range[0], clip_range[1])
    return expr
