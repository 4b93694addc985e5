"""Expressions over scored pixels: confusion metrics, calibration bins, score cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The evaluation grid is 48 even thresholds plus 160 score quantiles.
EVEN_THRESHOLDS = [float(t) for t in np.linspace(0.02, 0.95, 48)]
QUANTILE_STEPS = 160
QUANTILES = [float(q) for q in np.linspace(0.001, 0.999, QUANTILE_STEPS)]

SWEEP_METRICS = ["precision", "recall", "f05", "f1", "pred_positive_rate"]


def is_positive(label: Column) -> Column:
    return label > 0.5


def f_scores(precision: Column, recall: Column) -> tuple[Column, Column]:
    """F0.5 and F1."""
    return (1.25 * precision * recall / F.greatest(0.25 * precision + recall, F.lit(1e-9)),
            2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-9)))


def confusion_columns(tp: Column, fp: Column, fn: Column, total: Column) -> dict[str, Column]:
    """Precision, recall, F0.5, F1 and predicted-positive rate from counts."""
    tp, fp, fn, total = (c.cast("double") for c in (tp, fp, fn, total))
    precision = tp / F.greatest(tp + fp, F.lit(1.0))
    recall = tp / F.greatest(tp + fn, F.lit(1.0))
    f05, f1 = f_scores(precision, recall)
    return {
        "precision": precision,
        "recall": recall,
        "f05": f05,
        "f1": f1,
        "pred_positive_rate": (tp + fp) / total,
    }


def ece_edges(bins: int) -> list[float]:
    """Bin edges as float32 values, which differ from i/bins in double."""
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1, dtype=np.float32)]


def ece_bin(prob: Column, bins: int = 15) -> Column:
    """0-based bin; the last one is closed on the right, scores outside [0, 1] give NULL."""
    edges = ece_edges(bins)
    index = sum((F.when(prob >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((prob >= edges[0]) & (prob <= edges[-1]), index)


#: Most cells of a column, and the rows that a cell is meant to hold.
CELLS = 256
CELL_ROWS = 250_000


def cell_borders(rows: DataFrame, *columns: str, cells: int = CELLS, cell_rows: int = CELL_ROWS) -> list[list[float]]:
    """For each column, distinct borders that cut the rows into cells of about equal mass; one pass, a mergeable summary each.

    Small tables have few cells: a cell is there to bound what one task sorts.
    """
    cuts = [k / cells for k in range(1, cells)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(c).cast("double"), cuts, cells * 16) for c in columns]).first()
    step = max(1, cells // max(4, min(cells, -(-found["n"] // cell_rows))))
    return [sorted({float(v) for v in (q or [])[step - 1 :: step] if v == v}) for q in found[1:]]


def cell_of(value: Column, borders: list[float]) -> Column:
    """Monotone cell number of a value: the borders at or below it, found by halving."""
    v = value.cast("double")

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(v >= borders[middle], between(middle + 1, hi)).otherwise(between(lo, middle))

    return between(0, len(borders))
