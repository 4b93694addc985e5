"""Sweep steps and ranked precision: equal to plain versions with and without hot groups, and few shuffles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgate.functions.scores import EVEN_THRESHOLDS, QUANTILES
from evalgate.operators import metrics as M


def plain_sweep(prob, label):
    p = np.sort(np.array(prob, dtype=float))
    grid = {*EVEN_THRESHOLDS, 0.5}
    for q in QUANTILES:
        at = (len(p) - 1) * q
        k = math.floor(at)
        grid.add(float(p[k]) if k + 1 >= len(p) else float(p[k] + (p[k + 1] - p[k]) * (at - k)))
    prob, label = np.array(prob), np.array(label)
    return {(t, int(np.sum((prob >= t) & (label == 1))) / max(1, int(np.sum(prob >= t))), int(np.sum(prob >= t)) / len(p)) for t in grid}


def sample():
    rng = np.random.default_rng(4)
    near = [0.3, np.nextafter(0.3, 1), np.nextafter(np.nextafter(0.3, 1), 1), 0.35, 0.5]
    sets = {"one": [0.62], "near": near * 3, "ties": rng.integers(0, 6, 60) / 5, "many": rng.random(400), "even": [EVEN_THRESHOLDS[3], EVEN_THRESHOLDS[4], 0.5, 1.2]}
    return [(g, float(p), int(rng.integers(0, 2)), i) for g, ps in sets.items() for i, p in enumerate(ps)]


@pytest.mark.parametrize("cell_rows", [250_000, 20])
def test_sweep_and_precision_equal_plain_versions(spark, monkeypatch, cell_rows):
    """Neighbouring doubles, ties, single scores and scores beyond the grid; groups over 20 rows go through cells."""
    monkeypatch.setattr(M, "CELL_ROWS", cell_rows)
    rows = sample()
    df = spark.createDataFrame(rows, "g string, prob double, label int, id long").repartition(3)
    got = M.threshold_sweep(df, ["g"]).collect()
    ap = {r.g: r.average_precision for r in M.average_precision(df, ["g"], ["id"]).collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        found = [(r.threshold, r.precision, r.pred_positive_rate) for r in got if r.g == g]
        assert len(found) == len(set(found)) and set(found) == plain_sweep([r[1] for r in mine], [r[2] for r in mine])
        ranked = [r[2] for r in sorted(mine, key=lambda r: (-r[1], r[3]))]
        want = sum(sum(ranked[: k + 1]) / (k + 1) for k, y in enumerate(ranked) if y) / max(1, sum(ranked))
        assert ap[g] == pytest.approx(want)


def test_selection_of_steps_equals_selection_of_rows_with_two_shuffles(spark):
    df = spark.createDataFrame(sample(), "g string, prob double, label int, id long")
    cfg = M.EvalConfig(max_ratio=2.0, target_rate="auto_val")
    steps, rows = M.sweep_steps(df, ["g"]), M.threshold_sweep(df, ["g"])
    one, other = M.select_threshold(steps, ["g"], cfg), M.select_threshold(rows, ["g"], cfg)
    assert sorted(one.collect()) == sorted(other.collect())
    key = ["g", "cap", "eligible_threshold_count", "best"]
    assert sorted(M.best_under_caps(steps, ["g"], [1.0, 2.0]).select(key).collect(), key=str) == sorted(M.best_under_caps(rows, ["g"], [1.0, 2.0]).select(key).collect(), key=str)

    def shuffles(query):
        return query._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")

    assert shuffles(one) == 2 and shuffles(M.average_precision(df, ["g"], ["id"])) == 1
    assert M.fixed_status(df, ["g"], cfg).select(F.count("fixed_threshold_f1")).first()[0] == 5
