"""Means, worst folds and paired counts do not depend on the order in which rows arrive; the LOO view takes one shuffle."""

import functools
import itertools
import operator

import pytest
from pyspark.sql import functions as F

from evalgate import views
from evalgate.functions.columns import steady_mean
from evalgate.operators import compare as H
from evalgate.operators import folds as G
from evalgate.operators import metrics as M

from .test_sweep_steps import sample

ROWS = ("label int, heldout_segment string, seed string, returncode int, val_f1 double, average_precision double, precision double, recall double, best_threshold double, "
        "val_positive_rate double, pred_positive_rate double, ap_prevalence_lift double, fixed_threshold_status string, error string")


def loo(spark, f1):
    """LOO rows of (label, fold, seed, F1); all rows lie in one partition, in the given order."""
    return spark.createDataFrame([(b, f, s, 0, v, v, 0.5, 0.5, 0.5, 0.1, 0.1, 2.0, "ok", None) for b, f, s, v in f1], ROWS).coalesce(1)


def test_equal_values_in_another_order_tie(spark):
    values = [0.1, 0.2, 0.3, 0.7]
    plain = functools.partial(functools.reduce, operator.add)
    assert len({plain(p) for p in itertools.permutations(values)}) > 1
    for p in itertools.islice(itertools.permutations(values), 0, None, 5):
        assert spark.createDataFrame([(v,) for v in (*p, None)], "v double").coalesce(1).agg(steady_mean(F.col("v"))).first()[0] == plain(values) / 4
    assert spark.createDataFrame([], "v double").agg(steady_mean(F.col("v"))).first()[0] is None
    low, high = min(itertools.permutations(values), key=plain), max(itertools.permutations(values), key=plain)
    # fold 'a' comes first, although plain sums in the order of rows put 'b' below it
    folds = loo(spark, [(1, f, s, v) for f, p in (("a", high), ("b", low)) for s, v in zip("wxyz", p, strict=True)])
    assert G.loo_summarize(folds, ["label"], hard_fold_id="-").first().worst_fold_id == "a"
    sides = [G.fold_means(loo(spark, [(1, "a", s, v) for s, v in zip("wxyz", p, strict=True)]), ["label"]) for p in (low, high)]
    got = H.paired_compare(*sides, ["label"], "heldout_segment", "val_f1").first()
    assert (got.wins, got.losses, got.ties) == (0, 0, 1)


@pytest.mark.parametrize("cell_rows", [250_000, 20])
def test_one_pass_equals_both_parts(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(M, "CELL_ROWS", cell_rows)
    df = spark.createDataFrame([*sample(), ("none", 0.4, 0, 1)], "g string, prob double, label int, id long").repartition(3)
    got = {r.g: r.asDict() for r in M.evaluated(df, 0.5, ["g"], ["id"]).collect()}
    for part in (M.confusion(df, 0.5, ["g"]).drop("threshold"), M.average_precision(df, ["g"], ["id"])):
        for r in part.collect():
            assert {k: got[r.g][k] for k in part.columns} == pytest.approx(r.asDict())
    lift = {r.g: r.asDict() for r in M.ranked_lift(df, ["g"], ["id"]).collect()}
    for r in M.ap_lift(M.average_precision(df, ["g"], ["id"]), df, ["g"]).collect():
        assert lift[r.g] == pytest.approx(r.asDict())


def test_hot_groups_are_found_through_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 20)
    monkeypatch.setattr(M, "HOT_BUCKETS", 7)
    df = spark.range(2000).selectExpr("CASE WHEN id < 300 THEN id % 10 WHEN id < 330 THEN NULL ELSE id END AS g")
    assert {r.g for r in M.hot_groups(df, ["g"]).collect()} == {*range(10), None}
    assert M.hot_groups(df.filter("g >= 330"), ["g"]) is None


def test_the_view_shuffles_its_rows_once(spark):
    plan = views.loo(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
