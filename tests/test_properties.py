"""Properties: partition independence, hot groups, leakage-free folds, samplers, the trainer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgate.functions.scores import cell_borders, cell_of
from evalgate.operators import folds as G
from evalgate.operators import grid as C
from evalgate.operators import ledger as L
from evalgate.operators import metrics as M
from evalgate.operators import sampling as D
from evalgate.operators import training as T


def brute_ap(p, y):
    order = np.lexsort((np.arange(len(p)), -p))
    hits = np.cumsum(y[order])
    return (hits / np.arange(1, len(p) + 1) * y[order]).sum() / max(y.sum(), 1)


@pytest.mark.parametrize("kind", ["ties", "near_zero", "spread"])
def test_hot_group_average_precision(spark, kind):
    rng = np.random.default_rng(9)
    n = 3000
    p = {"ties": np.where(rng.random(n) < .8, .5, rng.random(n).round(1)), "near_zero": rng.random(n) ** 12, "spread": rng.random(n)}[kind]
    y = (rng.random(n) < .3).astype(int)
    df = spark.createDataFrame([("hot", i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))] + [("cold", 0, .5, 1)], "g string, id int, prob double, label int")
    for parts in (1, 7):
        got = {r.g: r.average_precision for r in M.average_precision(df.repartition(parts), ["g"], ["id"]).collect()}
        assert got["hot"] == pytest.approx(brute_ap(p, y), abs=1e-12) and got["cold"] == 1.0


def test_score_cells_are_monotone(spark):
    v = sorted({0.0, 1.0, 1.5, 2.0 ** -10, 2.0 ** -20, 2.0 ** -30, *(2.0 ** -k * f for k in range(40) for f in (.999999, 1, 1.1, 1.6))})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, p double")
    for most in (16, 256):
        borders = cell_borders(df, "p", cells=most, cell_rows=1)[0]
        got = [r.c for r in df.withColumn("c", cell_of(F.col("p"), borders)).orderBy("i").collect()]
        assert got == sorted(got) and len(set(got)) > most // 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    a = {r.id for r in D.sample_n(df, 40, 3, ["id"], ["g"]).collect()}
    b = {r.id for r in D.sample_n(df.repartition(9), 40, 3, ["id"], ["g"]).collect()}
    assert a == b and len(a) == 120 and a != {r.id for r in D.sample_n(df, 40, 4, ["id"], ["g"]).collect()}


def test_stratified_batches_are_balanced(spark):
    df = spark.range(200).withColumn("g", F.when(F.col("id") < 20, 0).when(F.col("id") < 80, 1).otherwise(2))
    rows = D.stratified_batches(df, "g", 12, 1, ["id"], 3).groupBy("batch", "g").count().collect()
    assert len(rows) == (200 // 12) * 3 and {r["count"] for r in rows} == {4}
    assert D.batch_size_for(10, 4) == 8 and D.batch_size_for(3, 4) == 4
    with pytest.raises(ValueError):
        D.stratified_batches(df, "g", 10, 1, ["id"], 3)


def test_hard_mining_counts(spark):
    rows = [(i, (i % 10) / 100 if i < 300 else 0.0, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, ink_fraction double, texture double").withColumn("g", F.lit(1))
    out = D.hard_mining_sample(df, 100, 5, ["id"], ["g"], .45, .6)
    n = {r.stage: r["count"] for r in out.groupBy("stage").count().collect()}
    assert n == {"positive": 45, "hard_negative": 33, "random_negative": 22}
    assert out.select("id").distinct().count() == 100
    assert out.filter("stage = 'hard_negative'").agg(F.min("texture")).first()[0] >= 1000 - 3 * 33
    assert D.hard_mining_sample(df, 2000, 5, ["id"], ["g"]).count() == 1000


def test_sampled_origins_stay_inside(spark):
    px = spark.createDataFrame([("s", y, x, int(y < 8 and x < 8)) for y in range(30) for x in range(40)], "k string, y int, x int, label int")
    out = C.sample_origins(px, ["k"], 60, .5, 6, 3)
    rows = out.collect()
    assert len(rows) == 60 and all(0 <= r.y0 <= 24 and 0 <= r.x0 <= 34 for r in rows)
    for r in rows:
        overlap = max(0, 8 - r.y0) * max(0, 8 - r.x0) > 0
        assert overlap if r.source == "positive" else not overlap
    assert {r.source for r in rows} == {"positive", "background"}


def test_split_regions_match_brute_force(spark):
    rng = np.random.default_rng(2)
    lab = np.zeros((20, 60), int)
    lab[3:9, 5:11] = 1
    lab[10:16, 44:52] = rng.random((6, 8)) > .3
    px = spark.createDataFrame([("s", y, x, int(lab[y, x])) for y in range(20) for x in range(60)], "k string, y int, x int, label int")
    r = C.split_regions(px, ["k"], 4).first()
    assert not r.is_default and not r.overlap and min(r.train_hi - r.train_lo, r.val_hi - r.val_lo) >= 4
    blank = px.withColumn("label", F.lit(0))
    d = C.split_regions(blank, ["k"], 4).first()
    assert d.is_default and (d.train_lo, d.train_hi, d.val_lo, d.val_hi) == (0, 40, 44, 60)


def best_split(lab, patch, stride):
    """Regions (train_lo, train_hi, val_lo, val_hi) of the best candidate by trying every tile; None without one."""
    h, w = lab.shape
    half = max(patch, w // 50) // 2

    def top(lo, hi, step):
        return max((lab[y:y + patch, x:x + patch].sum() for y in range(0, h - patch + 1, step) for x in range(lo, hi - patch + 1, step)), default=0)

    found = []
    for sx in range(max(patch + half, int(w * .15)), min(w - patch - half, int(w * .85)) + 1, max(patch, w // 32)):
        left, right = (0, max(patch, sx - half)), (min(w - patch, sx + half), w)
        for side, (a, b) in enumerate([(left, right), (right, left)]):
            t, v = top(*a, patch), top(*b, stride)
            if min(t, v) > 0:
                found.append(((min(t, v), v, t, b[1] - b[0], -sx, -side), (*a, *b)))
    return max(found)[1] if found else None


def test_split_regions_sum_pixels_once_for_all_strips(spark):
    rng = np.random.default_rng(5)
    maps = [(rng.random((int(rng.integers(6, 22)), int(rng.integers(20, 70)))) < rate).astype(int) for rate in (.02, .1, .3, .6, .9)]
    rows = [(k, y, x, int(lab[y, x])) for k, lab in enumerate(maps) for y in range(lab.shape[0]) for x in range(lab.shape[1])]
    px = spark.createDataFrame(rows, "k int, y int, x int, label int")
    for patch, stride in ((4, 2), (4, 4), (5, 3)):
        want = {k: b for k, lab in enumerate(maps) if (b := best_split(lab, patch, stride))}
        # without a label a pixel needs no row, the last one of its map apart
        sparse = px.filter("label = 1").union(px.groupBy("k").agg(F.max("y").alias("y"), F.max("x").alias("x"), F.lit(0).alias("label")))
        for table in (px, sparse):
            out = C.split_regions(table, ["k"], patch, stride)
            assert {r.k: (r.train_lo, r.train_hi, r.val_lo, r.val_hi) for r in out.collect() if not r.is_default} == want
    plan = C.split_regions(px, ["k"], 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_folds_exclude_their_segment(spark):
    p = spark.createDataFrame([(s, i) for s in "abc" for i in range(3)], "segment string, i int")
    assert G.build_folds(p).filter("heldout_segment = train_segment").count() == 0 and G.build_folds(p).count() == 6
    assert G.fold_train_patches(p, "a").filter("segment = 'a'").count() == 0
    assert G.build_folds(p.filter("segment = 'a'")).count() == 0


def test_logreg_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.random(500)
    y = (rng.random(500) < x).astype(float)
    df = spark.createDataFrame([("g", float(a), 1.0, int(b)) for a, b in zip(x, y)], "g string, v double, bias double, label int")
    cfg = T.LogregConfig(features=["v", "bias"], epochs=5, l2=.01, pos_weight="auto")
    pw = min(np.sqrt((500 - y.sum()) / y.sum()), 10)
    w = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    X = np.stack([x, np.ones(500)], 1)
    sw = np.where(y > .5, pw, 1)
    losses = []
    for _ in range(5):
        p = 1 / (1 + np.exp(-X @ w))
        losses.append(-np.mean(sw * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))))
        w = w - .2 * (X.T @ ((p - y) * sw) / 500 + .01 * w)
    m = T.train_logreg(df, ["g"], cfg).first()
    assert m.w_v == pytest.approx(w[0]) and m.w_bias == pytest.approx(w[1]) and m.train_loss == pytest.approx(losses[-1]) and losses[-1] < losses[0]


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = L.top_rows(df, ["g"], [F.col("id").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_proposals_keep_first_creation(spark):
    base = spark.createDataFrame([("p1", "2026-01-01", "old")], "proposal_id string, created_at string, status string")
    new = spark.createDataFrame([("p1", "2026-02-01", "new"), ("p2", "2026-02-01", "new")], base.schema)
    got = {r.proposal_id: (r.created_at, r.status) for r in L.upsert_proposals(base, new).collect()}
    assert got == {"p1": ("2026-01-01", "new"), "p2": ("2026-02-01", "new")}
