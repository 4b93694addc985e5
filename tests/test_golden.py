"""Golden values of the evaluation, LOO, cap, comparison and quality operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgate.operators import caps as C
from evalgate.operators import compare as H
from evalgate.operators import components as K
from evalgate.operators import folds as G
from evalgate.operators import grid
from evalgate.operators import metrics as M
from evalgate.operators import mining as J
from evalgate.operators import quality as Q
from evalgate.operators import sampling as D

SWEEP = "threshold double, precision double, recall double, f05 double, f1 double, pred_positive_rate double"


def scored(spark, probs, labels, group="m"):
    rows = [(group, y, x, float(p), int(t)) for y, (pr, lr) in enumerate(zip(probs, labels)) for x, (p, t) in enumerate(zip(pr, lr))]
    return spark.createDataFrame(rows, "m string, y int, x int, prob double, label int")


def test_record_of_separable_map(spark):
    s = scored(spark, [[.75, .25], [.75, .25]], [[1, 0], [1, 0]])
    r = M.evaluate(s, ["m"], ["y", "x"]).first()
    assert r.brier_score == pytest.approx(.0625) and r.ap_prevalence_lift == pytest.approx(2.0)
    assert (r.fixed_threshold_status, r.fixed_threshold_failure_reason) == ("ok", "ok")


def test_fixed_threshold_without_positives(spark):
    s = scored(spark, [[.4, .3], [.35, .1]], [[1, 0], [1, 0]])
    r = M.fixed_status(s, ["m"], M.EvalConfig()).first()
    assert (r.fixed_threshold_status, r.fixed_threshold_failure_reason) == ("weak", "no_fixed_positive_predictions")


def test_rate_constrained_selection(spark):
    probs = np.full((10, 10), .7)
    label = np.zeros((10, 10), int)
    label[:2, :5] = 1
    probs[label == 1] = .9
    probs[8:] = .1
    s = scored(spark, probs, label)
    cfg = M.EvalConfig(max_ratio=2.0, target_rate="auto_val")
    rows = M.threshold_sweep(s, ["m"])
    sel = M.select_threshold(rows, ["m"], cfg)
    r = M.selected_columns(sel, ["m"]).first()
    assert r.threshold_selection == "positive_rate_constrained" and r.pred_positive_rate / r.val_positive_rate <= 2
    for c in M.threshold_risk(rows, sel, ["m"], cfg).collect():
        assert c.best_pred_positive_rate / r.val_positive_rate <= c.cap


def test_dice_batches_and_mask(spark):
    df = spark.createDataFrame([("a", 1., 1), ("a", 0., 1)], "m string, prob double, label int").unionByName(
        spark.createDataFrame([("a", 1., 0), ("a", 0., 0), ("a", 1., 1), ("a", 0., 1)], "m string, prob double, label int").limit(0))
    first = spark.createDataFrame([("a", 1., 1), ("a", 0., 0)], df.schema).limit(2)
    from evalgate.operators.predictors import DiceAccumulator

    acc = DiceAccumulator(["m"])
    acc.update(first)
    acc.update(spark.createDataFrame([("a", 1., 0), ("a", 0., 1)], df.schema))
    assert acc.compute().first().dice == pytest.approx(.5)
    masked = spark.createDataFrame([("a", 1., 1, True), ("a", 1., 0, False), ("a", 0., 1, True), ("a", 0., 0, False)], "m string, prob double, label int, k boolean")
    r = M.dice(masked, .5, ["m"], "k").first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 1)


def test_sweep_and_ap_match_numpy(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    s = spark.createDataFrame([("g", i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "m string, id int, prob double, label int")
    order = np.lexsort((np.arange(400), -p))
    hits = np.cumsum(y[order])
    want = (hits / np.arange(1, 401) * y[order]).sum() / y.sum()
    assert M.average_precision(s, ["m"], ["id"]).first().average_precision == pytest.approx(want, abs=1e-12)
    grid_want = np.unique(np.concatenate([M.EVEN_THRESHOLDS, [0.5], np.quantile(p, M.QUANTILES)]).round(10))
    got = M.threshold_sweep(s, ["m"]).collect()
    assert np.allclose(sorted({round(r.threshold, 10) for r in got}), grid_want, atol=1e-9)
    for r in got:
        pred = p >= r.threshold
        assert r.pred_positive_rate == pytest.approx(pred.mean())
        assert r.recall == pytest.approx((pred & (y == 1)).sum() / y.sum())
    assert M.score_stats(s, ["m"]).first().prob_p95 == pytest.approx(np.quantile(p, .95))


def test_group_without_positives(spark):
    s = spark.createDataFrame([("g", i, i / 10, 0) for i in range(5)], "m string, id int, prob double, label int")
    r = M.evaluate(s, ["m"], ["id"]).first()
    assert r.average_precision == 0.0 and r.val_f1 == 0.0 and r.val_positive_rate == 0.0


def test_stitched_constant_is_constant(spark):
    px = spark.createDataFrame([("s", y, x, .25) for y in range(24) for x in range(24)], "k string, y int, x int, prob double")
    tiles = grid.covering_tiles(px, ["k"], grid.map_sizes(px, ["k"]), 8, 4)
    out = grid.stitch(tiles, ["k"], 8)
    r = out.agg(F.min("prob"), F.max("prob"), F.count("*")).first()
    assert r[0] == pytest.approx(.25) and r[1] == pytest.approx(.25) and r[2] == 576
    assert max(grid.blend_line(8)) ** 2 > 0 and grid.blend_line(1) == [1.0]


def test_mined_patch_is_false_positive_only(spark):
    rows = []
    for y in range(8):
        for x in range(8):
            prob = .9 if y >= 4 and x >= 4 else .95 if y < 4 and x < 4 else 0.
            rows.append(("s", 0, y, x, float(8 * y + x), prob, int(y < 4 and x < 4)))
    df = spark.createDataFrame(rows, "k string, c int, y int, x int, v double, prob double, label int")
    mined = J.mine_tiles(df, ["k"], 4, 4, .5, 10)
    r = mined.collect()
    assert [(t.y0, t.x0, t.label_rate) for t in r] == [(4, 4, 0.0)]
    img = J.mined_patches(df.select("k", "c", "y", "x", "v"), mined, ["k"], 4).first().image
    assert img[0] == 36.0 and len(img) == 16


def test_label_overlap(spark):
    def raster(v):
        return spark.createDataFrame([("s", y, x, v[y][x]) for y in (0, 1) for x in (0, 1)], "k string, y int, x int, label int")

    r = grid.label_iou(raster([[1, 1], [0, 0]]), raster([[1, 0], [1, 0]]), ["k"], ["y", "x"]).first()
    assert r.iou == pytest.approx(1 / 3) and (r.new_not_ours, r.ours_not_new) == (1, 1)
    assert grid.label_iou(raster([[0, 0], [0, 0]]), raster([[0, 0], [0, 0]]), ["k"], ["y", "x"]).first().iou == 1.0


def test_curriculum(spark):
    c = spark.createDataFrame([("a", None, "random", "hard_mining", 2, 3), ("b", "warmup_then_hard", None, None, None, 4), ("c", "hard_mining", None, None, None, 1)],
                              "k string, curriculum string, initial string, final string, switch_epoch int, epochs int")
    got = {(r.k, r.epoch): r.strategy for r in D.curriculum(c, ["k"]).collect()}
    assert got[("a", 0)] == "random" and got[("a", 2)] == "hard_mining"
    assert got[("b", 1)] == "random" and got[("b", 2)] == "hard_mining" and got[("c", 0)] == "hard_mining"


def verdict(spark, arr):
    return Q.map_verdict(Q.map_stats(scored(spark, arr, np.zeros(arr.shape, int)), .5, ["m"])).first()


def test_map_verdicts(spark):
    good = np.full((16, 16), .05)
    good[4:12, 3:13] = .82
    good[5:11, 4:12] = .92
    r = verdict(spark, good)
    assert r.verdict == "pass" and r.score >= .70 and r.supported_positive_rate >= .95 and r.transition_density < .15
    comp = K.components(scored(spark, good, np.zeros(good.shape, int)), ["m"]).first()
    assert comp.component_count == 1 and comp.largest_component_fraction == 1.0
    assert "blank_or_no_positive_mask" in verdict(spark, np.full((8, 8), .02)).flags
    assert "flooding" in verdict(spark, np.full((8, 8), .90)).flags
    speckle = np.full((16, 16), .05)
    speckle[::3, ::3] = .9
    r = verdict(spark, speckle)
    assert r.verdict == "fail" and "speckle_or_isolated_positives" in r.flags
    checker = np.indices((16, 16)).sum(0) % 2 * .8 + .1
    r = verdict(spark, checker)
    assert r.verdict == "fail" and "fragmented_threshold_mask" in r.flags


def brute_components(mask):
    seen, sizes = set(), []
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        stack, size = [start], 0
        seen.add(start)
        while stack:
            y, x = stack.pop()
            size += 1
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in seen:
                        seen.add(q)
                        stack.append(q)
        sizes.append(size)
    return sorted(sizes)


def test_components_across_tiles(spark):
    rng = np.random.default_rng(5)
    noise = (rng.random((40, 37)) > .62).astype(float)
    snake = np.zeros((21, 30))
    snake[::4] = 1
    for i, y in enumerate(range(2, 21, 4)):
        snake[y - 1:y + 2, -1 if i % 2 == 0 else 0] = 1
    both = scored(spark, noise, noise.astype(int), "noise").unionByName(scored(spark, snake, snake.astype(int), "snake"))
    got = {}
    for r in K.component_sizes(both, ["m"], .5, tile=8).collect():
        got.setdefault(r.m, []).append(r["size"])
    assert sorted(got["noise"]) == brute_components(noise > 0)
    assert sorted(got["snake"]) == brute_components(snake > 0) == [int(snake.sum())]


LOO = "label string, heldout_segment string, seed long, returncode int, error string, val_f1 double, average_precision double, precision double, recall double, best_threshold double, val_positive_rate double, pred_positive_rate double, ap_prevalence_lift double, fixed_threshold_status string, fixed_threshold_failure_reason string"


def loo_row(fold, seed, f1, ap, p=.5, r=.5, thr=.4, val=.1, pred=.1, lift=2.0, status="ok"):
    return ("L", fold, seed, 0, None, f1, ap, p, r, thr, val, pred, lift, status, None)


def test_loo_summary_two_folds(spark):
    rows = spark.createDataFrame([loo_row("a", 1, .2, .3), loo_row("b", 1, .6, .5), loo_row("a", 2, .4, .7), loo_row("b", 2, .8, .9)], LOO)
    s = G.loo_summarize(rows, ["label"], 2).first()
    assert s.worst_fold_id == "a" and s.worst_fold_val_f1 == pytest.approx(.3) and s.median_over_seeds_median_val_f1 == pytest.approx(.5)
    assert s.mean_average_precision == pytest.approx(.6) and s.median_average_precision == pytest.approx(.6) and s.promotion_ready
    assert {r.heldout_segment: round(r.val_f1, 6) for r in G.fold_means(rows, ["label"]).collect()} == {"a": .3, "b": .7}
    assert {r.seed: round(r.median_val_f1, 6) for r in G.seed_stats(rows, ["label"]).collect()} == {1: .4, 2: .6}


# recorded run: fold, seed, F1, AP, precision, recall, predicted rate, true rate, threshold
RECORDED = [
    ("20230520175435", 11001, 0.4063986254295533, 0.28528574109077454, 0.27159444786375037, 0.8068966458339019, 0.4152641296386719, 0.13977432250976562, 0.3470669984817505),
    ("20230520175435", 11018, 0.3947202930574122, 0.2855733036994934, 0.26378956361181155, 0.7837122349280861, 0.4152660369873047, 0.13977432250976562, 0.319696307182312),
    ("20230522181603", 11001, 0.052329109405675533, 0.03998032957315445, 0.03576656582414365, 0.09746044408988166, 0.039089202880859375, 0.014345169067382812, 0.444623202085495),
    ("20230522181603", 11018, 0.04281807714450202, 0.03748881444334984, 0.029352276651373885, 0.07911182023667065, 0.03866386413574219, 0.014345169067382812, 0.43649545311927795),
    ("20230522215721", 11001, 0.13908951406649617, 0.09517183899879456, 0.09403790289113294, 0.26700706991358997, 0.10143060982227325, 0.03572310524425287, 0.4551949203014374),
    ("20230522215721", 11018, 0.0345041254932655, 0.09125658869743347, 0.10167211224293676, 0.02077769049489395, 0.007300365716218948, 0.03572310524425287, 0.4739718437194824),
    ("20230530172803", 11001, 0.0217405801933978, 0.010391305200755596, 0.015677599307492546, 0.035450195737277077, 0.019830703735351562, 0.008769989013671875, 0.45783424377441406),
    ("20230530172803", 11018, 0.03488817192541149, 0.015677504241466522, 0.02330338227774125, 0.06937799043062201, 0.026109695434570312, 0.008769989013671875, 0.4507145285606384),
    ("20230530212931", 11001, 0.11245851416900689, 0.07663499563932419, 0.07552075892219333, 0.22012159573582077, 0.14240315556526184, 0.04885660807291667, 0.47037461400032043),
    ("20230530212931", 11018, 0.09876899750911519, 0.08001670986413956, 0.08716707021791767, 0.11393353876905139, 0.06385905295610428, 0.04885660807291667, 0.4743026793003082),
    ("20230531121653", 11001, 0.27097055616139587, 0.17221857607364655, 0.1810076051166992, 0.5387217067036684, 0.4654812216758728, 0.1563991970486111, 0.4730009436607361),
    ("20230531121653", 11018, 0.25714005299833154, 0.17017249763011932, 0.17176823671673538, 0.5112305957852745, 0.4654880166053772, 0.1563991970486111, 0.4586982727050781),
    ("20230601193301", 11001, 0.07003316032295272, 0.052272167056798935, 0.046940303916121084, 0.1378503015253636, 0.07895088195800781, 0.026884078979492188, 0.4553191363811493),
    ("20230601193301", 11018, 0.06734429865089632, 0.049788184463977814, 0.0455329251530676, 0.12926569705569352, 0.07632255554199219, 0.026884078979492188, 0.44833576679229736),
    ("20230611014200", 11001, 0.19369026964610037, 0.14386969804763794, 0.12951437927769932, 0.3839341169975386, 0.24579238891601562, 0.08291435241699219, 0.4296720027923584),
    ("20230611014200", 11018, 0.1549611233607984, 0.10518795251846313, 0.10361685122100737, 0.30717029743967245, 0.24579811096191406, 0.08291435241699219, 0.45040684938430786),
]


def test_recorded_loo_summary(spark):
    rows = spark.createDataFrame([loo_row(f, s, f1, ap, p, r, thr, val, pred, None) for f, s, f1, ap, p, r, pred, val, thr in RECORDED], LOO)
    s = G.loo_summarize(rows, ["label"], 3).first()
    assert s.mean_average_precision == pytest.approx(0.10693663795245811)
    assert s.mean_val_f1 == pytest.approx(0.14699096684589447)
    assert s.median_average_precision == pytest.approx(0.08563664928078651)
    assert s.median_over_seeds_median_val_f1 == pytest.approx(0.10441533109887864)
    assert s.median_val_f1 == pytest.approx(0.09620528780947094)
    assert (s.worst_fold_id, s.worst_fold_val_f1) == ("20230530172803", pytest.approx(0.028314376059404647))
    notes = G.warning_lists(G.loo_warnings(rows, ["label"], 3), ["label"]).first().promotion_warnings
    assert "insufficient_seed_repeats:2/3" in notes and sum(n.startswith("insufficient_fold_seed_repeats:") for n in notes) == 8
    weak = sorted(n.split(":", 1)[1] for n in notes if n.startswith("weak_ap"))
    assert weak == ["20230530172803:seed=11001", "20230531121653:seed=11001", "20230531121653:seed=11018"]
    hard = G.hard_fold(rows, ["label"]).first()
    assert hard.average_precision == pytest.approx((0.010391305200755596 + 0.015677504241466522) / 2) and not hard.passed


def test_loo_edge_rows(spark):
    bad = ("L", "a", 3, 1, "boom", None, None, None, None, None, None, None, None, None, None)
    rows = spark.createDataFrame([loo_row("a", 1, .2, None, p=0.0, thr=.995, val=.0), loo_row("a", 2, None, .1), bad], LOO)
    notes = G.warning_lists(G.loo_warnings(rows, ["label"], 1, ["a", "b"], [1, 2], 5, 3), ["label"]).first().promotion_warnings
    assert notes[:2] == ["partial_task_limit_applied:3/5", "missing_expected_fold:b"]
    for want in ("missing_expected_seed_repeat:b:1", "failed_fold:a:seed=3:boom", "missing_or_invalid_val_f1:a:seed=2", "missing_average_precision:a:seed=1",
                 "zero_precision_or_recall:a:seed=1", "zero_positive_validation:a:seed=1", "threshold_edge_case:a:seed=1", "missing_expected_seed_repeat:a:2"):
        assert want in notes
    assert not G.loo_summarize(rows, ["label"], 1).first().promotion_ready


def test_paired_sign_test(spark):
    a = spark.createDataFrame([("p", "a", .31), ("p", "b", .22), ("p", "c", .15)], "k string, fold string, v double")
    b = spark.createDataFrame([("p", "a", .30), ("p", "b", .20), ("p", "c", .10)], "k string, fold string, v double")
    r = H.paired_compare(a, b, ["k"], "fold", "v").first()
    assert (r.wins, r.losses, r.common) == (3, 0, 3) and r.mean_delta == pytest.approx(.08 / 3) and r.sign_test_two_sided_p == pytest.approx(.25)
    p = spark.range(1).select(H.sign_test(F.lit(700), F.lit(500)).alias("p")).first().p
    want = min(1, 2 * sum(math.comb(1200, i) for i in range(501)) / 2 ** 1200)
    assert p == pytest.approx(want, rel=1e-9)


def test_cap_recommendations(spark):
    rows = spark.createDataFrame([(.40, .25, .35, .26, .29, .25), (.50, .30, .25, .29, .27, .20), (.30, .20, .60, .23, .30, .30)], SWEEP)
    rows = rows.withColumns({"k": F.lit("a"), "val_positive_rate": F.lit(.1)})
    r = C.recommended_cap(C.compare_caps(rows, ["k"], None, [2., 2.5, 3.], .90, 0.0), ["k"]).first()
    assert r.recommended_cap == 2.0 and r.recommended_f1 == pytest.approx(.27)
    rows = spark.createDataFrame([(.50, .2, .2, .225, .225, .20), (.40, .25, .35, .2917, .2917, .25), (.30, .25, .4, .30, .30, .30)], SWEEP)
    rows = rows.withColumns({"k": F.lit("a"), "val_positive_rate": F.lit(.1)})
    r = C.recommended_cap(C.compare_caps(rows, ["k"], None, [2., 2.5, 3.], .90), ["k"]).first()
    assert r.recommended_cap == 2.5 and r.f1_delta > 0


def test_recompute_caps_keeps_failures(spark):
    loo = spark.createDataFrame([loo_row("a", 1, .3, .2), loo_row("b", 1, .3, .2), ("L", "c", 1, 1, "boom", *[None] * 10)], LOO).withColumn("val_f05", F.lit(.2))
    sweep = spark.createDataFrame([("L", "a", 1, .5, .4, .4, .4, .27, .2, .1)], "label string, heldout_segment string, seed long, " + SWEEP + ", val_positive_rate double")
    out = {(r.heldout_segment, r.cap): r for r in C.recompute_caps(loo, sweep, ["label", "heldout_segment", "seed"], [1.5, 2.0]).collect()}
    assert out[("a", 2.0)].val_f1 == pytest.approx(.27) and out[("a", 2.0)].f1_retained_vs_original == pytest.approx(.9)
    assert out[("a", 1.5)].error == "no_threshold_row_under_prratio1p5" and out[("a", 1.5)].returncode == 1
    assert out[("b", 2.0)].error == "missing_artifact_metrics" and out[("c", 2.0)].error == "boom"


def _expanded(spark, leaves, model, tested=None):
    from evalgate.operators import ledger as L

    rows = [("s", 1, model, p, v) for p, v in {"model.name": model, **leaves}.items()]
    docs = L.base_documents(spark.createDataFrame(rows, "scope string, base_id int, model_name string, path string, value string"), ["scope"])
    seen = L.search_signatures(docs, ["scope"])
    if tested:
        other = [("s", 2, model, p, v) for p, v in {"model.name": model, **tested}.items()]
        more = L.base_documents(spark.createDataFrame(other, "scope string, base_id int, model_name string, path string, value string"), ["scope"])
        seen = seen.union(L.search_signatures(more, ["scope"]))
    out = {}
    for r in L.expand_candidates(docs, L.planner_rules(spark), ["scope"], seen).collect():
        out.setdefault(r["path"], []).append((r["ordinal"], r["proposed"]))
    return {p: [v for _, v in sorted(found)] for p, found in out.items()}


def test_planner_values_by_hand(spark):
    """Expected values written out from the rules, not from the rule table."""
    numpy = _expanded(spark, {"model.depth": "3", "training.weight_decay": "0.0"}, "tiny_numpy_ink_logreg")
    assert numpy["model.depth"] == ["2", "1"] and [float(v) for v in numpy["training.weight_decay"]] == [0.0003]
    assert numpy["training.epochs"] == ["3", "8"] and numpy["training.seed"] == ["1354"] and numpy["model.name"] == ["tiny_numpy_mlp"]
    assert _expanded(spark, {"model.depth": "1"}, "tiny_numpy_ink_logreg")["model.depth"] == ["2", "3"]
    torch = _expanded(spark, {"model.base_channels": "9", "training.sampling_curriculum": "other", "training.focal_loss_weight": "0.1",
                              "training.sampling_strategy": "hard_mining", "evaluation.max_pred_positive_rate_ratio": "2.5"}, "tiny_torch_unet")
    assert torch["model.base_channels"] == ["4", "16"] and "training.sampling_curriculum" not in torch and "training.sampling_strategy" not in torch
    assert torch["training.focal_gamma"] == ["2.0", "3.0"] and torch["training.hard_negative_fraction"] == ["0.85"] and torch["training.focal_loss_weight"] == ["0.2"]
    assert torch["evaluation.max_pred_positive_rate_ratio"] == ["3.0", "2.75"] and torch["training.augment_flips"] == ["true"] and len(torch["balanced_calibration"]) == 2
    mlp = _expanded(spark, {"training.sample_positive_fraction": "0.25", "model.hidden_units": "9"}, "tiny_numpy_mlp")
    assert mlp["training.sample_positive_fraction"] == ["0.5"] and mlp["model.hidden_units"] == ["8", "18"] and "model.name" not in mlp


def test_planner_novelty_is_the_signature_of_the_changed_config(spark):
    """A tested configuration blocks the change that leads to it, not the same change of another base."""
    same = _expanded(spark, {"training.learning_rate": "0.1"}, "tiny_numpy_ink_logreg", {"training.learning_rate": "0.1", "training.epochs": "3"})
    assert same["training.epochs"] == ["8"]
    other = _expanded(spark, {"training.learning_rate": "0.1"}, "tiny_numpy_ink_logreg", {"training.learning_rate": "0.2", "training.epochs": "3"})
    assert other["training.epochs"] == ["3", "8"]


def test_compound_moves_by_hand(spark):
    from evalgate.operators import ledger as L

    hard = "hard_fold_low_ap_near_prevalence"
    leaves = {"training.patch_sampling": "hard_mining", "training.hard_negative_fraction": "0.75", "training.positive_patch_fraction": "0.30", "dataset.z_offsets": "[-4,0,4]", "evaluation.max_pred_positive_rate_ratio": "2.5"}
    rows = [(1, "tiny_torch_unet", hard, p, v) for p, v in leaves.items()] + [(2, "tiny_numpy_mlp", hard, p, v) for p, v in leaves.items()]
    rows += [(3, "tiny_numpy_mlp", "calibrate_probability_scale", "evaluation.threshold", "0.33"), (3, "tiny_numpy_mlp", "calibrate_probability_scale", "training.seed", "100")]
    bases = spark.createDataFrame(rows, "run_id int, model_name string, action string, path string, value string")
    got = [(r.run_id, r.path, r.proposed) for r in L.action_moves(bases, L.action_rules(spark), ["run_id"], 9, L.compound_rules(spark)).orderBy("run_id", "move_rank").collect()]
    fraction = "training.hard_negative_fraction=0.75;training.patch_sampling=hard_mining;training.positive_patch_fraction="
    assert got[0] == (1, "hard_fold_sampling_calibration", fraction + "0.25")
    assert [g[1] for g in got[1:5]] == ["hard_fold_sampling_calibration"] * 2 + ["evaluation.max_pred_positive_rate_ratio", "dataset.z_offsets"]
    assert got[1][2].startswith("evaluation.max_pred_positive_rate_ratio=2.75;") and got[2][2].startswith("evaluation.max_pred_positive_rate_ratio=2.5;")
    assert got[4] == (1, "dataset.z_offsets", "[-6,-3,0,3,6]")
    assert [(g[0], g[1], float(g[2])) for g in got[5:]] == [(3, "evaluation.threshold", 0.35), (3, "training.seed", 117.0), (3, "training.seed", 131.0), (3, "training.seed", 153.0)]
