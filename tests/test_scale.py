"""Operators that must hold for hot keys, lost tasks and repeated batches, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgate.functions.ordering import placed, salted_join
from evalgate.functions.scores import QUANTILES
from evalgate.operators import components as Q
from evalgate.operators import folds as G
from evalgate.operators import grid as C
from evalgate.operators import ledger as L
from evalgate.operators import metrics as M
from evalgate.operators import mining as J
from evalgate.operators import sampling as D
from evalgate.operators import training as T
from evalgate.sources import files as S
from evalgate.sources import versions
from evalgate.streaming.states import DiceState


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_places_and_salted_lookups(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 11).alias("v"), "id")
    got = [(r.k, -1 if r.v is None else r.v) for r in placed(rows, ["k", "v"]).orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 500
    facts = spark.createDataFrame([(0, "zero"), (None, "none")], "k long, name string")
    many = rows.withColumn("k", F.when(F.col("k") < 2, F.col("k")))
    found = salted_join(many, facts, ["k"], ["id"]).groupBy("k").agg(F.count("*").alias("n"), F.max("name").alias("name")).collect()
    assert {(r.k, r.n, r.name) for r in found} == {(0, 167, "zero"), (1, 167, None), (None, 166, "none")}


def test_one_component_of_most_nodes(spark):
    """A long chain, a star on its last node and pairs: 90 % of all nodes are one component."""
    chain = [(i, i + 1) for i in range(600)]
    star = [(600, 1000 + i) for i in range(300)]
    pairs = [(5000 + 2 * i, 5001 + 2 * i) for i in range(50)]
    edges = spark.createDataFrame([("m", a, b) for a, b in chain + star + pairs], "map string, a long, b long")
    roots = {r.node: r.root for r in Q.close_labels(edges, ["map"]).collect()}
    assert all(roots[n] == 0 for e in chain + star for n in e)
    assert all(roots[a] == a and roots[b] == a for a, b in pairs)


def plain_hard_mining(rows, n, positive, hard, low, high, keys):
    """rows: (id, ink, texture, hashes)."""
    if len(rows) <= n:
        return {r[0]: "all" for r in rows}
    pos = sorted((r for r in rows if r[1] > low), key=lambda r: (-np.log(keys[r[0]]["positive"]) / r[1], r[0]))
    neg = [r for r in rows if r[1] <= min(low, high)]
    tp = min(len(pos), round(n * positive))
    th = min(len(neg), round((n - tp) * hard))
    out = {r[0]: "positive" for r in pos[:tp]}
    pool = sorted(neg, key=lambda r: (-r[2], r[0]))[: 3 * th]
    out |= {r[0]: "hard_negative" for r in sorted(pool, key=lambda r: keys[r[0]]["hard"])[:th]}
    left = sorted((r for r in neg if r[0] not in out), key=lambda r: keys[r[0]]["random"])
    out |= {r[0]: "random_negative" for r in left[: n - tp - th]}
    rest = sorted((r for r in rows if r[0] not in out), key=lambda r: keys[r[0]]["fill"])
    return out | {r[0]: "fill" for r in rest[: n - len(out)]}


@pytest.mark.parametrize("size", [8, 40, 300])
def test_staged_sample_equals_plain_version_without_products(spark, size):
    import hashlib

    rng = np.random.default_rng(size)
    rows = [(i, float(rng.choice([0.0, 0.0, 0.05, 0.3, 0.9])), float(rng.integers(0, 20)) / 7) for i in range(size)]

    def hashes(i):
        md5 = {k: hashlib.md5(f"5:{k}|{i}".encode()).hexdigest() for k in ("positive", "hard", "random", "fill")}
        return md5 | {"positive": (int(md5["positive"][:8], 16) + 0.5) / 2**32}

    keys = {r[0]: hashes(r[0]) for r in rows}
    df = spark.createDataFrame(rows, "id long, ink_fraction double, texture double").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = D.hard_mining_sample(df.withColumn("scope", F.lit("all")), 30, 5, ["id"], ["scope"], 0.4, 0.5, 0.01, 0.1)
        assert "CartesianProduct" not in plan_of(out) and "Join" not in plan_of(out)
        got = {r.id: r.stage for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == plain_hard_mining(rows, 30, 0.4, 0.5, 0.01, 0.1, keys)


def test_weight_floors_drop_no_top_run(spark):
    rng = np.random.default_rng(4)
    cols = "run_id long, ts string, val_f1 double, average_precision double, val_f05 double, pred_positive_rate double, val_positive_rate double, precision_ double, recall_ double, fixed_threshold_status string, scope string"
    rows = [(i, str(i % 5), *[float(x) for x in np.round(rng.random(3), 1)], float(rng.random()) / 5, 0.1, 0.5, 0.5, "ok", "a" if i < 300 else "b" if i < 304 else None) for i in range(400)]
    ap, f05, cal = [0.1, 0.9], [0.0, 0.7], [0.0, 2.0]
    got = {(r.scope, r.ap_weight, r.f05_weight, r.cal_weight): r.mean_top_val_f1 for r in L.backtest_weights(spark.createDataFrame(rows, cols), ["scope"], ap, f05, cal, 6).collect()}
    for scope in ("a", "b", None):
        mine = [r for r in rows if r[10] == scope]
        for a in ap:
            for f in f05:
                for c in cal:
                    score = lambda r: round(r[2] + a * r[3] + f * r[4] - c * min(abs(r[5] / 0.1 - 1), 0.5), 12)  # noqa: B023, E731
                    top = sorted(mine, key=lambda r: (-score(r), r[1], r[0]))[:6]
                    assert got[(scope, a, f, c)] == pytest.approx(np.mean([r[2] for r in top]))


def plain_features(image, depth):
    """(pixels, features) of an array (channels, h, w)."""
    out = [np.ones(image[0].size)]
    for x in image:
        up, down, left, right = np.roll(x, 1, 0), np.roll(x, -1, 0), np.roll(x, 1, 1), np.roll(x, -1, 1)
        mean4 = (up + down + left + right) / 4.0
        gy, gx = np.gradient(x)
        out += [v.ravel() for v in ([x, mean4, x - mean4] + ([gx, gy, gx * gx + gy * gy, up + down + left + right - 4 * x] if depth >= 3 else []))]
    if len(image) > 1:
        out += [v.ravel() for v in (image.mean(0), image[len(image) // 2] - image.mean(0), image.std(0), image[-1] - image[0])]
    return np.stack(out, axis=1)


@pytest.mark.parametrize(("channels", "h", "w", "depth"), [(1, 5, 4, 3), (3, 4, 6, 3), (4, 3, 3, 2)])
def test_stencils_equal_numpy_without_a_shuffle(spark, channels, h, w, depth):
    images = np.random.default_rng(channels).random((5, channels, h, w))
    df = spark.createDataFrame([(i, m.ravel().tolist(), h, w) for i, m in enumerate(images)], "id int, image array<double>, h int, w int")
    out = C.patch_features(df, ["id"], channels, depth)
    assert "Exchange" not in plan_of(out)
    names = C.feature_names(channels, depth)
    got = np.array([[r[n] for n in names] for r in out.orderBy("id", "y", "x").collect()])
    assert np.allclose(got, np.concatenate([plain_features(m, depth) for m in images]))
    texture = [np.mean(np.square(np.gradient(m[channels // 2])[0]) + np.square(np.gradient(m[channels // 2])[1])) for m in images]
    assert np.allclose([r.texture for r in C.patch_texture(df, ["id"], channels).orderBy("id").collect()], texture)


def plain_descent(x, y, cfg):
    prior = np.clip((y > 0.5).mean(), 1e-4, 1 - 1e-4)
    w = np.zeros(x.shape[1])
    w[cfg.features.index(cfg.bias)] = np.log(prior / (1 - prior))
    pos = max(y.sum(), 1)
    weight = min(np.sqrt(max(len(y) - y.sum(), 1) / pos), 10) if cfg.pos_weight == "auto" else cfg.pos_weight
    share = np.where(y > 0.5, weight, 1.0)
    for _ in range(cfg.epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - cfg.learning_rate * (x.T @ ((p - y) * share) / len(y) + cfg.l2 * w)
    return w


@pytest.mark.parametrize(("folds", "pos_weight"), [(512, 2.0), (2, "auto")])
def test_leave_out_models_equal_numpy(spark, folds, pos_weight):
    rng = np.random.default_rng(7)
    images, labels = rng.random((12, 3, 4, 4)), (rng.random((12, 16)) > 0.6).astype(float)
    segments = [None, "a", "b", "b", "c", "c", "c", "c", "c", "d", "e", None]
    names = C.feature_names(3, 2)
    x = np.stack([plain_features(m, 2) for m in images])
    rows = [(s, float(v), *f.tolist()) for s, fs, ls in zip(segments, x, labels, strict=True) for f, v in zip(fs, ls, strict=True)]
    data = spark.createDataFrame(rows, "segment string, label double, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    cfg = T.LogregConfig(features=names, epochs=3, l2=0.01, pos_weight=pos_weight)
    got = {r.heldout_segment: [r[f"w_{n}"] for n in names] for r in T.train_leave_out(data, "segment", cfg, folds).collect()}
    assert set(got) == set(segments)
    for held, weights in got.items():
        keep = [i for i, s in enumerate(segments) if s != held]
        assert np.allclose(weights, plain_descent(x[keep].reshape(-1, len(names)), labels[keep].ravel(), cfg))
    alone = data.filter("segment = 'c'")
    assert T.train_leave_out(alone, "segment", cfg).count() == 0 and T.train_leave_out(data.limit(0), "segment", cfg).count() == 0


def test_folds_as_complements(spark):
    p = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "segment string")
    assert {tuple(r) for r in G.fold_sizes(p).collect()} == {("a", 3, 3, 2), ("b", 2, 4, 2), ("c", 1, 5, 2)}
    assert G.fold_sizes(p.filter("segment = 'a'")).count() == 0
    rng = np.random.default_rng(2)
    sets = [(i, "reject" if i % 7 == 3 else "eligible", [f"s{k}" for k in range(6) if i < 9 and k < 4 or rng.random() < 0.3]) for i in range(40)]
    inventory = spark.createDataFrame(sets, "set_id int, status string, provenance array<string>")
    held = spark.createDataFrame([(f"s{k}",) for k in range(7)], "heldout_segment string")
    got = {r.heldout_segment: (r.eligible_sets, r.own_sets, r.rejected_sets, r.first_set) for r in J.fold_sets(inventory, held, "set_id").collect()}
    for k in range(7):
        good = [i for i, s, p in sets if s == "eligible" and f"s{k}" not in p]
        own = sum(s == "eligible" and f"s{k}" in p for _, s, p in sets)
        assert got[f"s{k}"] == (len(good), own, sum(s != "eligible" for _, s, _ in sets), min(good))


def test_rank_error_of_the_approximate_grid(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.random(3000) ** 8, np.full(1000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "prob double").repartition(6)
    for accuracy in (100, 2000):
        grid = sorted(r.threshold for r in M.approximate_grid(df, [], 0.5, accuracy).collect())
        slack = len(values) / accuracy + 1
        for q in QUANTILES:
            assert any((values < t).sum() <= q * len(values) + slack and (values <= t).sum() >= q * len(values) - slack for t in grid)


def test_streaming_state_is_idempotent_and_readable(spark, tmp_path):
    rows = [(f"g{i % 3}", (i * 37 % 100) / 100, i % 2) for i in range(300)]
    batches = [spark.createDataFrame(rows[k : k + 50], "g string, prob double, label int") for k in range(0, 300, 50)]
    state = DiceState(str(tmp_path / "dice"), 0.5, ["g"], compact=3)
    with pytest.raises(FileNotFoundError):
        state.read(spark)

    def plain(upto):
        out = {}
        for g, p, y in rows[:upto]:
            c = out.setdefault(g, [0, 0, 0])
            c[0] += p >= 0.5 and y == 1
            c[1] += p >= 0.5 and y == 0
            c[2] += p < 0.5 and y == 1
        return {g: tuple(int(v) for v in c) for g, c in out.items()}

    read = lambda: {r.g: (r.tp, r.fp, r.fn) for r in state.read(spark).collect()}
    for number, batch in enumerate(batches):
        held = None if number == 0 else state.read(spark)
        state.add(batch, number)
        if held is not None:
            # a reader that began before the batch still sees its own state
            assert {r.g: (r.tp, r.fp, r.fn) for r in held.collect()} == plain(50 * number)
        assert read() == plain(50 * (number + 1))
        state.add(batches[0], number)
        state.add(batches[0], max(0, number - 1))
        assert read() == plain(50 * (number + 1))


def test_a_failed_overwrite_leaves_the_old_set(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    probs = spark.createDataFrame([(0, 0, 0.5)], "y int, x int, prob double")
    rows = spark.createDataFrame([(0.5, 0.1, 0.2, 0.3, 0.4, 0.5)], S.THRESHOLD_SCHEMA)
    metrics = lambda v: spark.createDataFrame([(v,)], "val_f1 double")
    S.write_outputs(spark, probs, metrics(0.1), rows, path)
    seen = lambda: S.read_outputs(spark, path)["metrics"].first().val_f1
    bad = rows.withColumn("f1", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        S.write_outputs(spark, probs, metrics(0.2), bad, path, overwrite=True)
    assert seen() == 0.1
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            S.write_outputs(spark, probs, metrics(0.3), rows, path, overwrite=True)
    assert seen() == 0.1
    S.write_outputs(spark, probs, metrics(0.4), rows, path, overwrite=True)
    assert seen() == 0.4 and S.read_outputs(spark, path)["metrics_by_threshold"].count() == 1


def test_cells_are_placed_by_mass(spark):
    """Scores that crowd near zero and beyond 1: no cell holds over twice the mean, and borders keep the order."""
    from evalgate.functions.scores import cell_borders, cell_of

    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.random(20_000) ** 40, 3 + rng.random(5_000) * 1e-9, -rng.random(5_000)]))
    df = spark.createDataFrame([(float(v), float(v) ** 2) for v in values], "prob double, other double").repartition(5)
    borders, others = cell_borders(df, "prob", "other", cells=64, cell_rows=100)
    cells = [r.c for r in df.select("prob", cell_of(F.col("prob"), borders).alias("c")).orderBy("prob").collect()]
    assert cells == sorted(cells) and max(np.bincount(cells)) < 2 * len(values) / 64 and 32 < len(others) < 64
    assert len(cell_borders(df, "prob")[0]) < 8 and cell_borders(df.limit(0), "prob") == [[]]


def test_average_precision_of_crowded_scores(spark):
    """Long runs of one label, mixed ties and single scores equal the plain ranking."""
    rng = np.random.default_rng(6)
    prob = np.concatenate([np.full(700, 0.9), np.full(900, 0.5), rng.random(300), np.full(400, 0.1)])
    label = np.concatenate([np.ones(700), rng.integers(0, 2, 900), rng.integers(0, 2, 300), np.zeros(400)])
    group = np.where(np.arange(len(prob)) % 3 == 0, "a", "b")
    rows = [(str(g), float(p), int(y), i) for i, (g, p, y) in enumerate(zip(group, prob, label, strict=True))]
    got = {r.g: r.average_precision for r in M.average_precision(spark.createDataFrame(rows, "g string, prob double, label int, id long").repartition(7), ["g"], ["id"]).collect()}
    for g in ("a", "b"):
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[3]))
        hits, total = 0, 0.0
        for k, r in enumerate(ranked, 1):
            hits += r[2]
            total += hits / k if r[2] else 0
        assert got[g] == pytest.approx(total / hits)


def test_patches_over_blocks_equal_slices_of_the_map(spark):
    """Two channels, a map that no block divides, overlapping origins at the edges."""
    rng = np.random.default_rng(8)
    image = rng.random((2, 23, 31))
    rows = [("m", c, y, x, float(image[c, y, x])) for c in range(2) for y in range(23) for x in range(31)]
    pixels = spark.createDataFrame(rows, "map string, c int, y int, x int, v double").repartition(6)
    got = {(r.y0, r.x0): np.array(r.image) for r in C.extract_patches(pixels, ["map"], 10, 7).collect()}
    ys, xs = sorted({*range(0, 14, 7), 13}), sorted({*range(0, 22, 7), 21})
    assert set(got) == {(y, x) for y in ys for x in xs}
    assert all(np.array_equal(v, image[:, y : y + 10, x : x + 10].ravel()) for (y, x), v in got.items())


def test_comparison_of_warnings_and_items(spark):
    from evalgate.operators import compare as H

    zero = dict.fromkeys(H.SUMMARY_WARNINGS, 0)
    cols = "label int, " + ", ".join(f"{w} long" for w in H.SUMMARY_WARNINGS)
    base = spark.createDataFrame([(1, *(zero | {"warning_count": 3}).values()), (2, *zero.values())], cols)
    cand = spark.createDataFrame([(1, *(zero | {"warning_count": 1, "positive_rate_alarm_count": 2}).values()), (3, *(zero | {"warning_count": 4}).values())], cols)
    got = {(r.label, r.warning): (r.candidate, r.baseline, r.delta) for r in H.compare_warnings(cand, base, ["label"]).collect()}
    assert got[(1, "warning_count")] == (1, 3, -2) and got[(1, "positive_rate_alarm_count")] == (2, 0, 2) and got[(3, "warning_count")] == (4, 0, 4)
    assert len(got) == 3 * len(H.SUMMARY_WARNINGS)
    a = spark.createDataFrame([("g", "a", 0.5), ("g", "b", None), ("g", "c", 0.1)], "k string, item string, v double")
    b = spark.createDataFrame([("g", "b", 0.2), ("g", "c", 0.3), ("g", "d", 0.4)], "k string, item string, v double")
    sides = {r.item: (r.side, r.delta) for r in H.paired_items(a, b, ["k"], "item", "v").collect()}
    assert {k: v[0] for k, v in sides.items()} == {"a": "candidate_only", "b": "common", "c": "common", "d": "baseline_only"}
    assert sides["b"][1] is None and sides["c"][1] == pytest.approx(-0.2)
    worst = H.worst_fold_change(a, b, ["k"], "item", "v").first()
    assert (worst.candidate_worst_fold_id, worst.baseline_worst_fold_id, worst.same_fold) == ("c", "b", False)
