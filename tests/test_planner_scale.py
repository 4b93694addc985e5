"""Links, moves and candidates of the ledger at size: against plain versions, and without self-joins, products or repeated shuffles."""

import re

from pyspark.sql import functions as F

from evalgate.operators import ledger as L


def _plain_links(runs, summaries):
    def bare(p):
        return re.sub(r"^(\./)+", "", p)

    def fits(a, b):
        if not a or not b:
            return True
        x, y = bare(a), bare(b)
        return bool(x) and bool(y) and (x.endswith(y) or y.endswith(x))

    out = {}
    for run, sig, fm in runs:
        links = [(ts, sid, True, ready) for sid, ts, ids, _, _, ready in summaries if run in ids]
        links += [(ts, sid, False, ready) for sid, ts, _, s, f, ready in summaries if s is not None and s == sig and fits(f, fm)]
        if links:
            best = max(links, key=lambda r: r[:3])
            out[run] = (best[1], "run_id" if best[2] else "config", best[3])
    return out


def test_linked_loo_equals_plain_version_without_pairs(spark):
    maps = ["maps/1.json", "./maps/1.json", "1.json", "x/maps/1.json", "maps/2.json", "./", "././2.json", "", None, "json"]
    runs = [(i, None if i % 17 == 0 else i % 4, maps[i % 10]) for i in range(200)]
    summaries = [(i, i * 7 % 23, [i * 3 % 400, i], None if i % 13 == 0 else i % 5, maps[i * 3 % 10], i % 2 == 0) for i in range(60)]
    r = spark.createDataFrame(runs, "run_id long, loo_signature long, fold_map string")
    s = spark.createDataFrame(summaries, "summary_id long, ts long, run_ids array<long>, loo_signature long, fold_map string, promotion_ready boolean")
    got = L.link_loo(r, s)
    assert {x.run_id: (x.summary_id, x.link, x.promotion_ready) for x in got.collect()} == _plain_links(runs, summaries)
    assert "EndsWith" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_moves_never_join_the_bases_with_themselves(spark):
    leaves = F.array(*[F.struct(F.lit(p).alias("path"), F.lit("1").alias("value")) for p in ("training.pos_weight", "training.patch_sampling")])
    bases = spark.range(6).select(F.col("id").alias("run_id"), F.lit("tiny_torch_unet").alias("model_name"),
                                  F.lit("hard_fold_low_ap_near_prevalence").alias("action"), F.inline(leaves))
    moves = L.action_moves(bases, L.action_rules(spark), ["run_id"], 9, L.compound_rules(spark))
    assert moves._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    assert moves.filter("path = 'hard_fold_sampling_calibration'").count() == 24


def test_candidates_of_a_base_are_shuffled_with_its_document_only(spark):
    leaves = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in (("training.epochs", "5"), ("model.depth", "3"))])
    flat = spark.range(40).select(F.lit("s").alias("scope"), F.col("id").alias("base_id"), F.lit("tiny_numpy_mlp").alias("model_name"), F.inline(leaves))
    docs = L.base_documents(flat, ["scope"])
    out = L.expand_candidates(docs, L.planner_rules(spark), ["scope"], L.search_signatures(docs, ["scope"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and ("proposed" in line or "candidate_signature" in line)]
    rows = out.collect()
    assert {r.base_id for r in rows} == set(range(40)) and len({(r.base_id, r.path, r.proposed) for r in rows}) == len(rows)


def _bases(spark, n):
    """Bases of three configurations, some of them in two groups."""
    rows = [(f"g{i % 2}", i, ("tiny_numpy_mlp", "tiny_torch_unet")[i % 3 == 0], p, v)
            for i in range(n) for p, v in (("training.epochs", "5"), ("model.depth", str(i % 3)), ("training.pos_weight", "auto"))]
    return L.base_documents(spark.createDataFrame(rows, "scope string, base_id long, model_name string, path string, value string"), ["scope"])


def test_candidates_are_worked_out_once_per_configuration(spark, monkeypatch):
    docs, worked, plain = _bases(spark, 60), [], L._changes
    monkeypatch.setattr(L, "_changes", lambda d, *a: (worked.append(d.count()), plain(d, *a))[1])
    tested = L.search_signatures(docs, ["scope"])
    shared = L.expand_candidates(docs, L.planner_rules(spark), ["scope"], tested)
    # as if no two bases shared a configuration
    alone = L.configurations(docs, ["scope"]).withColumn("bases", F.lit(0))
    single = L.expand_candidates(docs, L.planner_rules(spark), ["scope"], tested, alone)
    assert worked == [3, 60]
    cols = sorted(shared.columns)
    rows = [sorted(str(tuple(r)) for r in df.select(*cols).collect()) for df in (shared, single)]
    assert rows[0] == rows[1] and len(rows[0]) > 60


def test_selection_needs_the_leading_bases_alone(spark):
    tier = F.expr("CASE WHEN base_id % 2 = 0 THEN 'cheap' ELSE 'normal' END")
    docs = _bases(spark, 60).withColumn("cost_tier", tier)
    few = L.leading_bases(docs, ["scope"], ["cost_tier"])
    assert few.count() == 6
    none = [spark.createDataFrame([], f"scope string, {c}") for c in ("failure string, runs long", "family string, mean_quality double", "changed_path string")]

    def selected(bases):
        found = L.expand_candidates(bases, L.planner_rules(spark), ["scope"], L.search_signatures(docs, ["scope"]), L.configurations(docs, ["scope"]))
        scored = L.score_candidates(found.withColumn("cost_tier", tier), ["scope"], *none).withColumn("ordinal", F.col("base_id") * 100 + F.col("ordinal"))
        return [sorted(tuple(r) for r in L.select_proposals(scored, ["scope"], 4, f).select("scope", "proposal_rank", "base_id", "path", "proposed").collect())
                for f in (None, ["optimizer", "data_sampling", "loss_calibration"])]

    assert selected(few) == selected(docs) and len(selected(few)[0]) == 8


def test_scores_are_looked_up_by_place(spark):
    tier = F.expr("CASE base_id % 3 WHEN 0 THEN 'cheap' WHEN 1 THEN 'normal' ELSE 'expensive' END")
    docs = _bases(spark, 12)
    found = L.expand_candidates(docs, L.planner_rules(spark), ["scope"], L.search_signatures(docs, ["scope"])).withColumn("cost_tier", tier)
    context = [spark.createDataFrame(r, f"scope string, {c}") for r, c in (
        ([("g0", "calibration_high", 2), ("g1", "hard_fold_blocker", 1)], "failure string, runs long"),
        ([("g0", "optimizer", 0.25)], "family string, mean_quality double"), ([("g1", "training.epochs")], "changed_path string"))]
    plain = L.score_candidates(found, ["scope"], *context)
    placed = L.score_by_place(found, ["scope"], docs, L.planner_rules(spark), ["cheap", "normal", "expensive"], *context)
    cols = sorted(plain.columns)
    assert sorted(placed.columns) == cols
    rows = [sorted(str(tuple(r)) for r in df.select(*cols).collect()) for df in (plain, placed)]
    assert rows[0] == rows[1] and len({r.score for r in placed.collect()}) > 3
