"""Rule-column queries on runs, configurations, metadata and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgate import views
from evalgate.functions.columns import same_tail, safe_double, safe_ratio
from evalgate.functions.tables import MUTATION_FAMILIES, PARAM_BOUNDS, PLANNER_SECTION, REQUIRED_METRICS
from evalgate.operators import rules as B
from evalgate.plans.registry import query, rounded
from evalgate.session import checkpointed

_CONFIG = """concat('{"model":{"name":"', model_name, '","depth":', run_id%5, '},"dataset":{"research_scope":"', research_scope, '","patch_size":', 32+32*(run_id%3),
 CASE WHEN run_id%7=0 THEN ',"train_npz":"a.npz"' ELSE '' END, CASE WHEN run_id%14=0 THEN ',"val_npz":"b.npz"' ELSE '' END,
 '},"training":{"epochs":', run_id%12, ',"learning_rate":', CASE run_id%3 WHEN 0 THEN '0.2' WHEN 1 THEN '0.20' ELSE '-0.1' END,
 ',"pos_weight":', CASE WHEN run_id%4=0 THEN '"auto"' WHEN run_id%4=1 THEN '"bad"' ELSE '3' END,
 ',"seeds":', CASE run_id%5 WHEN 0 THEN '[]' WHEN 1 THEN '[1,2]' ELSE 'null' END, ',"max_train_samples":', (run_id*13)%3000,
 ',"max_train_pixels":', ((run_id*17)%9)*100000, '},"evaluation":{"threshold":', CASE WHEN run_id%6=0 THEN '1.5' ELSE '0.5' END,
 ',"tta_flips":', CASE WHEN run_id%9=0 THEN 'true' ELSE 'false' END, ',"max_pred_positive_rate_ratio":', CASE run_id%4 WHEN 0 THEN 'null' ELSE '2.5' END,
 ',"min_pred_positive_rate_ratio":', CASE WHEN run_id%10=0 THEN '3.0' ELSE '0.1' END, '},"planner":{',
 CASE run_id%3 WHEN 0 THEN '"run_profile":"exploration",' WHEN 1 THEN '"intent":"promotion_validation",' ELSE '' END,
 CASE WHEN run_id%2=0 THEN concat('"heldout_segment":"', val_segment, '",') ELSE '' END, '"scope_policy":"', research_scope, '"}}')"""
CONFIG_CTE = f"cf AS (SELECT *, CAST({_CONFIG} AS JSON) AS doc FROM V_RUNS)"

_METRICS = """concat('{"val_loss":', val_f1, ',"val_f1":', CASE WHEN run_id%13=0 THEN 'true' ELSE CAST(val_f1 AS {s}) END, ',"val_f05":', val_f05,
 ',"best_threshold":', best_threshold, ',"precision":', CASE WHEN run_id%19=0 THEN '"x"' ELSE CAST(precision_ AS {s}) END, ',"recall":', recall_,
 ',"average_precision":', average_precision, ',"ap_prevalence_lift":', CASE WHEN run_id%23=0 THEN 'null' ELSE '1.5' END,
 ',"val_positive_rate":', val_positive_rate, ',"pred_positive_rate":', pred_positive_rate,
 CASE WHEN fixed_threshold_status IS NULL THEN '' ELSE concat(',"fixed_threshold_status":"', fixed_threshold_status, '"') END,
 CASE WHEN run_id%17=0 THEN ',"loo_promotion_ready":1' WHEN run_id%2=0 THEN ',"loo_promotion_ready":true' ELSE '' END, '}')"""

_META = """concat('{"path":"p', run_id, '","segment_id":"', train_segment, '"', CASE WHEN run_id%3=0 THEN ',"metadata":{"segment_id":"?","train_segments":["4","2"]}' ELSE '' END,
 CASE WHEN run_id%4=0 THEN concat(',"forbidden_heldout_segments":["', val_segment, '",null]') ELSE '' END,
 CASE WHEN run_id%5=0 THEN concat(',"parent_full_tile":{"segment_id":"z', val_segment, '"}') ELSE '' END, '}')"""


def configs(spark, sf):
    return views.runs(spark, sf).withColumn("doc", F.parse_json(F.expr(_CONFIG)))


def patches(spark, sf):
    """Embeddings as 8x8 patches: image values, labels above 0.1, one file per segment."""
    e = views.table(spark, sf, "embeddings").selectExpr("vec_id", "label AS segment", "embedding AS image")
    label = F.transform("image", lambda v: F.when(v > F.lit(0.1).cast("float"), 1.0).otherwise(0.0).cast("float"))
    return e.withColumns({"label": label, "channels": F.lit(1), "h": F.lit(8), "w": F.lit(8), "label_channels": F.lit(1)})


@query("b1_patch_validation", """
WITH f AS (SELECT label AS segment, CAST(v > 0.1::FLOAT AS INT) AS y FROM (SELECT label, unnest(embedding) AS v FROM embeddings))
SELECT segment, count(*)/64 AS samples, 8 AS patch_size, round(avg(y), 9) AS positive_rate, min(y)::DOUBLE AS label_min, max(y)::DOUBLE AS label_max, NULL::VARCHAR AS error FROM f GROUP BY 1""")
def b1(spark, sf):
    return rounded(B.validate_patches(patches(spark, sf), "segment", 8))


@query("b1_patch_validation_errors", """
SELECT label AS segment, count(*) AS samples, CASE label % 5 WHEN 0 THEN 'image_shape' WHEN 1 THEN 'label_shape' WHEN 2 THEN 'shape_mismatch' WHEN 3 THEN 'image_not_finite' ELSE 'missing_keys' END AS error
FROM embeddings GROUP BY 1""")
def b1_errors(spark, sf):
    p = patches(spark, sf)
    bad = p.withColumns({
        "channels": F.expr("CASE WHEN segment % 5 = 0 THEN 0 ELSE 1 END"), "label_channels": F.expr("CASE WHEN segment % 5 = 1 THEN 2 ELSE 1 END"),
        "image": F.expr("CASE segment % 5 WHEN 2 THEN slice(image, 1, 60) WHEN 3 THEN transform(image, v -> float('nan')) WHEN 4 THEN NULL ELSE image END")})
    return B.validate_patches(bad, "segment").select("segment", "samples", "error")


def _contract_sql() -> str:
    cases = []
    for name, want in REQUIRED_METRICS.items():
        ok = "('DOUBLE', 'UBIGINT', 'BIGINT')" if want == "number" else "('VARCHAR')"
        words = "int or float" if want == "number" else "str"
        cases.append(f"WHEN json_type(m, '$.{name}') IS NULL THEN 'metrics missing required key: {name}'")
        cases.append(f"WHEN json_type(m, '$.{name}') NOT IN {ok} THEN 'metrics key {name} must be {words}'")
    cases.append("WHEN json_type(m, '$.loo_promotion_ready') NOT IN ('BOOLEAN', 'NULL') THEN 'metrics key loo_promotion_ready must be bool'")
    return "CASE " + " ".join(cases) + " END"


@query("b2_metric_contract", f"""WITH d AS (SELECT run_id, CAST({_METRICS.replace('{s}', 'VARCHAR')} AS JSON) AS m FROM V_RUNS)
SELECT run_id, {_contract_sql()} AS contract_error, coalesce(m->>'$.loo_promotion_ready' IN ('true', '1'), false) AS loo_promotion_ready FROM d""")
def b2(spark, sf):
    r = views.runs(spark, sf).withColumn("metrics", F.parse_json(F.expr(_METRICS.replace('{s}', 'STRING'))))
    return B.validate_runs(r).select("run_id", "contract_error", "loo_promotion_ready")


@query("b3_safe_numbers", """WITH t AS (SELECT run_id, CASE run_id%5 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL WHEN 3 THEN '1e-12' ELSE CAST(val_f1 AS VARCHAR) END AS raw, pred_positive_rate FROM V_RUNS),
u AS (SELECT *, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS v FROM t)
SELECT run_id, round(v, 9) AS v, round(CASE WHEN abs(v) >= 1e-9 THEN pred_positive_rate/v END, 9) AS ratio FROM u""")
def b3(spark, sf):
    raw = F.expr("CASE run_id%5 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL WHEN 3 THEN '1e-12' ELSE CAST(val_f1 AS STRING) END")
    r = views.runs(spark, sf).withColumn("raw", raw)
    return rounded(r.select("run_id", safe_double(F.col("raw")).alias("v"), safe_ratio(F.col("pred_positive_rate"), F.col("raw")).alias("ratio")))


@query("b4_nested_get", f"""WITH {CONFIG_CTE} SELECT run_id, coalesce(doc->>'$.model.name', '?') AS name, coalesce(CAST(doc->>'$.training.epochs' AS INT), 5) AS epochs,
 coalesce(doc->>'$.planner.heldout_segment', 'none') AS heldout, coalesce(CAST(doc->>'$.evaluation.max_pred_positive_rate_ratio' AS DOUBLE), 3.5) AS cap FROM cf""")
def b4(spark, sf):
    d = F.col("doc")
    return configs(spark, sf).select("run_id", B.cfg(d, "model.name", default="?").alias("name"), B.cfg(d, "training.epochs", "int", 5).alias("epochs"),
                                     B.cfg(d, "planner.heldout_segment", default="none").alias("heldout"),
                                     B.cfg(d, "evaluation.max_pred_positive_rate_ratio", "double", 3.5).alias("cap"))


@query("b5_label_alignment", """
WITH s AS (SELECT segment, max(y)+1 AS sh, max(x)+1 AS sw, 40 AS dh, 12 AS dw FROM V_BIGMAP GROUP BY 1),
t AS (SELECT *, greatest(1, CAST(round_even(sh/dh, 0) AS INT)) AS sy, greatest(1, CAST(round_even(sw/dw, 0) AS INT)) AS sx FROM s)
SELECT b.segment, y//sy AS y, x//sx AS x, label FROM V_BIGMAP b JOIN t USING (segment) WHERE y % sy = 0 AND x % sx = 0 AND y//sy < dh AND x//sx < dw""")
def b5(spark, sf):
    m = views.bigmap(spark, sf).select("segment", "y", "x", "label")
    sizes = m.groupBy("segment").agg((F.max("y") + 1).alias("src_h"), (F.max("x") + 1).alias("src_w")).withColumns({"dst_h": F.lit(40), "dst_w": F.lit(12)})
    return B.align_labels(m, ["segment"], sizes)


@query("b6_normalize", """
WITH q AS (SELECT segment, quantile_cont(prob, 0.01) AS lo, quantile_cont(prob, 0.99) AS hi FROM V_BIGMAP GROUP BY 1)
SELECT segment, y, x, round(least(greatest((prob-lo)/greatest(hi-lo, 1e-6), 0.0), 1.0), 9) AS normalized FROM V_BIGMAP JOIN q USING (segment)""")
def b6(spark, sf):
    return rounded(B.normalize(views.bigmap(spark, sf), ["segment"], "prob").select("segment", "y", "x", "normalized"))


_PROFILE_SQL = """
p AS (SELECT run_id, coalesce(nullif(doc->>'$.planner.run_profile', ''), CASE WHEN doc->>'$.planner.intent' IN ('cron_exploration', 'promotion_action') THEN 'exploration'
  WHEN doc->>'$.planner.intent' IN ('promotion_validation', 'seed_repeat_leave_one_out') THEN 'promotion' END) AS run_profile, (doc->>'$.model.name') LIKE '%torch%' AS torch,
  CAST(doc->>'$.training.epochs' AS INT) AS ep, json_array_length(doc, '$.training.seeds') AS ns, CAST(doc->>'$.training.max_train_samples' AS INT) AS sm,
  coalesce(nullif(CAST(doc->>'$.training.max_train_pixels' AS INT), 0), 600000) AS px, coalesce(doc->>'$.planner.heldout_segment', '') AS h FROM cf)"""


@query("b7_profile_violations", f"""WITH {CONFIG_CTE}, {_PROFILE_SQL} SELECT run_id, run_profile, CASE WHEN run_profile = 'exploration' AND ep > 8 THEN 'epochs_above_cap'
 WHEN run_profile = 'exploration' AND ns > 1 THEN 'seed_ensemble_not_allowed' WHEN run_profile = 'exploration' AND torch AND (sm <= 0 OR sm > 1024) THEN 'train_samples_outside_cap'
 WHEN run_profile = 'exploration' AND NOT torch AND px > 600000 THEN 'train_pixels_above_cap' WHEN run_profile = 'promotion' AND h = '' THEN 'heldout_segment_missing' END AS violation FROM p""")
def b7(spark, sf):
    cols = B.profile_violations(F.col("doc"))
    return configs(spark, sf).select("run_id", *[c.alias(k) for k, c in cols.items()])


COST_SQL = """
ct AS (SELECT run_id, doc->>'$.model.name' AS nm, coalesce(nullif(CAST(doc->>'$.training.epochs' AS INT), 0), 5) AS ep, CAST(doc->>'$.training.max_train_samples' AS INT) AS sm,
  coalesce(nullif(CAST(doc->>'$.training.max_train_pixels' AS INT), 0), 600000) AS px, CASE WHEN json_type(doc, '$.training.seeds') = 'ARRAY' THEN json_array_length(doc, '$.training.seeds') ELSE 1 END AS ns,
  doc->>'$.evaluation.tta_flips' = 'true' AS tta FROM cf),
tier AS (SELECT run_id, CASE WHEN ns > 1 OR tta OR sm > 2048 OR px > 600000 OR ep > 8 THEN 'expensive' WHEN nm = 'tiny_numpy_ink_logreg' AND ep <= 5 THEN 'cheap'
  WHEN nm = 'tiny_numpy_mlp' THEN 'normal' WHEN nm LIKE '%torch%' THEN 'normal' ELSE 'expensive' END AS cost_tier FROM ct)"""


@query("b8_cost_tier", f"WITH {CONFIG_CTE}, {COST_SQL} SELECT run_id, cost_tier, CASE cost_tier WHEN 'cheap' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS cost_rank, cost_tier <> 'expensive' AS allowed FROM tier")
def b8(spark, sf):
    tier = B.cost_tier(F.col("doc"))
    c = configs(spark, sf).select("run_id", tier.alias("cost_tier"))
    rank = B.cost_rank(F.col("cost_tier"))
    return c.withColumns({"cost_rank": rank, "allowed": rank <= 1})


PATHS = ["training.learning_rate", "training.pos_weight", "evaluation.threshold", "model.depth", "dataset.z_offsets", "training.seed", "training.augment_flips",
         "training.patch_sampling", "balanced_calibration", "notes.text", "training.epochs", "training.hard_negative_fraction"]
_PATH_SQL = "(" + repr(PATHS) + ")[1 + run_id % 12]"


@query("b9_mutation_family", f"WITH t AS (SELECT run_id, {_PATH_SQL} AS path FROM V_RUNS) SELECT run_id, path, CASE "
       + " ".join(f"WHEN path IN ({', '.join(repr(p) for p in ps)}) THEN '{f}'" for f, ps in MUTATION_FAMILIES.items()) + " ELSE 'other' END AS family FROM t")
def b9(spark, sf):
    p = F.element_at(F.array(*[F.lit(x) for x in PATHS]), (F.col("run_id") % 12 + 1).cast("int"))
    return views.runs(spark, sf).select("run_id", p.alias("path")).withColumn("family", B.mutation_family(F.col("path")))


@query("b10_clamp", f"""WITH bounds AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {lo}::DOUBLE, {hi}::DOUBLE)" for p, (lo, hi) in PARAM_BOUNDS.items())}) b(path, lo, hi)),
t AS (SELECT signature, run_id AS ordinal, {_PATH_SQL} AS path, CASE WHEN run_id%2=0 THEN val_f1*40-5 ELSE (run_id*31)%60-20 END::DOUBLE AS value, run_id%2=1 AS is_int FROM V_RUNS),
c AS (SELECT t.* EXCLUDE (value), CASE WHEN is_int THEN trunc(coalesce(least(hi, greatest(lo, value)), value)) ELSE coalesce(least(hi, greatest(lo, value)), value) END AS value FROM t LEFT JOIN bounds USING (path))
SELECT signature, path, round(value, 9) AS value, ordinal, is_int FROM (SELECT *, row_number() OVER (PARTITION BY signature, path, value ORDER BY ordinal) AS rn FROM c) WHERE rn = 1""")
def b10(spark, sf):
    p = F.element_at(F.array(*[F.lit(x) for x in PATHS]), (F.col("run_id") % 12 + 1).cast("int"))
    value = F.expr("CAST(CASE WHEN run_id%2=0 THEN val_f1*40-5 ELSE (run_id*31)%60-20 END AS DOUBLE)")
    c = views.runs(spark, sf).select("signature", F.col("run_id").alias("ordinal"), p.alias("path"), value.alias("value"), (F.col("run_id") % 2 == 1).alias("is_int"))
    return rounded(B.clamp(c, ["signature"]))


PRIORITY_SQL = """CASE WHEN research_scope LIKE '%multi_segment_robust_expanded_tta_ensemble%' THEN 0 WHEN research_scope LIKE '%multi_segment_robust_expanded%' THEN 1
 WHEN research_scope LIKE '%expanded_multi_segment%' THEN 2 WHEN research_scope LIKE '%multi_segment%' THEN 3 WHEN research_scope LIKE '%focused_pair_residual_25d_cpu%' THEN 4 ELSE 5 END"""
MODE_SQL = "CASE validation_mode WHEN 'cross-scroll' THEN 0 WHEN 'leave-one-segment-out' THEN 1 WHEN 'cross-segment' THEN 2 ELSE 3 END"
ROBUST_SQL = """(model_name LIKE '%torch%' OR research_scope LIKE '%torch%') AND (research_scope LIKE '%multi_segment_robust%' OR research_scope LIKE '%expanded_multi_segment%'
 OR research_scope LIKE '%focused_pair_residual_25d_cpu%')"""


@query("b11_priorities", f"SELECT run_id, {PRIORITY_SQL} AS scope_rank, {MODE_SQL} AS validation_rank FROM V_RUNS")
def b11(spark, sf):
    scope = F.col("research_scope")
    return views.runs(spark, sf).select("run_id", B.scope_priority(scope, scope).alias("scope_rank"), B.validation_priority(F.col("validation_mode")).alias("validation_rank"))


@query("b12_robust_runs", f"SELECT run_id, {ROBUST_SQL} AS robust FROM V_RUNS")
def b12(spark, sf):
    scope = F.col("research_scope")
    return views.runs(spark, sf).select("run_id", B.is_robust(F.col("model_name"), scope, scope).alias("robust"))


_SETUP = """SELECT run_id, CASE WHEN run_id%7=0 THEN '1' WHEN run_id%7=1 THEN '2' END AS tscroll, CASE WHEN run_id%5=0 THEN '1' END AS vscroll, train_segment AS ts, CASE WHEN run_id%11>0 THEN val_segment END AS vs,
 CASE run_id%3 WHEN 0 THEN {empty} ELSE {pair} END AS members, CASE run_id%4 WHEN 0 THEN CAST(val_segment AS {s}) WHEN 1 THEN 'other' END AS held FROM {runs}"""


@query("b13_validation_setup", "WITH s AS (" + _SETUP.format(empty="[]::VARCHAR[]", pair="[train_segment::VARCHAR, ((train_segment+1)%8)::VARCHAR]", s="VARCHAR", runs="V_RUNS") + """),
k AS (SELECT run_id, coalesce(tscroll, '?') AS a, coalesce(vscroll, '?') AS b, coalesce(ts::VARCHAR, '?') AS c, coalesce(vs::VARCHAR, '?') AS d, members, coalesce(held, '?') AS h FROM s),
m AS (SELECT *, CASE WHEN a <> '?' AND b <> '?' AND a <> b THEN 'cross-scroll' WHEN len(members) > 0 AND d <> '?' AND NOT list_contains(members, d) THEN CASE WHEN h IN ('?', d) THEN 'leave-one-segment-out' ELSE 'cross-segment' END
  WHEN len(members) > 0 AND d <> '?' THEN 'spatial-same-segment' WHEN c <> '?' AND d <> '?' AND c <> d THEN 'cross-segment' ELSE 'spatial-same-segment' END AS mode FROM k)
SELECT run_id, mode, CASE WHEN mode <> 'spatial-same-segment' THEN NULL WHEN len(members) > 0 AND d <> '?' THEN 'validation_segment_in_train_segments' ELSE 'spatial_split_of_one_segment' END AS warning FROM m""")
def b13(spark, sf):
    s = views.runs(spark, sf)
    t = spark.sql(_SETUP.format(empty="CAST(array() AS ARRAY<STRING>)", pair="array(CAST(train_segment AS STRING), CAST((train_segment+1)%8 AS STRING))", s="STRING", runs="{r}"), r=s)
    cols = B.validation_setup(*[F.col(c) for c in ("tscroll", "vscroll", "ts", "vs", "members", "held")])
    return t.select("run_id", *[c.alias(k) for k, c in cols.items()])


@query("b14_promotion_checks", """WITH t AS (SELECT run_id, validation_mode AS mode, train_segment::VARCHAR AS ts, [((train_segment+2)%8)::VARCHAR] AS ms, CASE WHEN run_id%6>0 THEN val_segment::VARCHAR ELSE '' END AS vs, ((run_id//3)%8)::VARCHAR AS seg FROM V_RUNS),
u AS (SELECT *, ts = seg OR list_contains(ms, seg) AS tr FROM t)
SELECT run_id, concat_ws('|', CASE WHEN tr THEN 'inference segment matches training segment; treat as diagnostic-only' END,
 CASE WHEN mode NOT IN ('cross-segment', 'cross-scroll', 'leave-one-segment-out') THEN 'validation mode is ' || mode || '; promotion requires held-out segment evidence' END,
 CASE WHEN vs <> '' AND vs <> seg AND (mode <> 'leave-one-segment-out' OR tr) THEN 'inference segment does not match recorded validation segment' END) AS warnings FROM u""")
def b14(spark, sf):
    r = views.runs(spark, sf)
    warn = B.promotion_checks(F.col("validation_mode"), F.col("train_segment"), F.expr("array((train_segment+2)%8)"),
                              F.expr("CASE WHEN run_id%6>0 THEN CAST(val_segment AS STRING) ELSE '' END"), F.expr("(run_id div 3)%8"))
    return r.select("run_id", F.array_join(warn, "|").alias("warnings"))


@query("b15_oversized_patches", f"WITH {CONFIG_CTE} SELECT run_id FROM cf WHERE CAST(doc->>'$.dataset.patch_size' AS DOUBLE) > 64")
def b15(spark, sf):
    return B.oversized(B.config_kv(configs(spark, sf), "run_id", "doc"), "run_id")


def _classes(df, sig):
    df = checkpointed(df)
    first = df.groupBy(sig).agg(F.min("run_id").alias("class_run"))
    return df.join(first, sig).select("run_id", "class_run")


@query("b16_config_signature", """WITH d AS (SELECT run_id, concat_ws('|', model_name, research_scope, val_segment) AS k FROM V_RUNS), f AS (SELECT k, min(run_id) AS class_run FROM d GROUP BY 1)
SELECT run_id, class_run FROM d JOIN f USING (k)""")
def b16(spark, sf):
    doc = """concat('{"model":{"name":"', model_name, '","run_id":', run_id, '},"timestamp":"', ts, '","dataset":', CASE WHEN run_id%2=0 THEN concat('{"scope":"', research_scope, '","seg":', val_segment, '}')
      ELSE concat('{"seg":', val_segment, '.0,"scope":"', research_scope, '","output_dir":"x', run_id, '"}') END, '}')"""
    r = views.runs(spark, sf).withColumn("doc", F.parse_json(F.expr(doc)))
    return _classes(B.config_signature(B.config_kv(r, "run_id", "doc"), "run_id"), "config_signature")


@query("b17_search_signature", f"""WITH {CONFIG_CTE}, d AS (SELECT run_id, concat_ws('|', doc->>'$.model.name', least(CAST(doc->>'$.model.depth' AS INT), 3), doc->>'$.dataset.research_scope', coalesce(doc->>'$.dataset.train_npz', 'null'),
  coalesce(doc->>'$.dataset.val_npz', 'null'), doc->>'$.training.epochs', CAST(doc->>'$.training.learning_rate' AS DOUBLE), doc->>'$.training.pos_weight', coalesce(doc->>'$.training.seeds', 'null'),
  doc->>'$.training.max_train_samples', doc->>'$.training.max_train_pixels', doc->>'$.evaluation.threshold', doc->>'$.evaluation.tta_flips', coalesce(doc->>'$.evaluation.max_pred_positive_rate_ratio', 'null')) AS k FROM cf),
f AS (SELECT k, min(run_id) AS class_run FROM d GROUP BY 1) SELECT run_id, class_run FROM d JOIN f USING (k)""")
def b17(spark, sf):
    return _classes(configs(spark, sf).select("run_id", B.search_key(F.col("doc")).alias("search_signature")), "search_signature")


@query("i26_loo_signature", """WITH d AS (SELECT run_id, concat_ws('|', model_name, research_scope, val_segment, run_id%3) AS k FROM V_RUNS), f AS (SELECT k, min(run_id) AS class_run FROM d GROUP BY 1)
SELECT run_id, class_run FROM d JOIN f USING (k)""")
def i26_signature(spark, sf):
    """Runs of one configuration: folds, seeds and resolved inputs differ, a leaf four levels down counts."""
    planner = PLANNER_SECTION
    doc = f"""concat('{{"model":{{"name":"', model_name, '","seed":1}},"training":{{"seed":', run_id, ',"extra":{{"a":{{"b":', run_id%3, '}}}}}},"resolved_data":{{"x":{{"y":', run_id, '}}}},"{planner}":{{"heldout_segment":"', train_segment,
      '","fold_map":"m', run_id%7, '.json","scope":"', research_scope, '"}},"dataset":', CASE WHEN run_id%2=0 THEN concat('{{"segment":', val_segment, ',"train_npz":"t', run_id, '"}}') ELSE concat('{{"validation_mode":"', validation_mode, '","segment":', val_segment, '.0}}') END, '}}')"""
    r = views.runs(spark, sf).withColumn("doc", F.parse_json(F.expr(doc)))
    return _classes(B.loo_signature(B.config_kv(r, "run_id", "doc", depth=5), "run_id"), "loo_signature")


@query("b19_path_tail", """WITH t AS (SELECT run_id, concat(CASE WHEN run_id%2=0 THEN './' ELSE '' END, 'a/', run_id%4, '/fold.json') AS l, concat('/data/a/', run_id%3, '/fold.json') AS r FROM V_RUNS)
SELECT run_id, suffix(ltrim(l, './'), ltrim(r, '')) OR ends_with(r, ltrim(l, './')) AS same FROM t""")
def b19(spark, sf):
    left = F.expr("concat(CASE WHEN run_id%2=0 THEN './' ELSE '' END, 'a/', run_id%4, '/fold.json')")
    return views.runs(spark, sf).select("run_id", same_tail(left, F.expr("concat('/data/a/', run_id%3, '/fold.json')")).alias("same"))


@query("b20_config_violations", f"""WITH {CONFIG_CTE} SELECT run_id, concat_ws(',', CASE WHEN run_id%5 = 0 OR run_id%5 > 3 THEN 'model.depth' END, CASE WHEN run_id%12 = 0 THEN 'training.epochs' END,
 CASE WHEN CAST(doc->>'$.training.learning_rate' AS DOUBLE) <= 0 THEN 'training.learning_rate' END, CASE WHEN doc->>'$.training.pos_weight' = 'bad' THEN 'training.pos_weight' END,
 CASE WHEN CAST(doc->>'$.evaluation.threshold' AS DOUBLE) > 1 THEN 'evaluation.threshold' END, CASE WHEN (doc->>'$.dataset.train_npz' IS NULL) <> (doc->>'$.dataset.val_npz' IS NULL) THEN 'dataset.train_val_pair' END,
 CASE WHEN doc->>'$.training.seeds' = '[]' THEN 'training.seeds_empty' END, CASE WHEN CAST(doc->>'$.evaluation.min_pred_positive_rate_ratio' AS DOUBLE) > CAST(doc->>'$.evaluation.max_pred_positive_rate_ratio' AS DOUBLE)
  THEN 'evaluation.ratio_order' END) AS violations FROM cf""")
def b20(spark, sf):
    return configs(spark, sf).select("run_id", F.array_join(B.config_violations(F.col("doc")), ",").alias("violations"))


@query("b21_provenance", f"""WITH d AS (SELECT run_id, CAST({_META} AS JSON) AS m FROM V_RUNS),
s AS (SELECT run_id, unnest(list_concat([coalesce(m->>'$.metadata.segment_id', m->>'$.segment_id'), m->>'$.parent_full_tile.segment_id'], coalesce(CAST(m->'$.metadata.train_segments' AS VARCHAR[]), []),
  coalesce(CAST(m->'$.forbidden_heldout_segments' AS VARCHAR[]), []))) AS s FROM d)
SELECT d.run_id, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS segments FROM d LEFT JOIN (SELECT * FROM s WHERE s IS NOT NULL AND s NOT IN ('?', '')) s USING (run_id) GROUP BY 1""")
def b21(spark, sf):
    d = views.runs(spark, sf).withColumn("m", F.parse_json(F.expr(_META)))
    return d.select("run_id", F.array_join(B.provenance_segments(F.col("m")), ",").alias("segments"))


@query("b22_target_rate", """SELECT run_id, round(CASE run_id%5 WHEN 0 THEN val_positive_rate WHEN 1 THEN least(greatest(pred_positive_rate, 1e-6), 0.5) WHEN 2 THEN 0.07 WHEN 3 THEN val_positive_rate END, 9) AS target FROM V_RUNS""")
def b22(spark, sf):
    raw = F.expr("CASE run_id%5 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto_train' WHEN 2 THEN '0.07' WHEN 3 THEN ' Auto_Val ' END")
    return rounded(views.runs(spark, sf).select("run_id", B.target_rate(raw, F.col("pred_positive_rate"), F.col("val_positive_rate")).alias("target")))


@query("l3_config_leaves", f"""WITH {CONFIG_CTE}, x AS (SELECT run_id, s.key AS section, t.key AS leaf, t.value AS value, t.type AS type FROM cf, json_each(doc) s, json_each(s.value) t)
SELECT run_id, concat(section, '.', leaf) AS path, CASE type WHEN 'VARCHAR' THEN value->>'$' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN value::VARCHAR WHEN 'BOOLEAN' THEN value::VARCHAR
 ELSE round(CAST(value AS DOUBLE), 9)::VARCHAR END AS value FROM x""")
def l3(spark, sf):
    kv = B.config_kv(configs(spark, sf), "run_id", "doc")
    return kv.select("run_id", "path", B.leaf_text(F.col("v"), F.col("kind")).alias("value"))
