"""Fold, leave-one-out, cap and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgate import views
from evalgate.operators import caps as C
from evalgate.operators import compare as H
from evalgate.operators import folds as G
from evalgate.operators import metrics as M
from evalgate.plans.metric_queries import rnd, sweep_ctes
from evalgate.plans.registry import query, rounded
from evalgate.session import written

HARD = "3"
FOLDS = [str(i) for i in range(1, 9)]
SEEDS = ["A", "N", "R"]

# ---------------------------------------------------------------- shared SQL pieces

FLAG_CTE = """
fl AS (SELECT *, concat(heldout_segment, ':seed=', seed) AS row_id, returncode = 0 AND val_f1 IS NOT NULL AS ok,
  CASE WHEN val_positive_rate > 0 THEN pred_positive_rate/val_positive_rate END AS ratio FROM V_LOO),
al AS (SELECT *, coalesce(ok AND (precision = 0 OR recall = 0), false) AS zero_precision_or_recall,
  coalesce(ok AND val_positive_rate = 0, false) AS zero_positive_validation,
  coalesce(ok AND (ratio > 3.5 OR ratio < 0.1), false) AS positive_rate_alarm,
  coalesce(ok AND fixed_threshold_status <> 'ok', false) AS fixed_threshold_not_ok,
  coalesce(ok AND (best_threshold <= 0.01 OR best_threshold >= 0.99), false) AS threshold_edge_case,
  coalesce(ok AND coalesce(ap_prevalence_lift, CASE WHEN val_positive_rate > 0 THEN coalesce(average_precision, 0)/val_positive_rate END) < 1.25, false)
    AS weak_ap_prevalence_lift FROM fl)"""

WARN_CTE = f"""
pf AS (SELECT label, heldout_segment, count(DISTINCT seed) FILTER (WHERE ok) AS n, avg(val_f1) FILTER (WHERE ok) AS f1,
  avg(coalesce(average_precision, 0)) FILTER (WHERE ok) AS ap FROM al GROUP BY ALL),
pg AS (SELECT label, count(*) FILTER (WHERE ok) AS ok, count(DISTINCT seed) FILTER (WHERE ok) AS seeds FROM al GROUP BY ALL),
ex AS (SELECT label, f, s FROM (SELECT DISTINCT label FROM al), (SELECT unnest({FOLDS!r}) AS f), (SELECT unnest({SEEDS!r}) AS s)),
w AS (
 SELECT label, heldout_segment, seed, 4 AS rule, concat('failed_fold:', row_id, CASE WHEN error <> '' THEN ':' || error ELSE '' END) AS warning FROM al WHERE returncode <> 0
 UNION ALL SELECT label, heldout_segment, seed, 5, concat('missing_or_invalid_val_f1:', row_id) FROM al WHERE returncode = 0 AND NOT ok
 UNION ALL SELECT label, heldout_segment, seed, 6, concat('missing_average_precision:', row_id) FROM al WHERE ok AND average_precision IS NULL
 {" ".join(f"UNION ALL SELECT label, heldout_segment, seed, {9 + i}, concat('{a}:', row_id) FROM al WHERE {a}" for i, a in enumerate(G.ALARMS))}
 UNION ALL SELECT label, heldout_segment, NULL, 7, printf('hard_fold_low_f1:%s:%.6f', heldout_segment, f1) FROM pf WHERE heldout_segment = '{HARD}' AND f1 < 0.02
 UNION ALL SELECT label, heldout_segment, NULL, 8, printf('hard_fold_low_ap:%s:%.6f', heldout_segment, ap) FROM pf WHERE heldout_segment = '{HARD}' AND ap < 0.02
 UNION ALL SELECT label, heldout_segment, NULL, 16, concat('insufficient_fold_seed_repeats:', heldout_segment, ':', n, '/3') FROM pf WHERE n < 3
 UNION ALL SELECT label, NULL, NULL, 15, concat('insufficient_seed_repeats:', seeds, '/3') FROM pg WHERE ok > 0 AND seeds < 3
 UNION ALL SELECT label, NULL, NULL, 18, 'no_successful_folds' FROM pg WHERE ok = 0
 UNION ALL SELECT DISTINCT label, f, NULL, 2, concat('missing_expected_fold:', f) FROM ex WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.label = ex.label AND heldout_segment = f)
 UNION ALL SELECT label, f, s, 3, concat('missing_expected_seed_repeat:', f, ':', s) FROM ex WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.label = ex.label AND heldout_segment = f AND seed = s)
 UNION ALL SELECT label, f, s, 17, concat('missing_expected_seed_repeat:', f, ':', s) FROM ex
   WHERE NOT EXISTS (SELECT 1 FROM al WHERE ok AND al.label = ex.label AND heldout_segment = f AND seed = s)
     AND EXISTS (SELECT 1 FROM al WHERE al.label = ex.label AND heldout_segment = f AND seed = s))"""

SUMMARY_CTE = """
pfold AS (SELECT label, heldout_segment, avg(val_f1) AS f1, avg(coalesce(average_precision, 0)) AS ap FROM al WHERE ok GROUP BY ALL),
pseed AS (SELECT label, seed, median(val_f1) AS med FROM al WHERE ok GROUP BY ALL),
summary AS (SELECT t.*, f.* EXCLUDE (label), s.* EXCLUDE (label), a.* EXCLUDE (label), coalesce(wc, 0) AS warning_count,
   folds_successful > 0 AND coalesce(wc, 0) = 0 AS promotion_ready FROM
 (SELECT label, count(*) AS folds_requested, count(*) FILTER (WHERE ok) AS folds_successful, count(*) FILTER (WHERE NOT ok) AS folds_failed FROM al GROUP BY 1) t
 LEFT JOIN (SELECT label, median(f1) AS median_val_f1, avg(f1) AS mean_val_f1, min(f1) AS min_val_f1, max(f1) AS max_val_f1,
   avg(ap) AS mean_average_precision, min(f1) AS worst_fold_val_f1 FROM pfold GROUP BY 1) f USING (label)
 LEFT JOIN (SELECT label, median(med) AS median_over_seeds_median_val_f1, min(med) AS worst_seed_median_val_f1 FROM pseed GROUP BY 1) s USING (label)
 LEFT JOIN (SELECT label, median(coalesce(average_precision, 0)) AS median_average_precision, count(DISTINCT seed) AS distinct_successful_seeds,
   count(*) FILTER (WHERE zero_precision_or_recall) AS zero_precision_or_recall_count, count(*) FILTER (WHERE zero_positive_validation) AS zero_positive_validation_count,
   count(*) FILTER (WHERE positive_rate_alarm) AS positive_rate_alarm_count, count(*) FILTER (WHERE fixed_threshold_not_ok) AS fixed_threshold_not_ok_count,
   count(*) FILTER (WHERE threshold_edge_case) AS threshold_edge_case_count, count(*) FILTER (WHERE weak_ap_prevalence_lift) AS weak_ap_prevalence_lift_count
   FROM al WHERE ok GROUP BY 1) a USING (label)
 LEFT JOIN (SELECT label, count(*) AS wc FROM w GROUP BY 1) w2 USING (label)),
worst AS (SELECT label, heldout_segment AS worst_fold_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1, heldout_segment) AS rn FROM pfold) WHERE rn = 1)"""

FULL = f"WITH {FLAG_CTE}, {WARN_CTE}, {SUMMARY_CTE}"
NUM = ("median_val_f1, mean_val_f1, min_val_f1, max_val_f1, mean_average_precision, worst_fold_val_f1, "
       "median_over_seeds_median_val_f1, worst_seed_median_val_f1, median_average_precision")
SMALL_CAPS = [2.0, 2.5, 3.0]


def summary(spark, sf, rows=None):
    return G.loo_summarize(views.loo(spark, sf) if rows is None else rows, ["label"], 3, FOLDS, SEEDS, hard_fold_id=HARD)


def loo_once(spark, sf):
    """LOO rows for queries that use them more than once: each is an evaluation, so they are worked out and written once."""
    return written(views.loo(spark, sf))


# ---------------------------------------------------------------- folds


@query("g1_folds", """
WITH s AS (SELECT segment, count(*) AS n FROM V_BIGMAP GROUP BY 1)
SELECT a.segment AS heldout_segment, a.n AS val_samples, b.segment AS train_segment, b.n AS train_samples FROM s a JOIN s b ON a.segment <> b.segment""")
def g1(spark, sf):
    return G.build_folds(views.bigmap(spark, sf))


@query("g1_fold_sizes", """
WITH s AS (SELECT segment, count(*) AS n FROM V_BIGMAP GROUP BY 1)
SELECT a.segment AS heldout_segment, a.n AS val_samples, CAST(sum(b.n) AS BIGINT) AS train_samples, count(*) AS train_segments FROM s a JOIN s b ON a.segment <> b.segment GROUP BY 1, 2""")
def g1_sizes(spark, sf):
    return G.fold_sizes(views.bigmap(spark, sf))


@query("g2_fold_audit", """
SELECT fold AS fold_id, count(*) FILTER (WHERE label > 0.5) AS positive_pixels, count(*) AS total_pixels,
 round(count(*) FILTER (WHERE label > 0.5)/count(*), 9) AS positive_rate, count(*) FILTER (WHERE label > 0.5) >= 1000 AS usable
FROM V_SCORES GROUP BY 1""")
def g2(spark, sf):
    return rounded(G.audit_folds(views.scores(spark, sf), "fold", 1000))


@query("g3_task_plan", """
SELECT fold AS fold_id, s.i AS seed_ordinal, s.seed FROM (SELECT DISTINCT l_partkey AS fold FROM lineitem),
 (SELECT * FROM (VALUES (0, 11001), (1, 11018), (2, 11045)) v(i, seed)) s""")
def g3(spark, sf):
    return G.plan_tasks(views.scores(spark, sf), "l_partkey", [11001, 11018, 11045])


def extra_sets(spark, sf):
    return views.runs(spark, sf).groupBy("signature").agg(F.sort_array(F.collect_set("train_segment")).alias("segments"))


@query("g4_leakage", """
SELECT DISTINCT r.signature, f.val_segment AS heldout_segment FROM V_RUNS r JOIN (SELECT DISTINCT val_segment FROM V_RUNS) f
 ON r.train_segment = f.val_segment""")
def g4(spark, sf):
    return G.leakage(extra_sets(spark, sf), views.runs(spark, sf), "signature", "segments", "val_segment")


@query("g4_safe_sets", """
SELECT signature, string_agg(DISTINCT train_segment::VARCHAR, ',' ORDER BY train_segment::VARCHAR) AS segments FROM V_RUNS GROUP BY 1
HAVING NOT bool_or(train_segment % 2 = 0)""")
def g4_safe(spark, sf):
    held = views.runs(spark, sf).selectExpr("(run_id % 4) * 2 AS val_segment")
    out = G.safe_sets(extra_sets(spark, sf), held, "signature", "segments", "val_segment")
    return out.withColumn("segments", F.array_join(F.col("segments").cast("array<string>"), ","))


@query("g6_loo_summary", f"{FULL} SELECT label, folds_requested, folds_successful, folds_failed, {rnd(NUM)}, worst_fold_id, distinct_successful_seeds, "
       + ", ".join(f"coalesce({a}_count, 0) AS {a}_count" for a in G.ALARMS) + ", warning_count, promotion_ready FROM summary LEFT JOIN worst USING (label)")
def g6(spark, sf):
    return rounded(summary(spark, sf))


@query("g6_fold_means", f"""WITH {FLAG_CTE} SELECT label, heldout_segment, round(avg(val_f1), 9) AS val_f1,
 round(avg(coalesce(average_precision, 0)), 9) AS average_precision, count(DISTINCT seed) AS successful_seeds FROM al WHERE ok GROUP BY ALL""")
def g6_folds(spark, sf):
    return rounded(G.fold_means(views.loo(spark, sf), ["label"]))


@query("g6_seed_stats", f"""WITH {FLAG_CTE} SELECT label, seed, round(avg(val_f1), 9) AS mean_val_f1, round(median(val_f1), 9) AS median_val_f1,
 round(min(val_f1), 9) AS min_val_f1, round(avg(coalesce(average_precision, 0)), 9) AS mean_average_precision FROM al WHERE ok GROUP BY ALL""")
def g6_seeds(spark, sf):
    return rounded(G.seed_stats(views.loo(spark, sf), ["label"]))


@query("g6_status_counts", f"WITH {FLAG_CTE} SELECT label, coalesce(fixed_threshold_status, 'missing') AS status, count(*) AS rows FROM al WHERE ok GROUP BY ALL")
def g6_status(spark, sf):
    return G.status_counts(views.loo(spark, sf), ["label"])


@query("g6_warnings", f"WITH {FLAG_CTE}, {WARN_CTE} SELECT label, heldout_segment, seed, rule, warning FROM w")
def g6_warnings(spark, sf):
    return G.loo_warnings(views.loo(spark, sf), ["label"], 3, FOLDS, SEEDS, hard_fold_id=HARD)


@query("g6_warning_lists", f"""WITH {FLAG_CTE}, {WARN_CTE} SELECT label, string_agg(warning, '|' ORDER BY rule, coalesce(heldout_segment, ''), coalesce(seed, ''), warning)
 AS promotion_warnings FROM w GROUP BY 1""")
def g6_lists(spark, sf):
    w = G.loo_warnings(views.loo(spark, sf), ["label"], 3, FOLDS, SEEDS, hard_fold_id=HARD)
    return G.warning_lists(w, ["label"]).withColumn("promotion_warnings", F.array_join("promotion_warnings", "|"))


@query("g7_coverage", f"""
WITH r AS (SELECT DISTINCT l_partkey AS run_id, fold::VARCHAR AS f, seed AS s FROM V_SCORES),
ex AS (SELECT run_id, f, s FROM (SELECT DISTINCT run_id FROM r), (SELECT unnest({FOLDS!r}) AS f), (SELECT unnest({SEEDS!r}) AS s))
SELECT DISTINCT run_id, f AS heldout_segment, NULL AS seed, 'missing_expected_fold' AS kind FROM ex WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = ex.run_id AND r.f = ex.f)
UNION ALL SELECT run_id, f, s, 'missing_expected_seed_repeat' FROM ex WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = ex.run_id AND r.f = ex.f AND r.s = ex.s)""")
def g7(spark, sf):
    rows = M.confusion(views.scores(spark, sf), 0.5, ["l_partkey", "fold", "seed"])
    rows = rows.selectExpr("l_partkey AS run_id", "fold AS heldout_segment", "seed", "0 AS returncode", "f1 AS val_f1", "precision", "recall",
                           "pred_positive_rate", "1.0D AS val_positive_rate", "f1 AS average_precision", "f1 AS ap_prevalence_lift",
                           "'ok' AS fixed_threshold_status", "0.5D AS best_threshold")
    return G.coverage(rows, ["run_id"], FOLDS, SEEDS)


@query("g8_hard_fold", f"""WITH {FLAG_CTE}, h AS (SELECT label, avg(val_f1) AS val_f1, avg(coalesce(average_precision, 0)) AS average_precision,
  avg(ap_prevalence_lift) AS mean_ap_prevalence_lift, avg(val_positive_rate) AS mean_val_positive_rate, avg(pred_positive_rate) AS mean_pred_positive_rate
  FROM al WHERE ok AND heldout_segment = '{HARD}' GROUP BY 1)
SELECT label, '{HARD}' AS fold_id, {rnd('val_f1, average_precision, mean_ap_prevalence_lift, mean_val_positive_rate, mean_pred_positive_rate')},
 round(average_precision - 0.02, 9) AS average_precision_floor_delta, val_f1 >= 0.02 AND average_precision >= 0.02 AS passed, average_precision <= 0.03 AS audit_labels FROM h""")
def g8(spark, sf):
    return rounded(G.hard_fold(views.loo(spark, sf), ["label"], HARD))


@query("g8_recommended_actions", f"""WITH {FLAG_CTE}, h AS (SELECT label, avg(coalesce(average_precision, 0)) FILTER (WHERE heldout_segment = '{HARD}') <= 0.03 AS a,
   bool_or(fixed_threshold_not_ok) AS b, bool_or(positive_rate_alarm) AS c FROM al WHERE ok GROUP BY 1)
SELECT label, i - 1 AS ordinal, acts[i] AS action FROM (SELECT label, unnest(range(1, len(acts)+1)) AS i, acts FROM (
 SELECT label, list_filter([CASE WHEN a THEN 'audit_hard_fold_labels' END, CASE WHEN b THEN 'calibrate_fixed_threshold' END,
  CASE WHEN c THEN 'review_positive_rate_calibration' END], lambda x: x IS NOT NULL) AS acts FROM h))""")
def g8_actions(spark, sf):
    return G.recommended_actions(views.loo(spark, sf), ["label"], HARD)


@query("g9_row_alarms", f"WITH {FLAG_CTE} SELECT label, row_id, ok, round(ratio, 9) AS pred_to_val_ratio, {', '.join(G.ALARMS)} FROM al")
def g9(spark, sf):
    return rounded(G.row_alarms(views.loo(spark, sf)).select("label", "row_id", "ok", "pred_to_val_ratio", *G.ALARMS))


DIAG_CTE = """
dg AS (SELECT * REPLACE (zero_precision_or_recall OR coalesce(precision = 0 OR recall = 0, false) AS zero_precision_or_recall),
  coalesce(val_f1 < 0.04, false) AS low_f1, coalesce(ratio > 2.5, false) AS over_cap FROM al)"""


@query("g10_fold_diagnostics", f"""WITH {FLAG_CTE}, {DIAG_CTE} SELECT label, row_id, low_f1, over_cap,
 concat_ws(', ', CASE WHEN low_f1 THEN 'low_f1' END, CASE WHEN over_cap THEN 'over_cap' END, CASE WHEN zero_precision_or_recall THEN 'zero_precision_or_recall' END,
  CASE WHEN positive_rate_alarm THEN 'positive_rate_alarm' END, CASE WHEN fixed_threshold_not_ok THEN 'fixed_threshold_not_ok' END) AS flags FROM dg""")
def g10(spark, sf):
    return G.fold_diagnostics(views.loo(spark, sf), 2.5).select("label", "row_id", "low_f1", "over_cap", "flags")


@query("g10_diagnostics_summary", f"""WITH {FLAG_CTE}, {DIAG_CTE}, a AS (SELECT label, count(*) AS total_rows, count(*) FILTER (WHERE fixed_threshold_not_ok) AS fixed_threshold_not_ok_count,
 count(*) FILTER (WHERE positive_rate_alarm) AS positive_rate_alarm_count, count(*) FILTER (WHERE zero_precision_or_recall) AS zero_precision_or_recall_count,
 count(*) FILTER (WHERE over_cap) AS over_cap_count, count(*) FILTER (WHERE low_f1) AS low_f1_count, count(*) FILTER (WHERE heldout_segment = '{HARD}') AS hard_rows,
 avg(coalesce(average_precision, 0)) FILTER (WHERE heldout_segment = '{HARD}') AS ap, avg(ap_prevalence_lift) FILTER (WHERE heldout_segment = '{HARD}') AS lift FROM dg GROUP BY 1)
SELECT * EXCLUDE (ap, lift), CASE WHEN fixed_threshold_not_ok_count > 0 AND fixed_threshold_not_ok_count = total_rows THEN 'diagnose fixed-threshold calibration across all LOO rows'
 WHEN ap <= 0.03 OR lift < 1.5 THEN 'audit hard-fold labels/sampling before threshold tuning' ELSE 'review linked LOO diagnostics' END AS next_action FROM a""")
def g10_summary(spark, sf):
    return G.diagnostics_summary(G.fold_diagnostics(views.loo(spark, sf), 2.5), ["label"], HARD)


@query("g10_failure_reasons", f"""WITH {FLAG_CTE} SELECT label, coalesce(fixed_threshold_failure_reason, fixed_threshold_status, 'unknown') AS reason, count(*) AS rows
 FROM al WHERE fixed_threshold_not_ok GROUP BY ALL""")
def g10_reasons(spark, sf):
    return G.failure_reason_counts(G.fold_diagnostics(views.loo(spark, sf), 2.5), ["label"])


PROFILE_CTE = f"""
pr0 AS (SELECT label, count(*) AS row_count, sum(val_f1) AS sf, count(val_f1) AS nf, min(val_f1) AS minf, sum(average_precision) AS sa, count(average_precision) AS na,
  avg(val_f1) FILTER (WHERE ok) AS pf, avg(coalesce(average_precision, 0)) FILTER (WHERE ok) AS pa, avg(ap_prevalence_lift) AS mean_ap_prevalence_lift,
  avg(val_positive_rate) AS mean_val_positive_rate, avg(pred_positive_rate) AS mean_pred_positive_rate, bool_or(weak_ap_prevalence_lift) AS wl,
  bool_or(coalesce(fixed_threshold_status NOT IN ('ok', 'unknown', ''), false)) AS fw FROM al WHERE heldout_segment = '{HARD}' GROUP BY 1),
pr1 AS (SELECT *, (coalesce(sf, 0)+coalesce(pf, 0))/(nf+CASE WHEN pf IS NULL THEN 0 ELSE 1 END) AS mean_val_f1, least(minf, pf) AS min_val_f1,
  (coalesce(sa, 0)+coalesce(pa, 0))/(na+CASE WHEN pa IS NULL THEN 0 ELSE 1 END) AS mean_average_precision FROM pr0),
profile AS (SELECT *, CASE WHEN wl OR mean_ap_prevalence_lift < 2 OR mean_average_precision < 2*mean_val_positive_rate OR mean_average_precision < 0.05 THEN 'low_ap_near_prevalence'
  WHEN min_val_f1 < 0.04 THEN 'weak_fold_low_f1' WHEN fw THEN 'fixed_threshold_weak' ELSE 'review' END AS failure_mode FROM pr1)"""
SEVERITY = "CASE failure_mode WHEN 'low_ap_near_prevalence' THEN 'blocker' WHEN 'weak_fold_low_f1' THEN 'blocker' WHEN 'fixed_threshold_weak' THEN 'warning' ELSE 'info' END"
ACTION = ("CASE failure_mode WHEN 'low_ap_near_prevalence' THEN 'audit_hard_fold_labels_and_sampling' WHEN 'weak_fold_low_f1' THEN 'lower_positive_patch_pressure' "
          "WHEN 'fixed_threshold_weak' THEN 'calibrate_probability_scale' ELSE 'review_hard_fold_evidence' END")


@query("g12_hard_fold_profile", f"""WITH {FLAG_CTE}, {PROFILE_CTE} SELECT label, '{HARD}' AS fold_id, row_count,
 {rnd('mean_val_f1, min_val_f1, mean_average_precision, mean_ap_prevalence_lift, mean_val_positive_rate, mean_pred_positive_rate')},
 failure_mode, {SEVERITY} AS severity, {ACTION} AS recommended_action FROM profile""")
def g12(spark, sf):
    return rounded(G.hard_fold_profile(views.loo(spark, sf), ["label"], HARD))


@query("g13_failure_pattern", f"""{FULL}, {PROFILE_CTE},
gaps AS (SELECT label, count(*) FILTER (WHERE rule = 2) AS mf, count(*) FILTER (WHERE rule = 3) AS ms FROM w GROUP BY 1),
j AS (SELECT s.*, failure_mode, {SEVERITY} AS sev, {ACTION} AS act, mf, ms FROM summary s LEFT JOIN profile USING (label) LEFT JOIN gaps USING (label))
SELECT label, CASE WHEN sev = 'blocker' THEN 'hard_fold_' || failure_mode WHEN mf > 0 THEN 'missing_expected_folds' WHEN ms > 0 THEN 'missing_seed_repeats'
  WHEN zero_positive_validation_count > 0 THEN 'zero_positive_validation' WHEN fixed_threshold_not_ok_count > 0 THEN 'fixed_threshold_not_ok'
  WHEN positive_rate_alarm_count > 0 THEN 'positive_rate_alarm' WHEN weak_ap_prevalence_lift_count > 0 THEN 'weak_ap_prevalence_lift' ELSE 'none' END AS pattern,
 CASE WHEN sev = 'blocker' THEN act WHEN mf > 0 THEN 'complete_linked_loo_folds' WHEN ms > 0 THEN 'complete_seed_repeats'
  WHEN zero_positive_validation_count > 0 THEN 'audit_validation_labels' WHEN fixed_threshold_not_ok_count > 0 THEN 'calibrate_fixed_threshold'
  WHEN positive_rate_alarm_count > 0 THEN 'review_positive_rate_calibration' WHEN weak_ap_prevalence_lift_count > 0 THEN 'improve_ranking_signal' ELSE 'promotion_review' END AS next_step,
 NOT promotion_ready AS blocks_promotion FROM j""")
def g13(spark, sf):
    rows = loo_once(spark, sf)
    return G.failure_pattern(summary(spark, sf, rows), G.hard_fold_profile(rows, ["label"], HARD),
                             G.coverage(rows, ["label"], FOLDS, SEEDS), ["label"])


@query("g14_weak_fold_row", f"""WITH {FLAG_CTE}, {WARN_CTE}, {SUMMARY_CTE},
c AS (SELECT v.*, row_number() OVER (PARTITION BY label ORDER BY abs(coalesce(v.val_f1, 0) - s.worst_fold_val_f1), seed) AS rn
  FROM V_LOO v JOIN summary s USING (label) JOIN worst USING (label) WHERE heldout_segment = worst_fold_id)
SELECT label, heldout_segment, seed, artifact_dir, round(val_f1, 9) AS val_f1 FROM c WHERE rn = 1""")
def g14(spark, sf):
    rows = loo_once(spark, sf)
    return rounded(G.weak_fold_row(rows, summary(spark, sf, rows), ["label"], "artifact_dir"))


# ---------------------------------------------------------------- caps


def caps_ctes(by: str, caps: list[float]) -> str:
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"g.{k} = e.{k}" for k in keys)
    gk = ", ".join(f"g.{k}" for k in keys)
    return f"""
caps AS (SELECT unnest({caps!r}::DOUBLE[]) AS cap),
el AS (SELECT s.*, cap, row_number() OVER (PARTITION BY {by}, cap ORDER BY f1 DESC, precision DESC, pred_positive_rate, threshold) AS rn,
  count(*) OVER (PARTITION BY {by}, cap) AS cnt FROM sweep s, caps WHERE pred_positive_rate/greatest(val_positive_rate, 1e-12) <= cap),
grp AS (SELECT {by}, max(val_positive_rate) AS vpr FROM sweep GROUP BY {by}),
under AS (SELECT {gk}, g.vpr, g.cap, coalesce(e.cnt, 0) AS cnt, e.threshold, e.precision, e.recall, e.f05, e.f1, e.pred_positive_rate AS ppr
  FROM (SELECT * FROM grp, caps) g LEFT JOIN (SELECT * FROM el WHERE rn = 1) e ON {on} AND g.cap = e.cap)"""


def compare_caps_ctes(by: str) -> str:
    return f"""{caps_ctes(by, SMALL_CAPS)},
want AS (SELECT {by}, 0.3 + 0.05*(fold % 5) AS bt FROM grp),
selc AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY {by} ORDER BY abs(threshold - bt), threshold) AS rn FROM sweep s JOIN want USING ({by})) WHERE rn = 1),
cmp AS (SELECT u.*, s.f1 AS selected_f1, u.f1/greatest(s.f1, 1e-12) AS r1, u.f05/greatest(s.f05, 1e-12) AS r05, u.ppr/greatest(vpr, 1e-12) AS ratio
  FROM under u JOIN selc s USING ({by}) WHERE vpr > 0 AND s.f1 > 0)"""


def fold_seed_caps(spark, sf):
    by = ["fold", "seed"]
    rows = M.threshold_sweep(views.scores(spark, sf), by)
    metrics = rows.select(*by).distinct().withColumn("best_threshold", F.expr("0.3D + 0.05D*(fold % 5)"))
    return C.compare_caps(rows, by, metrics, SMALL_CAPS, keep=0.9)


_FS = "fold, seed"


@query("h4_cap_comparison", f"""WITH {sweep_ctes('V_SCORES', _FS)}, {compare_caps_ctes(_FS)}
SELECT fold, seed, cap, cnt AS eligible_threshold_count, round(threshold, 9) AS best_threshold, round(precision, 9) AS best_precision, round(recall, 9) AS best_recall,
 round(f05, 9) AS best_f05, round(f1, 9) AS best_f1, round(ppr, 9) AS best_pred_positive_rate, round(ratio, 9) AS best_ratio, round(selected_f1, 9) AS selected_f1,
 round(r1, 9) AS f1_retained_vs_selected, round(r05, 9) AS f05_retained_vs_selected, coalesce(r1 >= 0.9 AND r05 >= 0.9, false) AS passes FROM cmp""")
def h4(spark, sf):
    return rounded(fold_seed_caps(spark, sf))


@query("h4_recommended_cap", f"""WITH {sweep_ctes('V_SCORES', _FS)}, {compare_caps_ctes(_FS)},
rec AS (SELECT *, row_number() OVER (PARTITION BY fold, seed ORDER BY cap) AS rn FROM cmp WHERE r1 >= 0.9 AND r05 >= 0.9)
SELECT b.fold, b.seed, r.cap AS recommended_cap, round(r.f1, 9) AS recommended_f1, round(r.cap-b.cap, 9) AS cap_delta, round(r.f1-b.f1, 9) AS f1_delta, round(r.f05-b.f05, 9) AS f05_delta,
 round(r.recall-b.recall, 9) AS recall_delta, round(r.precision-b.precision, 9) AS precision_delta, round(r.ratio-b.ratio, 9) AS ratio_delta
FROM (SELECT * FROM cmp WHERE cap = 2.0) b LEFT JOIN (SELECT * FROM rec WHERE rn = 1) r USING (fold, seed)""")
def h4_recommended(spark, sf):
    return rounded(C.recommended_cap(fold_seed_caps(spark, sf), ["fold", "seed"]))


BATCH_CTE = """
bt AS (SELECT fold, cap, count(*) AS metrics_count, count(f1) AS eligible_count, avg(f1) AS mean_f1, median(f1) AS median_f1, min(f1) AS min_f1, avg(f05) AS mean_f05,
 avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(ratio) AS mean_ratio, avg(r1) AS mean_f1_retained, min(r1) AS min_f1_retained, avg(r05) AS mean_f05_retained,
 min(r05) AS min_f05_retained, bool_and(coalesce(r1 >= 0.9 AND r05 >= 0.9, false)) AS passes_retention_gate FROM cmp GROUP BY ALL)"""


@query("h5_batch_caps", f"""WITH {sweep_ctes('V_SCORES', _FS)}, {compare_caps_ctes(_FS)}, {BATCH_CTE} SELECT fold, cap, metrics_count, eligible_count,
 {rnd('mean_f1, median_f1, min_f1, mean_f05, mean_precision, mean_recall, mean_ratio, mean_f1_retained, min_f1_retained, mean_f05_retained, min_f05_retained')}, passes_retention_gate FROM bt""")
def h5(spark, sf):
    return rounded(C.compare_caps_batch(fold_seed_caps(spark, sf), ["fold"], 0.9))


@query("h5_best_batch_caps", f"""WITH {sweep_ctes('V_SCORES', _FS)}, {compare_caps_ctes(_FS)}, {BATCH_CTE}
SELECT fold, min(cap) FILTER (WHERE passes_retention_gate) AS recommended_cap, (list(cap ORDER BY coalesce(mean_f1, '-infinity'::DOUBLE) DESC, cap))[1] AS best_cap_by_mean_f1 FROM bt GROUP BY 1""")
def h5_best(spark, sf):
    return C.best_batch_caps(C.compare_caps_batch(fold_seed_caps(spark, sf), ["fold"], 0.9), ["fold"])


_LBL = "label, heldout_segment, seed"
_RECOMP = f"""WITH src AS (SELECT run_id AS lb, fold::VARCHAR AS heldout_segment, seed, prob, label FROM V_SCORES),
{sweep_ctes('src', 'lb, heldout_segment, seed')}, {caps_ctes('lb, heldout_segment, seed', SMALL_CAPS)},
j AS (SELECT l.*, c.cap, u.lb IS NOT NULL AS has, returncode = 0 AS was_ok, returncode = 0 AND u.f1 IS NOT NULL AS hit, u.f1 AS nf1, u.f05 AS nf05, u.precision AS np, u.recall AS nr,
   u.threshold AS nt, u.ppr AS nppr, u.vpr, replace(printf('%.1f', c.cap), '.', 'p') AS cl
  FROM V_LOO l CROSS JOIN caps c LEFT JOIN under u ON u.lb = l.label AND u.heldout_segment = l.heldout_segment AND u.seed = l.seed AND u.cap = c.cap),
rc AS (SELECT label, heldout_segment, seed, cap, CASE WHEN was_ok AND NOT hit THEN 1 ELSE returncode END AS returncode,
  CASE WHEN NOT was_ok THEN error WHEN NOT has THEN 'missing_artifact_metrics' WHEN nf1 IS NULL THEN 'no_threshold_row_under_prratio' || cl ELSE error END AS error,
  coalesce(val_positive_rate, CASE WHEN hit THEN vpr END) AS val_positive_rate, CASE WHEN hit THEN nf1 ELSE val_f1 END AS val_f1, CASE WHEN hit THEN nf05 ELSE val_f05 END AS val_f05,
  CASE WHEN hit THEN nt ELSE best_threshold END AS best_threshold, CASE WHEN hit THEN val_f1 END AS original_val_f1,
  CASE WHEN hit THEN 'recomputed_positive_rate_cap_' || cl END AS threshold_selection, CASE WHEN hit THEN nppr/greatest(vpr, 1e-12) END AS recomputed_ratio,
  CASE WHEN hit AND val_f1 > 0 THEN nf1/val_f1 END AS f1_retained_vs_original, CASE WHEN hit AND val_f05 > 0 THEN nf05/val_f05 END AS f05_retained_vs_original, average_precision FROM j)"""


def recomputed(spark, sf):
    by = ["run_id", "heldout_segment", "seed"]
    rows = M.sweep_steps(views.scores(spark, sf).withColumn("heldout_segment", F.col("fold").cast("string")), by).withColumnRenamed("run_id", "label")
    return C.recompute_caps(views.loo(spark, sf), rows, ["label", "heldout_segment", "seed"], SMALL_CAPS)


_RC_COLS = ["label", "heldout_segment", "seed", "cap", "returncode", "error", "val_positive_rate", "val_f1", "val_f05", "best_threshold", "original_val_f1",
            "threshold_selection", "recomputed_ratio", "f1_retained_vs_original", "f05_retained_vs_original"]


@query("g11_recomputed_rows", _RECOMP + " SELECT " + ", ".join(
    c if c in ("label", "heldout_segment", "seed", "cap", "returncode", "error", "threshold_selection") else f"round({c}, 9) AS {c}" for c in _RC_COLS) + " FROM rc")
def g11(spark, sf):
    return rounded(recomputed(spark, sf).select(*_RC_COLS))


@query("g11_cap_summary", _RECOMP + """ SELECT label, cap, round(avg(recomputed_ratio), 9) AS mean_recomputed_pred_to_val_ratio, round(median(recomputed_ratio), 9) AS median_recomputed_pred_to_val_ratio,
 round(max(recomputed_ratio), 9) AS max_recomputed_pred_to_val_ratio, round(avg(best_threshold), 9) AS mean_selected_threshold, round(avg(f1_retained_vs_original), 9) AS mean_f1_retained_vs_original,
 round(min(f1_retained_vs_original), 9) AS min_f1_retained_vs_original, round(avg(f05_retained_vs_original), 9) AS mean_f05_retained_vs_original,
 round(min(f05_retained_vs_original), 9) AS min_f05_retained_vs_original FROM rc WHERE returncode = 0 GROUP BY ALL""")
def g11_summary(spark, sf):
    return rounded(C.cap_policy_summary(recomputed(spark, sf), ["label"]))


@query("g11_best_caps", _RECOMP + """, okr AS (SELECT * FROM rc WHERE returncode = 0 AND val_f1 IS NOT NULL),
t AS (SELECT label, cap, count(*) FILTER (WHERE NOT (returncode = 0 AND val_f1 IS NOT NULL)) AS folds_failed FROM rc GROUP BY ALL),
m AS (SELECT label, cap, round(median(m), 12) AS med FROM (SELECT label, cap, seed, median(val_f1) AS m FROM okr GROUP BY ALL) GROUP BY ALL),
wf AS (SELECT label, cap, round(min(f), 12) AS worst FROM (SELECT label, cap, heldout_segment, avg(val_f1) AS f FROM okr GROUP BY ALL) GROUP BY ALL),
z AS (SELECT * FROM t LEFT JOIN m USING (label, cap) LEFT JOIN wf USING (label, cap) WHERE folds_failed = 0)
SELECT label, (list(cap ORDER BY med DESC, worst DESC, cap))[1] AS best_cap_by_median_over_seeds_f1, (list(cap ORDER BY worst DESC, med DESC, cap))[1] AS best_cap_by_worst_fold_f1 FROM z GROUP BY 1""")
def g11_best(spark, sf):
    rows = recomputed(spark, sf).withColumn("fixed_threshold_status", F.lit("ok"))
    return C.best_policy_caps(G.loo_summarize(rows, ["label", "cap"]), ["label"])


# ---------------------------------------------------------------- comparisons


def shifted(df, key: str, step: int):
    return df.withColumn(key, F.col(key) - step)


@query("h1_summary_deltas", f"""{FULL}, u AS (UNPIVOT (SELECT label, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in H.SUMMARY_METRICS[:-2])} FROM summary)
 ON COLUMNS(* EXCLUDE label) INTO NAME metric VALUE v)
SELECT b.label, b.metric, round(c.v, 9) AS candidate, round(b.v, 9) AS baseline, round(c.v-b.v, 9) AS delta FROM u b JOIN u c ON c.label = b.label + 1 AND c.metric = b.metric""")
def h1(spark, sf):
    s = written(summary(spark, sf))
    out = H.compare_loo(shifted(s, "label", 1), s, ["label"])
    return rounded(out.filter("candidate IS NOT NULL AND baseline IS NOT NULL"))


@query("h1_fold_deltas", f"""{FULL} SELECT b.label, b.heldout_segment, round(c.f1, 9) AS candidate, round(b.f1, 9) AS baseline, round(c.f1-b.f1, 9) AS delta
 FROM pfold b JOIN pfold c ON c.label = b.label + 1 AND c.heldout_segment = b.heldout_segment""")
def h1_folds(spark, sf):
    f = written(G.fold_means(views.loo(spark, sf), ["label"]))
    return rounded(H.fold_deltas(shifted(f, "label", 1), f, ["label"], "heldout_segment", "val_f1"))


@query("h2_paired_comparison", f"""{FULL}, fo AS (SELECT * FROM pfold),
d AS (SELECT coalesce(b.label, c.label - 1) AS label, c.f1 - b.f1 AS d, b.label IS NOT NULL AS ib, c.label IS NOT NULL AS ic
  FROM fo b FULL JOIN fo c ON c.label - 1 = b.label AND c.heldout_segment = b.heldout_segment),
a AS (SELECT label, count(d) AS paired_count, count(*) FILTER (WHERE ib AND ic) AS common, count(*) FILTER (WHERE NOT ib) AS candidate_only, count(*) FILTER (WHERE NOT ic) AS baseline_only,
  avg(d) AS mean_delta, median(d) AS median_delta, min(d) AS min_delta, max(d) AS max_delta, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses,
  count(*) FILTER (WHERE d = 0) AS ties FROM d GROUP BY 1)
SELECT * REPLACE (round(mean_delta, 9) AS mean_delta, round(median_delta, 9) AS median_delta, round(min_delta, 9) AS min_delta, round(max_delta, 9) AS max_delta),
 CASE WHEN wins+losses > 0 THEN round(least(1.0, 2.0*list_sum(list_transform(range(0, least(wins, losses)+1),
   lambda k: factorial((wins+losses)::INT)::DOUBLE/(factorial(k::INT)::DOUBLE*factorial((wins+losses-k)::INT)::DOUBLE)))/pow(2.0, wins+losses)), 9) END AS sign_test_two_sided_p FROM a""")
def h2(spark, sf):
    f = written(G.fold_means(views.loo(spark, sf), ["label"]))
    return rounded(H.paired_compare(shifted(f, "label", 1), f, ["label"], "heldout_segment", "val_f1"))


_PAIRS = f"""{FULL}, u AS (SELECT label, 'per_fold_val_f1' AS metric, heldout_segment AS item, f1 AS v FROM pfold UNION ALL SELECT label, 'per_fold_average_precision', heldout_segment, ap FROM pfold
 UNION ALL SELECT label, 'per_seed_median_val_f1', CAST(seed AS VARCHAR), med FROM pseed),
d AS (SELECT coalesce(b.label, c.label - 1) AS label, coalesce(b.metric, c.metric) AS metric, coalesce(b.item, c.item) AS item, c.v AS cv, b.v AS bv, c.v - b.v AS d, b.label IS NOT NULL AS ib, c.label IS NOT NULL AS ic
  FROM u b FULL JOIN u c ON c.label - 1 = b.label AND c.metric = b.metric AND c.item = b.item)"""


def paired_sides(spark, sf):
    rows = loo_once(spark, sf)
    values = written(H.paired_values(G.fold_means(rows, ["label"]), G.seed_stats(rows, ["label"]), ["label"]))
    return shifted(values, "label", 1), values


@query("h2_paired_comparisons", _PAIRS + """, a AS (SELECT label, metric, count(d) AS paired_count, count(*) FILTER (WHERE ib AND ic) AS common, count(*) FILTER (WHERE NOT ib) AS candidate_only, count(*) FILTER (WHERE NOT ic) AS baseline_only,
  avg(d) AS mean_delta, median(d) AS median_delta, min(d) AS min_delta, max(d) AS max_delta, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses,
  count(*) FILTER (WHERE d = 0) AS ties FROM d GROUP BY ALL)
SELECT * REPLACE (round(mean_delta, 9) AS mean_delta, round(median_delta, 9) AS median_delta, round(min_delta, 9) AS min_delta, round(max_delta, 9) AS max_delta),
 CASE WHEN wins+losses > 0 THEN round(least(1.0, 2.0*list_sum(list_transform(range(0, least(wins, losses)+1),
   lambda k: factorial((wins+losses)::INT)::DOUBLE/(factorial(k::INT)::DOUBLE*factorial((wins+losses-k)::INT)::DOUBLE)))/pow(2.0, wins+losses)), 9) END AS sign_test_two_sided_p FROM a""")
def h2_metrics(spark, sf):
    return rounded(H.paired_compare(*paired_sides(spark, sf), ["label", "metric"], "item", "value"))


@query("h2_paired_items", _PAIRS + """ SELECT label, metric, item, CASE WHEN NOT ib THEN 'candidate_only' WHEN NOT ic THEN 'baseline_only' ELSE 'common' END AS side,
 round(cv, 9) AS candidate, round(bv, 9) AS baseline, round(d, 9) AS delta FROM d""")
def h2_items(spark, sf):
    return rounded(H.paired_items(*paired_sides(spark, sf), ["label", "metric"], "item", "value"))


_WARNED = ", ".join(f"coalesce({w}, 0) AS {w}" for w in H.SUMMARY_WARNINGS)


@query("h1_warning_counts", f"""{FULL}, u AS (UNPIVOT (SELECT label, {_WARNED} FROM summary) ON COLUMNS(* EXCLUDE label) INTO NAME warning VALUE v)
SELECT coalesce(b.label, c.label - 1) AS label, coalesce(b.warning, c.warning) AS warning, coalesce(c.v, 0) AS candidate, coalesce(b.v, 0) AS baseline, coalesce(c.v, 0) - coalesce(b.v, 0) AS delta
 FROM u b FULL JOIN u c ON c.label - 1 = b.label AND c.warning = b.warning""")
def h1_warnings(spark, sf):
    s = written(summary(spark, sf))
    return H.compare_warnings(shifted(s, "label", 1), s, ["label"])


@query("h1_worst_folds", f"""{FULL}, o AS (SELECT label, arg_min(heldout_segment, (f1, heldout_segment)) AS id, min(f1) AS v FROM pfold WHERE f1 IS NOT NULL GROUP BY 1)
SELECT b.label, c.id AS candidate_worst_fold_id, round(c.v, 9) AS candidate_worst_value, b.id AS baseline_worst_fold_id, round(b.v, 9) AS baseline_worst_value, c.id = b.id AS same_fold FROM o b JOIN o c ON c.label - 1 = b.label""")
def h1_worst(spark, sf):
    f = written(G.fold_means(views.loo(spark, sf), ["label"]))
    return rounded(H.worst_fold_change(shifted(f, "label", 1), f, ["label"], "heldout_segment", "val_f1"))


@query("h3_gates", f"""{FULL}, s AS (SELECT * REPLACE (coalesce(positive_rate_alarm_count, 0) AS positive_rate_alarm_count, coalesce(zero_precision_or_recall_count, 0) AS zero_precision_or_recall_count,
  coalesce(fixed_threshold_not_ok_count, 0) AS fixed_threshold_not_ok_count) FROM summary)
SELECT label, 0 AS ordinal, 'all folds succeeded' AS gate, folds_failed = 0 AS passed, concat('folds_failed=', folds_failed) AS detail FROM s
UNION ALL SELECT label, 1, 'no positive-rate alarms', positive_rate_alarm_count = 0, concat('count=', positive_rate_alarm_count) FROM s
UNION ALL SELECT label, 2, 'no zero precision/recall alarms', zero_precision_or_recall_count = 0, concat('count=', zero_precision_or_recall_count) FROM s
UNION ALL SELECT label, 3, 'median-over-seeds F1 floor', coalesce(median_over_seeds_median_val_f1 >= 0.3, false), concat('value=', coalesce(printf('%.6f', median_over_seeds_median_val_f1), 'None'), ', floor=0.3') FROM s
UNION ALL SELECT label, 4, 'mean AP floor', coalesce(mean_average_precision >= 0.35, false), concat('value=', coalesce(printf('%.6f', mean_average_precision), 'None'), ', floor=0.35') FROM s
UNION ALL SELECT label, 5, 'worst-fold F1 floor', coalesce(worst_fold_val_f1 >= 0.2, false), concat('value=', coalesce(printf('%.6f', worst_fold_val_f1), 'None'), ', floor=0.2') FROM s
UNION ALL SELECT label, 6, 'fixed-threshold warning cap', fixed_threshold_not_ok_count <= 2, concat('count=', fixed_threshold_not_ok_count, ', cap=2') FROM s""")
def h3(spark, sf):
    return H.loo_gates(summary(spark, sf), ["label"], 0.3, 0.35, 0.2, 2)


# whole-map pairs: run r as baseline, run r+1 (same table) as candidate

_MM = "val_f1, val_f05, average_precision, precision, recall, val_positive_rate, pred_positive_rate, pred_to_val_ratio, best_threshold"
_MAPS_CTE = f"""
vals AS (SELECT run_id, val_segment, val_f1, val_f05, average_precision, precision_ AS precision, recall_ AS recall, val_positive_rate, pred_positive_rate,
  CASE WHEN val_positive_rate <> 0 THEN pred_positive_rate/greatest(val_positive_rate, 1e-12) END AS pred_to_val_ratio, best_threshold FROM V_RUNS),
lm AS (UNPIVOT (SELECT run_id, {_MM} FROM vals) ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE v),
pairs AS (SELECT coalesce(b.run_id, c.run_id - 1) AS run_id, coalesce(b.metric, c.metric) AS metric, b.v AS baseline, c.v AS candidate, c.v - b.v AS delta
  FROM lm b FULL JOIN lm c ON c.run_id - 1 = b.run_id AND c.metric = b.metric)"""


def map_rows(spark, sf):
    m = views.runs(spark, sf).withColumnsRenamed({"precision_": "precision", "recall_": "recall"})
    return H.compare_maps(m, shifted(m, "run_id", 1), ["run_id"])


@query("h6_map_deltas", f"WITH {_MAPS_CTE} SELECT run_id, metric, round(baseline, 9) AS baseline, round(candidate, 9) AS candidate, round(delta, 9) AS delta FROM pairs")
def h6(spark, sf):
    return rounded(map_rows(spark, sf))


_GAIN = ("CASE WHEN metric IN ('brier_score', 'expected_calibration_error', 'pred_to_val_ratio', 'selected_pred_to_val_ratio') THEN -delta "
         "WHEN metric IN ('val_f1', 'val_f05', 'average_precision', 'ap_prevalence_lift', 'fixed_threshold_f1', 'selected_f1', 'selected_f05') THEN delta END")


@query("h6_map_verdicts", f"""WITH {_MAPS_CTE}, g AS (SELECT run_id, count(*) FILTER (WHERE {_GAIN} > 0) AS improved, count(*) FILTER (WHERE {_GAIN} < 0) AS regressed FROM pairs GROUP BY 1)
SELECT *, CASE WHEN improved > 0 AND regressed = 0 THEN 'candidate_improves_tracked_metrics' WHEN regressed > 0 AND improved = 0 THEN 'candidate_regresses_tracked_metrics' ELSE 'mixed' END AS verdict FROM g""")
def h6_verdicts(spark, sf):
    return H.map_verdicts(map_rows(spark, sf), ["run_id"])


@query("h6_pair_warnings", """
WITH p AS (SELECT b.run_id, b.val_segment AS bs, c.val_segment AS cs, CASE b.run_id % 3 WHEN 0 THEN 'whole_segment' WHEN 1 THEN 'tile' END AS bt,
  CASE c.run_id % 3 WHEN 0 THEN 'whole_segment' WHEN 1 THEN 'tile' END AS ct FROM V_RUNS b JOIN V_RUNS c ON c.run_id = b.run_id + 1)
SELECT run_id, concat_ws('|', CASE WHEN bs <> cs THEN concat('segment mismatch: baseline=', bs, ', candidate=', cs) END,
 CASE WHEN bt <> 'whole_segment' THEN 'baseline evaluation_region.type is ' || bt END, CASE WHEN ct <> 'whole_segment' THEN 'candidate evaluation_region.type is ' || ct END) AS warnings FROM p""")
def h6_warnings(spark, sf):
    r = views.runs(spark, sf).selectExpr("run_id", "val_segment AS segment", "CASE run_id % 3 WHEN 0 THEN 'whole_segment' WHEN 1 THEN 'tile' END AS region_type")
    b = r.withColumnsRenamed({"segment": "baseline_segment", "region_type": "baseline_region_type"})
    c = shifted(r, "run_id", 1).withColumnsRenamed({"segment": "candidate_segment", "region_type": "candidate_region_type"})
    return H.map_pair_warnings(b.join(c, "run_id")).select("run_id", F.array_join("warnings", "|").alias("warnings"))


_STATUS_CTE = """
wd AS (SELECT run_id, max(delta) FILTER (WHERE metric = 'val_f1') AS f1, max(delta) FILTER (WHERE metric = 'val_f05') AS f05,
  max(delta) FILTER (WHERE metric = 'average_precision') AS ap, max(delta) FILTER (WHERE metric = 'pred_to_val_ratio') AS ra FROM pairs GROUP BY 1),
st AS (SELECT *, CASE WHEN f1 IS NULL OR f05 IS NULL OR ap IS NULL THEN 'incomplete' WHEN f1 > 0 AND f05 >= 0 AND ap > 0 AND (ra IS NULL OR ra <= 0.01) THEN 'core_improved'
  WHEN f1 < 0 OR f05 < 0 OR ap < 0 OR ra > 0.01 THEN 'core_regressed' ELSE 'mixed' END AS status FROM wd)"""


@query("h7_pair_status", f"""WITH {_MAPS_CTE}, {_STATUS_CTE} SELECT run_id, status, round(f1, 9) AS val_f1_delta, round(f05, 9) AS val_f05_delta, round(ap, 9) AS average_precision_delta,
 round(ra, 9) AS pred_to_val_ratio_delta FROM st""")
def h7(spark, sf):
    out = H.pair_status(map_rows(spark, sf), ["run_id"])
    return rounded(out.select("run_id", "status", "val_f1_delta", "val_f05_delta", "average_precision_delta", "pred_to_val_ratio_delta"))


@query("h7_comparison_summary", f"""WITH {_MAPS_CTE}, {_STATUS_CTE}, a AS (SELECT run_id % 500 AS pair_set, count(*) AS pair_count, count(*) FILTER (WHERE status = 'core_improved') AS core_improved,
  count(*) FILTER (WHERE status = 'core_regressed') AS core_regressed, count(*) FILTER (WHERE status = 'mixed') AS mixed, count(*) FILTER (WHERE status = 'incomplete') AS incomplete,
  round(avg(f1), 9) AS mean_val_f1_delta, round(avg(ap), 9) AS mean_average_precision_delta FROM st GROUP BY 1)
SELECT *, CASE WHEN core_improved = pair_count THEN 'candidate_improves_core_metrics_all_pairs' WHEN core_regressed = pair_count THEN 'candidate_regresses_core_metrics_all_pairs'
 WHEN core_improved > 0 AND core_regressed > 0 THEN 'mixed_core_evidence' ELSE 'incomplete_or_mixed_core_evidence' END AS verdict FROM a""")
def h7_summary(spark, sf):
    st = H.pair_status(map_rows(spark, sf), ["run_id"]).withColumn("pair_set", F.expr("run_id % 500"))
    cols = ["pair_set", "pair_count", "core_improved", "core_regressed", "mixed", "incomplete", "mean_val_f1_delta", "mean_average_precision_delta", "verdict"]
    return rounded(H.summarize_comparisons(st, ["pair_set"]).select(*cols))


@query("h8_config_diff", """
WITH kv AS (UNPIVOT (SELECT run_id, model_name AS "model.name", research_scope AS "dataset.research_scope", validation_mode AS "dataset.validation_mode",
  train_segment::VARCHAR AS "dataset.train_segment", fixed_threshold_status AS "evaluation.status" FROM V_RUNS) ON COLUMNS(* EXCLUDE run_id) INTO NAME path VALUE v),
d AS (SELECT coalesce(l.run_id, r.run_id - 1) AS run_id, coalesce(l.path, r.path) AS path, l.v AS left_value, r.v AS right_value
  FROM kv l FULL JOIN kv r ON r.run_id - 1 = l.run_id AND r.path = l.path WHERE l.v IS DISTINCT FROM r.v)
SELECT * FROM d""")
def h8(spark, sf):
    kv = config_kv(spark, sf)
    return H.config_diff(kv, shifted(kv, "run_id", 1), ["run_id"])


def config_kv(spark, sf):
    wide = views.runs(spark, sf).selectExpr(
        "run_id", "model_name AS `model.name`", "research_scope AS `dataset.research_scope`", "validation_mode AS `dataset.validation_mode`",
        "CAST(train_segment AS STRING) AS `dataset.train_segment`", "fixed_threshold_status AS `evaluation.status`")
    names = [f"`{c}`" for c in wide.columns if c != "run_id"]
    return wide.unpivot(["run_id"], names, "path", "value").filter("value IS NOT NULL")


_RISK_PAIRS = """
tl AS (SELECT val_segment AS cand, * FROM V_RUNS),
lp AS (SELECT t.cand, t.run_id, t.pred_positive_rate AS lpp, t.val_positive_rate AS lvp, o.pred_positive_rate AS pp, o.val_positive_rate AS vp, o.val_f1 AS f1, t.val_f1 AS lf1,
  o.average_precision AS ap, t.average_precision AS lap FROM tl t JOIN V_RUNS o ON o.run_id = t.run_id + 1)"""


def risk_pairs(spark, sf):
    r = views.runs(spark, sf)
    left = r.selectExpr("val_segment AS cand", "run_id", "pred_positive_rate AS loo_pred_positive_rate", "val_positive_rate AS loo_val_positive_rate",
                        "val_f1 AS loo_val_f1", "average_precision AS loo_average_precision")
    right = shifted(r.select("run_id", "pred_positive_rate", "val_positive_rate", "val_f1", "average_precision"), "run_id", 1)
    return left.join(right, "run_id")


@query("h9_risk_rows", f"""WITH {_RISK_PAIRS}, x AS (SELECT *, CASE WHEN abs(pp) >= 1e-9 THEN lpp/pp END AS sf, CASE WHEN abs(lvp) >= 1e-9 THEN lpp/lvp END AS sv, CASE WHEN abs(vp) >= 1e-9 THEN pp/vp END AS fv FROM lp)
SELECT run_id, round(sf, 9) AS sampled_to_full_ratio, round(sv, 9) AS sampled_pred_to_val_ratio, round(fv, 9) AS full_pred_to_val_ratio, round(f1-lf1, 9) AS f1_delta, round(ap-lap, 9) AS ap_delta,
 coalesce(fv >= 3.5, false) AS high, coalesce(sf < 0.5 OR sf > 2.0, false) AS divergent FROM x""")
def h9(spark, sf):
    cols = ["run_id", "sampled_to_full_ratio", "sampled_pred_to_val_ratio", "full_pred_to_val_ratio", "f1_delta", "ap_delta", "high", "divergent"]
    return rounded(H.risk_rows(risk_pairs(spark, sf)).select(*cols))


@query("h9_risk_summary", f"""WITH {_RISK_PAIRS}, x AS (SELECT *, CASE WHEN abs(pp) >= 1e-9 THEN lpp/pp END AS sf, CASE WHEN abs(vp) >= 1e-9 THEN pp/vp END AS fv FROM lp),
c AS (SELECT cand, CASE WHEN abs(val_positive_rate) >= 1e-9 THEN pred_positive_rate/val_positive_rate END AS cr
  FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY val_f1 DESC, run_id DESC) AS rn FROM tl) WHERE rn = 1),
t AS (SELECT cand, count(*) FILTER (WHERE abs(val_positive_rate) >= 1e-9 AND pred_positive_rate/val_positive_rate >= 3.5) AS ht FROM tl GROUP BY 1),
p AS (SELECT cand, count(*) FILTER (WHERE fv >= 3.5) AS hl, count(*) FILTER (WHERE sf < 0.5 OR sf > 2.0) AS dv FROM x GROUP BY 1),
j AS (SELECT cand, cr, coalesce(ht, 0) AS ht, coalesce(hl, 0) AS hl, coalesce(dv, 0) AS dv FROM c LEFT JOIN t USING (cand) LEFT JOIN p USING (cand))
SELECT cand, round(cr, 9) AS candidate_ratio, ht AS high_tiles, hl AS high_loo_tiles, dv AS divergent_tiles, concat_ws('|', CASE WHEN cr >= 3.5 THEN 'candidate_ratio_high' END,
 CASE WHEN ht > 0 THEN 'full_tile_ratio_high' END, CASE WHEN hl > 0 THEN 'loo_full_tile_ratio_high' END, CASE WHEN dv > 0 THEN 'sampled_full_tile_divergent' END) AS warnings,
 CASE WHEN cr >= 3.5 OR ht > 0 OR hl > 0 OR dv > 0 THEN 'warning' ELSE 'ok' END AS risk_level FROM j""")
def h9_summary(spark, sf):
    r = views.runs(spark, sf)
    tiles = r.withColumn("cand", F.col("val_segment"))
    best = F.max_by(F.struct("pred_positive_rate", "val_positive_rate"), F.struct("val_f1", "run_id"))
    cands = tiles.groupBy("cand").agg(best.alias("b")).select("cand", "b.*")
    out = H.risk_summary(cands, tiles, risk_pairs(spark, sf), ["cand"])
    return rounded(out.withColumn("warnings", F.array_join("warnings", "|")))
