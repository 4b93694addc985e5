"""Metric queries on the score views, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgate import views
from evalgate.functions.scores import EVEN_THRESHOLDS, QUANTILES, ece_edges
from evalgate.operators import metrics as M
from evalgate.plans.registry import query, rounded

GROUP = ["run_id", "fold", "seed"]
ORDER = ["l_orderkey", "fold", "l_partkey", "run_id"]
CAP = M.EvalConfig(max_ratio=2.5, target_rate="auto_val")


def sql_list(values: list[float]) -> str:
    return "[" + ", ".join(f"{v:.17e}" for v in values) + "]"


def metric_sql(tp: str, fp: str, fn: str, n: str) -> str:
    """Confusion metrics as nested SQL expressions."""
    p = f"(({tp})/greatest(({tp})+({fp}), 1.0))"
    r = f"(({tp})/greatest(({tp})+({fn}), 1.0))"
    return (
        f"{p} AS precision, {r} AS recall, 1.25*{p}*{r}/greatest(0.25*{p}+{r}, 1e-9) AS f05, "
        f"2.0*{p}*{r}/greatest({p}+{r}, 1e-9) AS f1, (({tp})+({fp}))/({n}) AS pred_positive_rate"
    )


def sweep_ctes(view: str = "V_SCORES", by: str = "run_id, fold, seed") -> str:
    """Brute-force sweep: every threshold against every distinct score of its group."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"g.{k} = v.{k}" for k in keys)
    gby = ", ".join(f"g.{k}" for k in keys)
    metrics = metric_sql("tp", "fp", "fn", "n")
    return f"""
lists AS (SELECT {by}, list_sort(list(CAST(prob AS DOUBLE))) AS l FROM {view} GROUP BY {by}),
qs AS (SELECT {by}, l, unnest({sql_list(QUANTILES)}) AS q FROM lists),
qt AS (SELECT {by}, l, (len(l)-1)*q AS t FROM qs),
qv AS (SELECT {by}, CASE WHEN floor(t)+1 > len(l)-1 THEN l[CAST(floor(t) AS BIGINT)+1]
              ELSE l[CAST(floor(t) AS BIGINT)+1]
                 + (l[CAST(floor(t) AS BIGINT)+2]-l[CAST(floor(t) AS BIGINT)+1])*(t-floor(t)) END AS threshold FROM qt),
grid AS (SELECT {by}, threshold FROM qv UNION
         SELECT {by}, unnest({sql_list([*EVEN_THRESHOLDS, 0.5])}) FROM lists),
vals AS (SELECT {by}, CAST(prob AS DOUBLE) AS prob, count(*) AS n,
                count(*) FILTER (WHERE label > 0.5) AS pos FROM {view} GROUP BY ALL),
cnt AS (SELECT {gby}, g.threshold,
               CAST(coalesce(sum(v.pos) FILTER (WHERE v.prob >= g.threshold), 0) AS DOUBLE) AS tp,
               CAST(coalesce(sum(v.n-v.pos) FILTER (WHERE v.prob >= g.threshold), 0) AS DOUBLE) AS fp,
               CAST(coalesce(sum(v.pos) FILTER (WHERE v.prob < g.threshold), 0) AS DOUBLE) AS fn,
               CAST(sum(v.n) AS DOUBLE) AS n, CAST(sum(v.pos) AS DOUBLE) AS p
        FROM grid g JOIN vals v ON {on} GROUP BY {gby}, g.threshold),
sweep AS (SELECT {by}, threshold, p/n AS val_positive_rate, {metrics} FROM cnt)"""


def pick_sql(metric: str, by: str = "run_id, fold, seed") -> str:
    return (
        f"row_number() OVER (PARTITION BY {by}, ok ORDER BY {metric} DESC, abs(pred_positive_rate-val_positive_rate), "
        "precision DESC, pred_positive_rate, threshold)"
    )


def selection_ctes(by: str = "run_id, fold, seed") -> str:
    keys = [k.strip() for k in by.split(",")]
    using = f"USING ({by})"
    return f"""
banded AS (SELECT *, pred_positive_rate/greatest(val_positive_rate, 1e-12) <= 2.5 AS ok FROM sweep),
allrows AS (SELECT * REPLACE (true AS ok) FROM banded),
b1 AS (SELECT *, {pick_sql('f1', by)} AS rn FROM banded),
b2 AS (SELECT *, {pick_sql('f1', by)} AS rn FROM allrows),
b3 AS (SELECT *, {pick_sql('f05', by)} AS rn FROM allrows),
selected AS (SELECT {", ".join("b2." + k for k in keys)},
   coalesce(b1.threshold, b2.threshold) AS threshold, coalesce(b1.f1, b2.f1) AS f1, coalesce(b1.f05, b2.f05) AS f05,
   coalesce(b1.precision, b2.precision) AS precision, coalesce(b1.recall, b2.recall) AS recall,
   coalesce(b1.pred_positive_rate, b2.pred_positive_rate) AS pred_positive_rate, b2.val_positive_rate,
   b3.f05 AS val_f05, CASE WHEN b1.threshold IS NULL THEN 'best_f1' ELSE 'positive_rate_constrained' END AS threshold_selection
  FROM (SELECT * FROM b2 WHERE rn = 1) b2
  LEFT JOIN (SELECT * FROM b1 WHERE rn = 1 AND ok) b1 {using}
  JOIN (SELECT * FROM b3 WHERE rn = 1) b3 {using})"""


def status_ctes(by: str = "run_id, fold, seed") -> str:
    return f"""
fixedrow AS (SELECT s.*, sel.f1 AS best_f1 FROM sweep s JOIN selected sel USING ({by}) WHERE s.threshold = 0.5),
status AS (SELECT {by}, f1 AS fixed_threshold_f1, precision AS fixed_threshold_precision, recall AS fixed_threshold_recall,
  best_f1 AS val_f1, CASE WHEN f1 >= 0.5*best_f1 THEN 'ok' ELSE 'weak' END AS fixed_threshold_status,
  CASE WHEN f1 >= 0.5*best_f1 THEN 'ok' WHEN pred_positive_rate <= 0 THEN 'no_fixed_positive_predictions'
       WHEN precision <= 0 THEN 'fixed_zero_precision' WHEN recall <= 0 THEN 'fixed_zero_recall'
       ELSE 'weak_relative_to_selected_f1' END AS fixed_threshold_failure_reason FROM fixedrow)"""


def ap_ctes(view: str = "V_SCORES", by: str = "run_id, fold, seed",
            order: str = "l_orderkey, fold, l_partkey, run_id") -> str:
    return f"""
ranked AS (SELECT {by}, CASE WHEN label > 0.5 THEN 1 ELSE 0 END AS y,
   row_number() OVER (PARTITION BY {by} ORDER BY prob DESC, {order}) AS k,
   sum(CASE WHEN label > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY prob DESC, {order}
        ROWS UNBOUNDED PRECEDING) AS hits FROM {view}),
ap AS (SELECT {by}, sum(y) AS positives, CASE WHEN sum(y) > 0
   THEN sum(CASE WHEN y = 1 THEN CAST(hits AS DOUBLE)/k ELSE 0 END)/sum(y) ELSE 0.0 END AS average_precision
  FROM ranked GROUP BY {by})"""


def ece_ctes(view: str = "V_SCORES", by: str = "run_id, fold, seed") -> str:
    edges = ece_edges(15)
    return f"""
bins AS (SELECT {by}, prob, label, CASE WHEN prob < {edges[0]!r} OR prob > {edges[-1]!r} THEN NULL ELSE
   len(list_filter({sql_list(edges[1:-1])}, lambda e: prob >= e)) END AS bin FROM {view}),
binned AS (SELECT {by}, bin, count(*) AS n, sum(prob) AS conf, count(*) FILTER (WHERE label > 0.5) AS pos
   FROM bins GROUP BY ALL),
ece AS (SELECT {by}, coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(conf/n - CAST(pos AS DOUBLE)/n)*n END), 0)/sum(n)
   AS expected_calibration_error FROM binned GROUP BY {by})"""


LOSS_SQL = ("avg((prob-CASE WHEN label>0.5 THEN 1.0 ELSE 0.0 END)*(prob-CASE WHEN label>0.5 THEN 1.0 ELSE 0.0 END)) AS brier_score, "
            "-avg(label*ln(prob+1e-7)+(1.0-label)*ln(1.0-prob+1e-7)) AS log_loss")


def rnd(cols: str, digits: int = 9) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in cols.split(","))


_SWEEP_COLS = "precision, recall, f05, f1, pred_positive_rate"


@query("e1_confusion", f"""
SELECT run_id, fold, seed, 0.5::DOUBLE AS threshold, n, tp, fp, fn, {rnd(_SWEEP_COLS)} FROM (
 SELECT *, {metric_sql('tp::DOUBLE', 'fp::DOUBLE', 'fn::DOUBLE', 'n::DOUBLE')} FROM (
  SELECT run_id, fold, seed, count(*) AS n, count(*) FILTER (WHERE prob >= 0.5 AND label > 0.5) AS tp,
   count(*) FILTER (WHERE prob >= 0.5 AND label <= 0.5) AS fp, count(*) FILTER (WHERE prob < 0.5 AND label > 0.5) AS fn
  FROM V_SCORES GROUP BY ALL))""")
def e1(spark, sf):
    return rounded(M.confusion(views.scores(spark, sf), 0.5, GROUP))


@query("e2_dice_masked", """
SELECT run_id, fold, tp, fp, fn, round(2.0*tp/(2.0*tp+fp+fn+1e-12), 9) AS dice FROM (
 SELECT run_id, fold, count(*) FILTER (WHERE prob >= 0.5 AND label >= 0.5) AS tp,
  count(*) FILTER (WHERE prob >= 0.5 AND label < 0.5) AS fp, count(*) FILTER (WHERE prob < 0.5 AND label >= 0.5) AS fn
 FROM (SELECT run_id, fold, prob, label, l_partkey % 3 > 0 AS m FROM V_SCORES) GROUP BY ALL)
""".replace("FILTER (WHERE ", "FILTER (WHERE m AND "))
def e2(spark, sf):
    return rounded(M.dice(views.scores(spark, sf).withColumn("m", F.expr("l_partkey % 3 > 0")), 0.5, ["run_id", "fold"], "m"))


@query("e3_average_precision", f"WITH {ap_ctes()} SELECT run_id, fold, seed, positives, round(average_precision, 9) AS average_precision FROM ap")
def e3(spark, sf):
    return rounded(M.average_precision(views.scores(spark, sf), GROUP, ORDER))


@query("e3_average_precision_global", f"""
WITH one AS (SELECT *, 'all' AS scope FROM V_SCORES), {ap_ctes('one', 'scope')}
SELECT scope, positives, round(average_precision, 9) AS average_precision FROM ap""")
def e3_global(spark, sf):
    return rounded(M.average_precision(views.scores(spark, sf), [], ORDER))


@query("e4_calibration_error", f"WITH {ece_ctes()} SELECT run_id, fold, seed, round(expected_calibration_error, 9) AS expected_calibration_error FROM ece")
def e4(spark, sf):
    return rounded(M.calibration_error(views.scores(spark, sf), GROUP))


@query("e5_brier_log_loss", f"SELECT run_id, fold, seed, {rnd('brier_score, log_loss')} FROM (SELECT run_id, fold, seed, {LOSS_SQL} FROM V_SCORES GROUP BY ALL)")
def e5(spark, sf):
    return rounded(M.brier_log_loss(views.scores(spark, sf), GROUP))


@query("e6_ap_lift", f"""WITH {ap_ctes()}, rate AS (SELECT run_id, fold, seed, avg(CASE WHEN label > 0.5 THEN 1.0 ELSE 0.0 END) AS r FROM V_SCORES GROUP BY ALL)
SELECT run_id, fold, seed, positives, round(average_precision, 9) AS average_precision, round(r, 9) AS val_positive_rate,
 round(average_precision/greatest(r, 1e-12), 9) AS ap_prevalence_lift FROM ap JOIN rate USING (run_id, fold, seed)""")
def e6(spark, sf):
    return rounded(M.ranked_lift(views.scores(spark, sf), GROUP, ORDER))


@query("e7_score_stats", """SELECT fold, round(min(prob), 9) AS prob_min, round(avg(prob), 9) AS prob_mean,
 round(quantile_cont(prob, 0.95), 9) AS prob_p95, round(max(prob), 9) AS prob_max FROM V_SCORES GROUP BY fold""")
def e7(spark, sf):
    return rounded(M.score_stats(views.scores(spark, sf), ["fold"]))


@query("e8_threshold_grid", f"WITH {sweep_ctes()} SELECT run_id, fold, seed, round(threshold, 9) AS threshold FROM grid")
def e8(spark, sf):
    return rounded(M.threshold_grid(views.scores(spark, sf), GROUP))


@query("e8_approximate_grid", """SELECT run_id, fold, seed, count(*) AS n, true AS in_bound FROM V_SCORES GROUP BY ALL""")
def e8_approximate(spark, sf):
    """Whether every score quantile of the approximate grid has a rank within the stated bound."""
    s, by, accuracy = views.scores(spark, sf), ["run_id", "fold", "seed"], 50
    grid = M.approximate_grid(s, by, 0.5, accuracy).groupBy(*by).agg(F.sort_array(F.collect_list("threshold")).alias("grid"))
    scores = s.groupBy(*by).agg(F.sort_array(F.collect_list("prob")).alias("p"))
    rows = scores.join(grid, by).withColumn("n", F.size("p").cast("long"))

    def near(q: float):
        """Some threshold has a rank within n / accuracy of q n."""
        slack = F.col("n") / accuracy + 1
        below = lambda t: F.size(F.filter("p", lambda v: v < t))
        upto = lambda t: F.size(F.filter("p", lambda v: v <= t))
        return F.exists("grid", lambda t: (below(t) <= q * F.col("n") + slack) & (upto(t) >= q * F.col("n") - slack))

    checked = F.lit(True)
    for q in QUANTILES[::16]:
        checked = checked & near(q)
    return rows.select(*by, "n", checked.alias("in_bound"))


@query("e9_threshold_sweep", f"WITH {sweep_ctes()} SELECT run_id, fold, seed, {rnd('threshold, val_positive_rate,' + _SWEEP_COLS)} FROM sweep")
def e9(spark, sf):
    return rounded(M.threshold_sweep(views.scores(spark, sf), GROUP))


@query("e9_sweep_given_grid", f"""
WITH g AS (SELECT DISTINCT l_linenumber AS fold, l_discount*8.0 AS threshold FROM lineitem),
c AS (SELECT g.fold, g.threshold, CAST(count(*) FILTER (WHERE prob >= threshold AND label > 0.5) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE prob >= threshold AND label <= 0.5) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE prob < threshold AND label > 0.5) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS n,
  count(*) FILTER (WHERE label > 0.5) AS p FROM g JOIN V_SCORES s USING (fold) GROUP BY ALL)
SELECT fold, {rnd('threshold, val_positive_rate,' + _SWEEP_COLS)} FROM (SELECT *, p/n AS val_positive_rate, {metric_sql('tp', 'fp', 'fn', 'n')} FROM c)""")
def e9_given(spark, sf):
    grid = views.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("fold"), (F.col("l_discount") * 8.0).alias("threshold")).distinct()
    return rounded(M.threshold_sweep(views.scores(spark, sf), ["fold"], grid))


_SEL_OUT = "threshold AS best_threshold, f1 AS val_f1, val_f05, precision, recall, pred_positive_rate, val_positive_rate"
_SEL_SQL = ", ".join(f"round({c.split(' AS ')[0].strip()}, 9) AS {c.split(' AS ')[-1].strip()}" for c in _SEL_OUT.split(", "))


@query("e10_operating_point", f"WITH {sweep_ctes()}, {selection_ctes()} SELECT run_id, fold, seed, threshold_selection, {_SEL_SQL} FROM selected")
def e10(spark, sf):
    rows = M.sweep_steps(views.scores(spark, sf), GROUP)
    return rounded(M.selected_columns(M.select_threshold(rows, GROUP, CAP), GROUP))


@query("e11_fixed_status", f"""WITH {sweep_ctes()}, {selection_ctes()}, {status_ctes()}
SELECT run_id, fold, seed, {rnd('fixed_threshold_f1, val_f1')}, fixed_threshold_status, fixed_threshold_failure_reason FROM status""")
def e11(spark, sf):
    return rounded(M.fixed_status(views.scores(spark, sf), GROUP, CAP))


@query("e12_threshold_risk", f"""WITH {sweep_ctes()}, {selection_ctes()},
caps AS (SELECT unnest([2.0, 2.5, 3.0, 3.5]::DOUBLE[]) AS cap),
el AS (SELECT s.*, cap, row_number() OVER (PARTITION BY run_id, fold, seed, cap ORDER BY f1 DESC, precision DESC, pred_positive_rate, threshold) AS rn,
   count(*) OVER (PARTITION BY run_id, fold, seed, cap) AS cnt
  FROM sweep s, caps WHERE pred_positive_rate/greatest(val_positive_rate, 1e-12) <= cap),
un AS (SELECT *, row_number() OVER (PARTITION BY run_id, fold, seed ORDER BY f1 DESC, precision DESC, pred_positive_rate, threshold) AS rn FROM sweep)
SELECT sel.run_id, sel.fold, sel.seed, caps.cap, caps.cap = 2.5 AS configured, coalesce(cnt, 0) AS eligible_threshold_count,
 round(el.threshold, 9) AS best_threshold, round(el.f1, 9) AS best_f1, round(el.f05, 9) AS best_f05, round(el.pred_positive_rate, 9) AS best_pred_positive_rate,
 round(el.f1/greatest(sel.f1, 1e-12), 9) AS f1_retained_vs_selected, round(el.f05/greatest(sel.f05, 1e-12), 9) AS f05_retained_vs_selected,
 round(el.f1/greatest(un.f1, 1e-12), 9) AS f1_retained_vs_unconstrained, round(el.f05/greatest(un.f05, 1e-12), 9) AS f05_retained_vs_unconstrained,
 round(sel.pred_positive_rate/greatest(sel.val_positive_rate, 1e-12), 9) AS selected_pred_to_val_ratio,
 len(list_filter([2.0, 2.5, 3.0, 3.5]::DOUBLE[], lambda c: abs(sel.pred_positive_rate/greatest(sel.val_positive_rate, 1e-12) - c) <= 0.15)) > 0 AS cap_binding
FROM selected sel CROSS JOIN caps JOIN un ON un.run_id = sel.run_id AND un.fold = sel.fold AND un.seed = sel.seed AND un.rn = 1
LEFT JOIN el ON el.run_id = sel.run_id AND el.fold = sel.fold AND el.seed = sel.seed AND el.cap = caps.cap AND el.rn = 1""")
def e12(spark, sf):
    rows = M.sweep_steps(views.scores(spark, sf), GROUP)
    return rounded(M.threshold_risk(rows, M.select_threshold(rows, GROUP, CAP), GROUP, CAP))


def evaluate_sql(view: str, by: str, order: str) -> str:
    prefix = f"one AS (SELECT * FROM {view}),"
    return f"""WITH {prefix} {sweep_ctes('one', by)}, {selection_ctes(by)}, {status_ctes(by)}, {ap_ctes('one', by, order)}, {ece_ctes('one', by)},
stats AS (SELECT {by}, count(*) AS pixels, min(prob) AS prob_min, avg(prob) AS prob_mean, max(prob) AS prob_max,
   quantile_cont(prob, 0.95) AS prob_p95, {LOSS_SQL} FROM one GROUP BY {by})
SELECT {by}, pixels, threshold_selection, fixed_threshold_status, fixed_threshold_failure_reason, {_SEL_SQL.replace('round(val_f1', 'round(sel.f1')},
 {rnd('fixed_threshold_f1, fixed_threshold_precision, fixed_threshold_recall, average_precision, expected_calibration_error, prob_min, prob_mean, prob_max, prob_p95, brier_score, log_loss')},
 round(average_precision/greatest(val_positive_rate, 1e-12), 9) AS ap_prevalence_lift
FROM selected JOIN (SELECT * EXCLUDE (val_f1) FROM status) st USING ({by}) JOIN ap USING ({by}) JOIN ece USING ({by}) JOIN stats USING ({by})"""


@query("e13_evaluate_runs", evaluate_sql("V_SCORES", "run_id, fold, seed", "l_orderkey, fold, l_partkey, run_id"))
def e13(spark, sf):
    return rounded(M.evaluate(views.scores(spark, sf), GROUP, ORDER, CAP))


@query("e13_evaluate_maps", evaluate_sql("V_MAP", "map_id", "y, x"))
def e13_maps(spark, sf):
    return rounded(M.evaluate(views.maps(spark, sf), ["map_id"], ["y", "x"], CAP))


@query("e13_evaluate_docs", evaluate_sql("V_DOCS", "fold", "doc_id"))
def e13_docs(spark, sf):
    return rounded(M.evaluate(views.docs(spark, sf), ["fold"], ["doc_id"], CAP))


@query("e14_metric_discrepancy", """
SELECT run_id, fold, seed, round(f1, 9) AS f1, round(dice, 9) AS dice, abs(f1-dice) > 0.005 AS flagged FROM (
 SELECT *, 2.0*p*r/greatest(p+r, 1e-9) AS f1, 2.0*tp/(2.0*tp+fp+fn+1e-12) AS dice FROM (
  SELECT *, tp/greatest(tp+fp, 1.0) AS p, tp/greatest(tp+fn, 1.0) AS r FROM (
   SELECT run_id, fold, seed, count(*) FILTER (WHERE prob >= 0.5 AND label > 0.5)::DOUBLE AS tp,
    count(*) FILTER (WHERE prob >= 0.5 AND label <= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE prob < 0.5 AND label > 0.5)::DOUBLE AS fn
   FROM V_SCORES GROUP BY ALL)))""")
def e14(spark, sf):
    return rounded(M.metric_discrepancy(views.scores(spark, sf), 0.5, GROUP))


@query("e15_loss_metrics", """
WITH c AS (SELECT map_id, label::DOUBLE AS y, least(greatest(prob, 1e-12), 1.0-1e-12) AS p FROM V_MAP),
d AS (SELECT *, -(y*ln(p)+(1.0-y)*ln(1.0-p)) AS bce, CASE WHEN y > 0.5 THEN p ELSE 1.0-p END AS pt FROM c),
s AS (SELECT map_id, count(*) AS n, sum(p*y) AS tp, sum(p) AS sp, sum(y) AS sy, sum(p*(1.0-y)) AS fp, sum((1.0-p)*y) AS fn,
 sum(bce) AS bce, sum(CASE WHEN y > 0.5 THEN 0.25 ELSE 0.75 END*pow(1.0-pt, 2)*bce) AS focal FROM d GROUP BY map_id),
t AS (SELECT map_id % 10 AS scope, *, 1.0-(2.0*tp+1.0)/(sp+sy+1.0) AS sd, 1.0-(tp+1.0)/(tp+0.3*fp+0.7*fn+1.0) AS tv FROM s)
SELECT scope, round(avg(sd), 6) AS soft_dice_loss, round(sum(bce)/sum(n), 6) AS bce_loss, round(sum(focal)/sum(n), 6) AS focal_loss,
 round(0.5*sum(bce)/sum(n)+0.5*avg(sd), 6) AS combo_loss, round(avg(tv), 6) AS tversky_loss,
 round(pow(greatest(0.0, abs(sum(sp)/sum(n)-0.1)), 2), 6) AS rate_excess_loss FROM t GROUP BY scope""")
def e15(spark, sf):
    m = views.maps(spark, sf).withColumn("scope", F.expr("map_id % 10"))
    return rounded(M.loss_metrics(m, ["map_id"], ["scope"]), 6)


@query("d7_positive_weight", """
SELECT run_id, fold, round(least(sqrt(greatest(count(*) FILTER (WHERE label <= 0.5), 1)::DOUBLE/greatest(count(*) FILTER (WHERE label > 0.5), 1)), 10.0), 9) AS pos_weight
FROM V_SCORES GROUP BY ALL""")
def d7(spark, sf):
    return rounded(M.positive_weight(views.scores(spark, sf), ["run_id", "fold"]))
