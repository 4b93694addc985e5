"""Map-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgate import views
from evalgate.functions.tables import QUALITY_ACTIONS
from evalgate.operators import components as K
from evalgate.operators import quality as Q
from evalgate.plans.metric_queries import rnd
from evalgate.plans.registry import query, rounded

STATS_CTE = """
pm AS (SELECT map_id, y, x, prob AS p, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS m FROM V_MAP),
nb AS (SELECT a.map_id, a.y, a.x, a.p, a.m, coalesce(sum(b.m), 0) AS nb FROM pm a LEFT JOIN pm b ON a.map_id = b.map_id AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 AND NOT (a.y=b.y AND a.x=b.x) GROUP BY ALL),
av AS (SELECT map_id, avg(p) AS mean, var_pop(p) AS var, stddev_pop(p) AS std, avg(m) AS positive_rate, sum(m) AS positives, quantile_cont(p, 0.01) AS q01, quantile_cont(p, 0.05) AS q05,
  quantile_cont(p, 0.95) AS q95, quantile_cont(p, 0.99) AS q99 FROM pm GROUP BY 1),
eg AS (SELECT a.map_id, 'v' AS axis, a.p AS p, b.p AS p2, a.m <> b.m AS t FROM pm a JOIN pm b ON a.map_id = b.map_id AND b.y = a.y+1 AND b.x = a.x
       UNION ALL SELECT a.map_id, 'h', a.p, b.p, a.m <> b.m FROM pm a JOIN pm b ON a.map_id = b.map_id AND b.y = a.y AND b.x = a.x+1),
ec AS (SELECT e.map_id, axis, avg((p-mean)*(p2-mean)) AS cov FROM eg e JOIN av USING (map_id) GROUP BY ALL),
es AS (SELECT map_id, avg(abs(p2-p)) AS diff, avg(CASE WHEN t THEN 1.0 ELSE 0.0 END) AS td FROM eg GROUP BY 1),
sp AS (SELECT map_id, count(*) FILTER (WHERE m = 1 AND nb >= 2) AS sup, count(*) FILTER (WHERE m = 1 AND nb = 0) AS iso FROM nb GROUP BY 1),
st AS (SELECT map_id, 1.0 AS finite_fraction, positive_rate, q99-q01 AS dynamic_range, q95-q05 AS robust_spread, std, diff AS mean_abs_neighbor_diff, diff/greatest(q99-q01, 1e-6) AS noise_index,
  CASE WHEN var > 1e-12 THEN c.cov/var ELSE 1.0 END AS neighbor_autocorr, CASE WHEN positives > 0 THEN sup/positives ELSE 0 END AS supported_positive_rate,
  CASE WHEN positives > 0 THEN iso/positives ELSE 0 END AS isolated_positive_rate, td AS transition_density, positives
  FROM av JOIN es USING (map_id) JOIN sp USING (map_id) JOIN (SELECT map_id, avg(cov) AS cov FROM ec GROUP BY 1) c USING (map_id))"""
STATS = ("finite_fraction, positive_rate, dynamic_range, robust_spread, std, mean_abs_neighbor_diff, noise_index, neighbor_autocorr, "
         "supported_positive_rate, isolated_positive_rate, transition_density")


@query("f1_map_stats", f"WITH {STATS_CTE} SELECT map_id, positives, {rnd(STATS)} FROM st")
def f1(spark, sf):
    return rounded(Q.map_stats(views.maps(spark, sf), 0.5, ["map_id"]))


COMPONENT_CTE = """
pos AS (SELECT map_id, y, x, y*1000+x AS id FROM V_MAP WHERE prob >= 0.5),
ed AS (SELECT a.map_id, a.id AS s, b.id AS d FROM pos a JOIN pos b ON a.map_id = b.map_id AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1),
reach(map_id, s, d) AS (SELECT map_id, s, d FROM ed UNION SELECT r.map_id, r.s, e.d FROM reach r JOIN ed e ON r.map_id = e.map_id AND r.d = e.s),
root AS (SELECT map_id, s, min(d) AS root FROM reach GROUP BY ALL),
sz AS (SELECT map_id, root, count(*) AS size FROM root GROUP BY ALL),
cs AS (SELECT map_id, count(*) AS component_count, max(size)/sum(size) AS lf, coalesce(sum(size) FILTER (WHERE size <= 4), 0)/sum(size) AS sf FROM sz GROUP BY 1)"""


@query("f2_components", f"""WITH RECURSIVE {COMPONENT_CTE} SELECT m.map_id, coalesce(component_count, 0) AS component_count, round(coalesce(lf, 0), 9) AS largest_component_fraction,
 round(coalesce(sf, 0), 9) AS small_component_fraction FROM (SELECT DISTINCT map_id FROM V_MAP) m LEFT JOIN cs USING (map_id)""")
def f2(spark, sf):
    return rounded(K.components(views.maps(spark, sf), ["map_id"], 0.5, tile=4))


VERDICT_CTE = """
sc AS (SELECT *, CASE WHEN positive_rate < 0.001 THEN 0.0 WHEN positive_rate < 0.005 THEN 0.25 WHEN positive_rate <= 0.5 THEN 1.0 WHEN positive_rate >= 0.75 THEN 0.0
   ELSE least(greatest((0.75-positive_rate)/0.25, 0.0), 1.0) END AS s1, least(greatest((dynamic_range-0.05)/0.25, 0.0), 1.0) AS s2,
   least(greatest((supported_positive_rate-0.25)/0.5, 0.0), 1.0)*(1.0-least(greatest((transition_density-0.15)/0.35, 0.0), 1.0)) AS s3,
   least(greatest(neighbor_autocorr/0.5, 0.0), 1.0)*(1.0-least(greatest((noise_index-0.25)/0.5, 0.0), 1.0)) AS s4 FROM st),
fg AS (SELECT *, 0.25*s1+0.25*s2+0.3*s3+0.2*s4 AS score, list_filter([CASE WHEN positive_rate < 0.001 THEN 'blank_or_no_positive_mask' END, CASE WHEN positive_rate >= 0.75 THEN 'flooding' END,
   CASE WHEN positive_rate >= 0.6 AND positive_rate < 0.75 THEN 'possible_flooding' END, CASE WHEN dynamic_range < 0.05 OR std < 0.015 THEN 'flat_probabilities' END,
   CASE WHEN positives > 0 AND supported_positive_rate < 0.25 THEN 'speckle_or_isolated_positives' END, CASE WHEN positives > 0 AND isolated_positive_rate > 0.3 THEN 'many_isolated_positives' END,
   CASE WHEN transition_density > 0.4 THEN 'fragmented_threshold_mask' END, CASE WHEN neighbor_autocorr < 0.05 AND transition_density > 0.3 THEN 'unstructured_noise' END,
   CASE WHEN noise_index > 0.5 AND neighbor_autocorr < 0.2 THEN 'high_frequency_noise' END], lambda f: f IS NOT NULL) AS flags FROM sc)"""


@query("f3_map_verdict", f"""WITH {STATS_CTE}, {VERDICT_CTE} SELECT map_id, round(score, 9) AS score, list_aggregate(flags, 'string_agg', ',') AS flags,
 CASE WHEN list_has_any(flags, ['blank_or_no_positive_mask', 'flooding', 'flat_probabilities', 'speckle_or_isolated_positives', 'many_isolated_positives', 'unstructured_noise', 'high_frequency_noise'])
  OR score < 0.45 THEN 'fail' WHEN score < 0.7 OR len(flags) > 0 THEN 'review' ELSE 'pass' END AS verdict FROM fg""")
def f3(spark, sf):
    v = Q.map_verdict(Q.map_stats(views.maps(spark, sf), 0.5, ["map_id"]))
    return rounded(v.select("map_id", "score", F.nullif(F.array_join("flags", ","), F.lit("")).alias("flags"), "verdict"))


METRIC_VERDICT_CTE = """
mv0 AS (SELECT *, CASE WHEN val_positive_rate > 1e-12 THEN average_precision/val_positive_rate END AS lift, CASE WHEN val_positive_rate > 1e-12 THEN pred_positive_rate/val_positive_rate END AS ratio,
  CASE WHEN run_id % 5 > 0 THEN val_f05 END AS fx FROM V_RUNS),
mv1 AS (SELECT *, coalesce(least(0.35, val_f1), 0.0)+coalesce(least(0.25, greatest(0.0, (lift-1.0)*0.15)), 0.0)+CASE WHEN ratio BETWEEN 0.5 AND 2.0 THEN 0.25 WHEN ratio BETWEEN 0.25 AND 3.0 THEN 0.12 ELSE 0.0 END
   +CASE WHEN fx >= 0.5*val_f1 THEN 0.15 ELSE 0.0 END AS quality_score,
  list_filter([CASE WHEN ratio < 0.25 OR ratio > 3.0 THEN 'positive_rate_ratio_suspicious' END, CASE WHEN fx < 0.5*val_f1 THEN 'fixed_threshold_weak' END,
   CASE WHEN ratio BETWEEN 0.25 AND 3.0 AND NOT ratio BETWEEN 0.5 AND 2.0 THEN 'positive_rate_ratio_review' END, CASE WHEN lift < 1.25 THEN 'weak_ap_lift' END,
   CASE WHEN val_f1 < 0.12 THEN 'weak_full_tile_f1' END], lambda r: r IS NOT NULL) AS reasons FROM mv0),
mv AS (SELECT *, CASE WHEN len(reasons) = 0 AND quality_score >= 0.7 THEN 'pass' WHEN quality_score >= 0.45 AND NOT list_contains(reasons, 'positive_rate_ratio_suspicious') THEN 'review' ELSE 'fail' END AS verdict FROM mv1)"""


def run_verdicts(spark, sf):
    r = views.runs(spark, sf).withColumn("fixed_threshold_f1", F.expr("CASE WHEN run_id % 5 > 0 THEN val_f05 END"))
    return Q.metrics_verdict(r)


@query("f4_metrics_verdict", f"WITH {METRIC_VERDICT_CTE} SELECT run_id, round(quality_score, 9) AS quality_score, verdict, coalesce(list_aggregate(reasons, 'string_agg', ','), '') AS reasons FROM mv")
def f4(spark, sf):
    return rounded(run_verdicts(spark, sf).select("run_id", "quality_score", "verdict", F.array_join("reasons", ",").alias("reasons")))


_ACT = "(VALUES " + ", ".join(f"('{k}', '{a}', '{s}')" for k, (a, s) in QUALITY_ACTIONS.items()) + ") t(reason, action, severity)"
ACTION_CTE = f"""
qa AS (SELECT run_id, verdict, i-1 AS reason_ordinal, rs[i] AS reason FROM (SELECT run_id, verdict, rs, unnest(range(1, len(rs)+1)) AS i FROM (SELECT run_id, verdict,
   CASE WHEN len(reasons) > 0 THEN reasons ELSE [CASE WHEN verdict = 'review' THEN 'quality_review' ELSE 'quality_failed' END] END AS rs FROM mv WHERE verdict <> 'pass'))),
qact AS (SELECT qa.*, coalesce(t.action, 'quality_review') AS action, CASE WHEN verdict = 'fail' THEN 'blocker' ELSE coalesce(t.severity, 'warning') END AS severity FROM qa LEFT JOIN {_ACT} USING (reason))"""


@query("f5_quality_actions", f"WITH {METRIC_VERDICT_CTE}, {ACTION_CTE} SELECT run_id, verdict, reason_ordinal, reason, action, severity FROM qact")
def f5(spark, sf):
    return Q.quality_actions(run_verdicts(spark, sf)).select("run_id", "verdict", "reason_ordinal", "reason", "action", "severity")


BLOCK_CTE = """
bd AS (SELECT segment, 'row' AS axis, y AS line, avg(d) AS d FROM (SELECT segment, y, abs(prob-lag(prob) OVER (PARTITION BY segment, x ORDER BY y)) AS d FROM V_BIGMAP) WHERE d IS NOT NULL GROUP BY ALL
  UNION ALL SELECT segment, 'col', x, avg(d) FROM (SELECT segment, x, abs(prob-lag(prob) OVER (PARTITION BY segment, y ORDER BY x)) AS d FROM V_BIGMAP) WHERE d IS NOT NULL GROUP BY ALL),
bs AS (SELECT segment, max(y)+1 AS h, max(x)+1 AS w, quantile_cont(prob, 0.99)-quantile_cont(prob, 0.01) AS dyn FROM V_BIGMAP GROUP BY 1),
br AS (SELECT segment, block, axis, avg(d) FILTER (WHERE line % block = 0)/greatest(avg(d) FILTER (WHERE line % block <> 0), 1e-6) AS ratio FROM bd JOIN bs USING (segment), (SELECT unnest([2, 4, 8, 16]) AS block)
  WHERE CASE axis WHEN 'row' THEN h ELSE w END > block*2 GROUP BY ALL),
bb AS (SELECT segment, ratio, block, row_number() OVER (PARTITION BY segment ORDER BY ratio DESC, block) AS rn FROM br WHERE ratio IS NOT NULL),
blk AS (SELECT bs.segment, CASE WHEN h < 16 OR w < 16 OR dyn < 0.05 THEN 0.0 ELSE ratio END AS idx, CASE WHEN h < 16 OR w < 16 OR dyn < 0.05 THEN NULL ELSE block END AS block FROM bs LEFT JOIN (SELECT * FROM bb WHERE rn = 1) b USING (segment))"""


@query("f6_blockiness", f"WITH {BLOCK_CTE} SELECT segment, round(idx, 9) AS blockiness_index, idx >= 8 AS blockiness_suspect, block AS block_size FROM blk")
def f6(spark, sf):
    return rounded(Q.blockiness(views.bigmap(spark, sf), ["segment"]))


DOWN_CTE = """
dsz AS (SELECT segment, max(y)+1 AS h, max(x)+1 AS w FROM V_BIGMAP GROUP BY 1),
dso AS (SELECT *, greatest(1, CAST(round_even(h/greatest(h/20.0, w/20.0, 1.0), 0) AS INT)) AS oh, greatest(1, CAST(round_even(w/greatest(h/20.0, w/20.0, 1.0), 0) AS INT)) AS ow FROM dsz),
ey AS (SELECT segment, i AS by, floor(i*h/oh) AS y0, greatest(floor((i+1)*h/oh), floor(i*h/oh)+1) AS y1 FROM (SELECT *, unnest(range(oh)) AS i FROM dso)),
ex AS (SELECT segment, i AS bx, floor(i*w/ow) AS x0, greatest(floor((i+1)*w/ow), floor(i*w/ow)+1) AS x1 FROM (SELECT *, unnest(range(ow)) AS i FROM dso)),
dn AS (SELECT b.segment, ey.by, ex.bx, avg(prob) AS prob, avg(CASE WHEN prob >= 0.55 THEN 1.0 ELSE 0.0 END) AS mk FROM V_BIGMAP b JOIN ey ON ey.segment = b.segment AND b.y >= y0 AND b.y < y1
  JOIN ex ON ex.segment = b.segment AND b.x >= x0 AND b.x < x1 GROUP BY ALL)"""


@query("c13_downsample", f"""WITH {DOWN_CTE} SELECT segment, "by" AS y, bx AS x, round(prob, 9) AS prob FROM dn""")
def c13(spark, sf):
    return rounded(Q.downsample(views.bigmap(spark, sf), ["segment"], 20))


@query("f7_map_summary", f"""WITH {BLOCK_CTE}, {DOWN_CTE}, a AS (SELECT segment, max(y)+1 AS height, max(x)+1 AS width, min(prob) AS prob_min, avg(prob) AS prob_mean, max(prob) AS prob_max, 0.55 AS threshold,
  avg(CASE WHEN prob >= 0.55 THEN 1.0 ELSE 0.0 END) AS pred_positive_rate, quantile_cont(prob, 0.95) AS prob_p95 FROM V_BIGMAP GROUP BY 1), m AS (SELECT segment, avg(mk) AS mask_preview_mean FROM dn GROUP BY 1)
SELECT segment, height, width, threshold, {rnd('prob_min, prob_mean, prob_max, pred_positive_rate, prob_p95, mask_preview_mean')}, round(idx, 9) AS blockiness_index, idx >= 8 AS blockiness_suspect, block AS block_size,
 concat_ws('|', CASE WHEN height > 20 OR width > 20 THEN 'preview_downsampled_area_mean_not_full_resolution' END, CASE WHEN idx >= 8 THEN 'possible_blocky_or_nearest_neighbor_probability_map' END) AS preview_warnings
FROM a JOIN m USING (segment) JOIN blk USING (segment)""")
def f7(spark, sf):
    big = views.bigmap(spark, sf)
    metrics = big.select("segment").distinct().withColumn("best_threshold", F.lit(0.55))
    out = Q.map_summary(big, metrics, ["segment"], 20)
    return rounded(out.withColumn("preview_warnings", F.array_join("preview_warnings", "|")))
