"""Comparison of summaries, runs, maps and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.functions.columns import fixed_text, floored_ratio, null_safe_join, reasons, safe_ratio, steady_mean

# Names of compared metrics and warnings, and the direction that is better.
SUMMARY_METRICS = [
    "folds_successful", "folds_failed", "mean_val_f1", "median_over_seeds_median_val_f1", "mean_average_precision",
    "median_average_precision", "worst_fold_val_f1", "worst_seed_median_val_f1",
    "mean_recomputed_pred_to_val_ratio", "max_recomputed_pred_to_val_ratio",
]
MAP_METRICS = [
    "val_f1", "val_f05", "average_precision", "ap_prevalence_lift", "precision", "recall", "val_positive_rate",
    "pred_positive_rate", "pred_to_val_ratio", "best_threshold", "fixed_threshold_f1", "brier_score",
    "expected_calibration_error", "prob_mean", "prob_p95", "prob_max", "selected_threshold", "selected_precision",
    "selected_recall", "selected_f05", "selected_f1", "selected_pred_positive_rate", "selected_pred_to_val_ratio",
]
SUMMARY_WARNINGS = [
    "positive_rate_alarm_count", "zero_precision_or_recall_count", "fixed_threshold_not_ok_count", "threshold_edge_case_count",
    "weak_ap_prevalence_lift_count", "warning_count",
]
LOWER_IS_BETTER = ["brier_score", "expected_calibration_error", "pred_to_val_ratio", "selected_pred_to_val_ratio"]
HIGHER_IS_BETTER = ["val_f1", "val_f05", "average_precision", "ap_prevalence_lift", "fixed_threshold_f1", "selected_f1", "selected_f05"]


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str], value: str) -> DataFrame:
    """One row per (keys, metric); metrics the table lacks are left out."""
    have = [m for m in metrics if m in df.columns]
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in have]).unpivot(keys, have, "metric", value)


def compare_loo(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate minus baseline for each summary metric both sides have."""
    c = long_metrics(candidate, keys, SUMMARY_METRICS, "candidate")
    b = long_metrics(baseline, keys, SUMMARY_METRICS, "baseline")
    return c.join(b, [*keys, "metric"]).withColumn("delta", F.col("candidate") - F.col("baseline"))


def compare_warnings(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of each kind of warning on both sides; a side without the group counts none."""
    c = candidate.select(*keys, F.stack(F.lit(len(SUMMARY_WARNINGS)), *[x for w in SUMMARY_WARNINGS for x in (F.lit(w), F.col(w).cast("long"))]).alias("warning", "candidate"))
    b = baseline.select(*keys, F.stack(F.lit(len(SUMMARY_WARNINGS)), *[x for w in SUMMARY_WARNINGS for x in (F.lit(w), F.col(w).cast("long"))]).alias("warning", "baseline"))
    j = null_safe_join_full(c, b, [*keys, "warning"])
    counts = {n: F.coalesce(n, F.lit(0)) for n in ("candidate", "baseline")}
    return j.withColumns(counts).withColumn("delta", F.col("candidate") - F.col("baseline"))


def null_safe_join_full(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join where NULL keys match each other and the keys appear once, from either side."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return left.join(renamed, cond, "full").select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in keys], *rest)


def worst_fold_change(candidate: DataFrame, baseline: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """The fold with the lowest value on either side and whether it is the same one; of equal values the first fold."""

    def worst(df: DataFrame, name: str) -> DataFrame:
        low = F.min_by(F.struct(F.col(item).alias("id"), F.col(value).alias("value")), F.struct(value, item))
        return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(low.alias("w")).select(*keys, F.col("w.id").alias(f"{name}_worst_fold_id"), F.col("w.value").alias(f"{name}_worst_value"))

    j = candidate.transform(worst, "candidate").join(baseline.transform(worst, "baseline"), keys)
    return j.withColumn("same_fold", F.col("candidate_worst_fold_id") == F.col("baseline_worst_fold_id"))


def fold_deltas(candidate: DataFrame, baseline: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    c = candidate.select(*keys, item, F.col(value).alias("candidate"))
    b = baseline.select(*keys, item, F.col(value).alias("baseline"))
    return c.join(b, [*keys, item]).withColumn("delta", F.col("candidate") - F.col("baseline"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test; binomial terms are summed in log space."""
    n = (wins + losses).cast("int")
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(0), F.least(wins, losses).cast("int")),
        start,
        lambda acc, k: F.struct(
            (acc["t"] + F.when(k < n, F.ln((n - k) / (k + 1))).otherwise(0.0)).alias("t"),
            (acc["s"] + F.exp(acc["t"])).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * tail))


def paired_compare(candidate: DataFrame, baseline: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Paired deltas on common items with counts of unmatched ones and the sign test."""
    c = candidate.select(*keys, item, F.col(value).alias("_c"), F.lit(True).alias("_in_c"))
    b = baseline.select(*keys, item, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = c.join(b, [*keys, item], "full").withColumn("_d", F.col("_c") - F.col("_b"))
    agg = both.groupBy(*keys).agg(
        F.count("_d").alias("paired_count"),
        F.count_if(F.col("_in_c").isNotNull() & F.col("_in_b").isNotNull()).alias("common"),
        F.count_if(F.col("_in_b").isNull()).alias("candidate_only"),
        F.count_if(F.col("_in_c").isNull()).alias("baseline_only"),
        steady_mean(F.col("_d")).alias("mean_delta"), F.median("_d").alias("median_delta"),
        F.min("_d").alias("min_delta"), F.max("_d").alias("max_delta"),
        F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") < 0).alias("losses"),
        F.count_if(F.col("_d") == 0).alias("ties"),
    )
    return agg.withColumn("sign_test_two_sided_p", sign_test(F.col("wins"), F.col("losses")))


def paired_values(fold_rows: DataFrame, seed_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, item, value) of the three pairings: F1 and AP by fold, median F1 by seed."""
    fold = F.col("heldout_segment").cast("string").alias("item")
    by_fold = [fold_rows.select(*keys, F.lit(f"per_fold_{m}").alias("metric"), fold, F.col(m).cast("double").alias("value")) for m in ("val_f1", "average_precision")]
    by_seed = seed_rows.select(*keys, F.lit("per_seed_median_val_f1").alias("metric"), F.col("seed").cast("string").alias("item"), F.col("median_val_f1").cast("double").alias("value"))
    return by_fold[0].unionByName(by_fold[1]).unionByName(by_seed)


def paired_items(candidate: DataFrame, baseline: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """A row per item of a comparison: on which side it is, and the delta where both have a value."""
    c = candidate.select(*keys, item, F.col(value).alias("candidate"), F.lit(True).alias("_c"))
    b = baseline.select(*keys, item, F.col(value).alias("baseline"), F.lit(True).alias("_b"))
    j = null_safe_join_full(c, b, [*keys, item])
    side = F.when(F.col("_b").isNull(), "candidate_only").when(F.col("_c").isNull(), "baseline_only").otherwise("common")
    return j.select(*keys, item, side.alias("side"), "candidate", "baseline", (F.col("candidate") - F.col("baseline")).alias("delta"))


def loo_gates(summary: DataFrame, keys: list[str], min_median: float | None = None, min_ap: float | None = None,
              min_worst: float | None = None, max_fixed_bad: int | None = None) -> DataFrame:
    """Gate rows (ordinal, label, passed, detail) per summary."""

    def gate(ordinal: int, label: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(label).alias("gate"),
                        F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))

    def count(col: str) -> Column:
        return F.concat(F.lit("count="), F.col(col).cast("string"))

    def floor(ordinal: int, label: str, col: str, limit: float) -> Column:
        value = F.coalesce(fixed_text(F.col(col)), F.lit("None"))
        return gate(ordinal, label, F.col(col) >= limit, F.concat(F.lit("value="), value, F.lit(f", floor={limit}")))

    gates = [
        gate(0, "all folds succeeded", F.col("folds_failed") == 0, F.concat(F.lit("folds_failed="), F.col("folds_failed").cast("string"))),
        gate(1, "no positive-rate alarms", F.col("positive_rate_alarm_count") == 0, count("positive_rate_alarm_count")),
        gate(2, "no zero precision/recall alarms", F.col("zero_precision_or_recall_count") == 0, count("zero_precision_or_recall_count")),
    ]
    if min_median is not None:
        gates.append(floor(3, "median-over-seeds F1 floor", "median_over_seeds_median_val_f1", min_median))
    if min_ap is not None:
        gates.append(floor(4, "mean AP floor", "mean_average_precision", min_ap))
    if min_worst is not None:
        gates.append(floor(5, "worst-fold F1 floor", "worst_fold_val_f1", min_worst))
    if max_fixed_bad is not None:
        col = "fixed_threshold_not_ok_count"
        gates.append(gate(6, "fixed-threshold warning cap", F.col(col) <= max_fixed_bad, F.concat(count(col), F.lit(f", cap={max_fixed_bad}"))))
    return summary.select(*keys, F.inline(F.array(*gates)))


# ---------------------------------------------------------------- whole-map metrics


def map_metric_values(metrics: DataFrame) -> DataFrame:
    """Add the derived predicted-to-true rate ratio; NULL when the true rate is missing or zero."""
    rate = F.col("val_positive_rate")
    return metrics.withColumn(
        "pred_to_val_ratio", F.when(rate != 0, floored_ratio(F.col("pred_positive_rate"), rate, 1e-12)))


def compare_maps(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows of a pair with delta; rows missing on both sides are dropped."""
    b = long_metrics(map_metric_values(baseline), keys, MAP_METRICS, "baseline")
    c = long_metrics(map_metric_values(candidate), keys, MAP_METRICS, "candidate")
    rows = b.join(c, [*keys, "metric"], "full").filter("baseline IS NOT NULL OR candidate IS NOT NULL")
    return rows.withColumn("delta", F.col("candidate") - F.col("baseline"))


def map_verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Improved / regressed / mixed per pair, using the metric direction table."""
    gain = F.when(F.col("metric").isin(LOWER_IS_BETTER), -F.col("delta")).when(F.col("metric").isin(HIGHER_IS_BETTER), F.col("delta"))
    n = rows.groupBy(*keys).agg(F.count_if(gain > 0).alias("improved"), F.count_if(gain < 0).alias("regressed"))
    verdict = (F.when((F.col("improved") > 0) & (F.col("regressed") == 0), "candidate_improves_tracked_metrics")
               .when((F.col("regressed") > 0) & (F.col("improved") == 0), "candidate_regresses_tracked_metrics").otherwise("mixed"))
    return n.withColumn("verdict", verdict)


def map_pair_warnings(pairs: DataFrame, require_whole: bool = False) -> DataFrame:
    """Segment and region-type warnings; needs baseline_/candidate_ segment and region_type columns."""

    def kind(side: str) -> Column:
        return F.col(f"{side}_region_type")

    def bad(side: str) -> tuple[Column, Column]:
        off = F.coalesce(kind(side), F.lit("")) != "whole_segment"
        if require_whole:
            return off, F.concat(F.lit(f"{side} evaluation_region.type is not whole_segment: "), F.coalesce(kind(side), F.lit("None")))
        return off & (F.coalesce(kind(side), F.lit("")) != ""), F.concat(F.lit(f"{side} evaluation_region.type is "), kind(side))

    mismatch = F.col("baseline_segment") != F.col("candidate_segment")
    text = F.concat(F.lit("segment mismatch: baseline="), F.col("baseline_segment").cast("string"),
                    F.lit(", candidate="), F.col("candidate_segment").cast("string"))
    return pairs.withColumn("warnings", reasons((mismatch, text), bad("baseline"), bad("candidate")))


def pair_status(rows: DataFrame, keys: list[str], max_ratio_delta: float = 0.01) -> DataFrame:
    """Core evidence status of each pair."""
    core = ["val_f1", "val_f05", "average_precision", "pred_to_val_ratio", "ap_prevalence_lift", "brier_score", "expected_calibration_error"]
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("delta"))).alias(f"{m}_delta") for m in core])
    f1, f05, ap, ratio = (F.col(f"{m}_delta") for m in core[:4])
    status = (
        F.when(f1.isNull() | f05.isNull() | ap.isNull(), "incomplete")
        .when((f1 > 0) & (f05 >= 0) & (ap > 0) & (ratio.isNull() | (ratio <= max_ratio_delta)), "core_improved")
        .when((f1 < 0) | (f05 < 0) | (ap < 0) | (ratio > max_ratio_delta), "core_regressed")
        .otherwise("mixed")
    )
    return wide.withColumn("status", status)


def summarize_comparisons(status: DataFrame, by: list[str]) -> DataFrame:
    """Status counts, mean deltas and the overall verdict per group of pairs."""
    deltas = [c for c in status.columns if c.endswith("_delta")]
    names = ["core_improved", "core_regressed", "mixed", "incomplete"]
    agg = status.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pair_count"), *[F.count_if(F.col("status") == s).alias(s) for s in names],
        *[F.avg(d).alias(f"mean_{d}") for d in deltas],
    )
    n = F.col("pair_count")
    verdict = (F.when(F.col("core_improved") == n, "candidate_improves_core_metrics_all_pairs")
               .when(F.col("core_regressed") == n, "candidate_regresses_core_metrics_all_pairs")
               .when((F.col("core_improved") > 0) & (F.col("core_regressed") > 0), "mixed_core_evidence")
               .otherwise("incomplete_or_mixed_core_evidence"))
    return agg.withColumn("verdict", verdict)


# ---------------------------------------------------------------- configs and risk


def config_diff(left: DataFrame, right: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Differing leaves of two flattened configs in path order; a given ``limit`` keeps the first paths of each pair."""
    lv = left.select(*keys, "path", F.col("value").alias("left_value"))
    rv = right.select(*keys, "path", F.col("value").alias("right_value"))
    rows = lv.join(rv, [*keys, "path"], "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
    if limit is None:
        return rows
    from pyspark.sql import Window as W

    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy("path"))).filter(F.col("ordinal") <= limit)


def risk_rows(pairs: DataFrame) -> DataFrame:
    """Sampled against whole-map rates per LOO map: ratios, deltas, divergence outside 0.5-2."""
    to_full = safe_ratio(F.col("loo_pred_positive_rate"), F.col("pred_positive_rate"))
    full = safe_ratio(F.col("pred_positive_rate"), F.col("val_positive_rate"))
    return pairs.withColumns({
        "sampled_to_full_ratio": to_full,
        "sampled_pred_to_val_ratio": safe_ratio(F.col("loo_pred_positive_rate"), F.col("loo_val_positive_rate")),
        "full_pred_to_val_ratio": full,
        "f1_delta": F.col("val_f1") - F.col("loo_val_f1"),
        "ap_delta": F.col("average_precision") - F.col("loo_average_precision"),
        "high": F.coalesce(full >= 3.5, F.lit(False)),
        "divergent": F.coalesce((to_full < 0.5) | (to_full > 2.0), F.lit(False)),
    })


def risk_summary(candidates: DataFrame, tiles: DataFrame, loo_pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Risk level and warning counts per candidate run."""
    ratio = safe_ratio(F.col("pred_positive_rate"), F.col("val_positive_rate"))
    t = tiles.groupBy(*keys).agg(F.count_if(ratio >= 3.5).alias("high_tiles"))
    p = risk_rows(loo_pairs).groupBy(*keys).agg(
        F.count_if("high").alias("high_loo_tiles"), F.count_if("divergent").alias("divergent_tiles"))
    out = candidates.withColumn("candidate_ratio", ratio).join(t, keys, "left").join(p, keys, "left").fillna(
        0, ["high_tiles", "high_loo_tiles", "divergent_tiles"])
    marks = reasons((F.col("candidate_ratio") >= 3.5, "candidate_ratio_high"), (F.col("high_tiles") > 0, "full_tile_ratio_high"),
                    (F.col("high_loo_tiles") > 0, "loo_full_tile_ratio_high"), (F.col("divergent_tiles") > 0, "sampled_full_tile_divergent"))
    return out.select(*keys, "candidate_ratio", "high_tiles", "high_loo_tiles", "divergent_tiles", marks.alias("warnings"),
                      F.when(F.size(marks) > 0, "warning").otherwise("ok").alias("risk_level"))
