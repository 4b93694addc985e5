"""Folds and leave-one-out summaries.

LOO rows carry ``heldout_segment, seed, returncode, val_f1, average_precision, ...``. All
operators take ``by`` (for example the experiment label) and summarise every group in one job.
Row lists and warnings are long tables with an explicit order instead of arrays built in one
task; ``warning_lists`` folds them into arrays where a caller needs the document form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.functions.columns import first_reason, fixed_text, grouped, null_safe_join, reasons, steady_mean
from evalgate.session import written

# The known hard segment and its floors.
HARD_FOLD_ID = "20230530172803"
HARD_FOLD_MIN_AP = 0.02
HARD_FOLD_MIN_F1 = 0.02
AUDIT_AP = max(HARD_FOLD_MIN_AP * 1.5, 0.03)

ALARMS = ["zero_precision_or_recall", "zero_positive_validation", "positive_rate_alarm",
          "fixed_threshold_not_ok", "threshold_edge_case", "weak_ap_prevalence_lift"]


# ---------------------------------------------------------------- folds and tasks


def build_folds(patches: DataFrame, segment: str = "segment") -> DataFrame:
    """Leave-one-segment-out folds as (heldout, train_segment) pairs over distinct segments.

    The pairs are built on the segment catalogue, never on patches; a fold with no other
    segment has no row, so fewer than two segments give an empty result.
    """
    sizes = patches.groupBy(segment).agg(F.count(F.lit(1)).alias("samples"))
    a = sizes.select(F.col(segment).alias("heldout_segment"), F.col("samples").alias("val_samples"))
    b = sizes.select(F.col(segment).alias("train_segment"), F.col("samples").alias("train_samples"))
    return a.join(b, F.col("heldout_segment") != F.col("train_segment"))


def fold_sizes(patches: DataFrame, segment: str = "segment") -> DataFrame:
    """Leave-one-segment-out folds, a row each: own samples and those of all other segments (total less own).

    A segment without others has no fold. The train side of a fold is `fold_train_patches`, so pairs of segments are never listed.
    """
    sizes = patches.groupBy(segment).agg(F.count(F.lit(1)).alias("val_samples"))
    # the totals are a scalar subquery: one row that Spark sends along with the projection
    total = sizes.agg(F.sum("val_samples")).scalar()
    others = sizes.agg(F.count(F.lit(1))).scalar() - 1
    return sizes.select(F.col(segment).alias("heldout_segment"), "val_samples", (total - F.col("val_samples")).alias("train_samples"), others.alias("train_segments")).filter("train_segments > 0")


def fold_train_patches(patches: DataFrame, heldout, segment: str = "segment") -> DataFrame:
    """Training patches of one fold: a filter that reaches the scan, no join."""
    return patches.filter(F.col(segment) != F.lit(heldout))


def audit_folds(label_pixels: DataFrame, fold: str, min_positive: int = 1) -> DataFrame:
    return label_pixels.groupBy(fold).agg(
        F.count_if(F.col("label") > 0.5).alias("positive_pixels"), F.count(F.lit(1)).alias("total_pixels"),
    ).select(
        F.col(fold).alias("fold_id"), "positive_pixels", "total_pixels",
        (F.col("positive_pixels") / F.col("total_pixels")).alias("positive_rate"),
        (F.col("positive_pixels") >= min_positive).alias("usable"),
    )


def plan_tasks(folds: DataFrame, fold: str, seeds: list, max_tasks: int | None = None) -> DataFrame:
    """Every fold with every seed, folds in order and seeds as given; a limit keeps the first ones."""
    seed_col = F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("seed_ordinal", "seed")
    tasks = folds.select(F.col(fold).alias("fold_id")).distinct().select("fold_id", seed_col)
    return tasks if max_tasks is None else tasks.orderBy("fold_id", "seed_ordinal").limit(max_tasks)


def leakage(extra_sets: DataFrame, folds: DataFrame, set_id: str, segments: str, fold: str) -> DataFrame:
    """(set, fold) pairs where the set's provenance holds the held-out segment; an equi-join."""
    seen = extra_sets.select(set_id, F.explode(segments).alias("_segment")).distinct()
    held = folds.select(F.col(fold).alias("heldout_segment")).distinct()
    return seen.join(held, F.col("_segment") == F.col("heldout_segment")).select(set_id, "heldout_segment")


def safe_sets(extra_sets: DataFrame, folds: DataFrame, set_id: str, segments: str, fold: str) -> DataFrame:
    """Sets that leak into no fold at all."""
    bad = leakage(extra_sets, folds, set_id, segments, fold).select(set_id).distinct()
    return extra_sets.join(bad, set_id, "left_anti")


# ---------------------------------------------------------------- row flags


def row_id(fold: str = "heldout_segment", seed: str = "seed") -> Column:
    text = F.coalesce(F.col(fold).cast("string"), F.lit("unknown"))
    return F.when(F.col(seed).isNotNull(), F.concat(text, F.lit(":seed="), F.col(seed).cast("string"))).otherwise(text)


def row_alarms(rows: DataFrame) -> DataFrame:
    """Row id, success flag and the six alarm flags; alarms only fire on successful rows."""
    ok = (F.coalesce(F.col("returncode"), F.lit(0)) == 0) & F.col("val_f1").isNotNull()
    ratio = F.when(F.col("val_positive_rate") > 0, F.col("pred_positive_rate") / F.col("val_positive_rate"))
    ap = F.coalesce("average_precision", F.lit(0.0))
    lift = F.coalesce("ap_prevalence_lift", F.when(F.col("val_positive_rate") > 0, ap / F.col("val_positive_rate")))
    flags = {
        "zero_precision_or_recall": (F.col("precision") == 0.0) | (F.col("recall") == 0.0),
        "zero_positive_validation": F.col("val_positive_rate") == 0.0,
        "positive_rate_alarm": (ratio > 3.5) | (ratio < 0.1),
        "fixed_threshold_not_ok": F.col("fixed_threshold_status") != "ok",
        "threshold_edge_case": (F.col("best_threshold") <= 0.01) | (F.col("best_threshold") >= 0.99),
        "weak_ap_prevalence_lift": lift < 1.25,
    }
    out = rows.withColumn("row_id", row_id()).withColumn("ok", ok)
    return out.withColumn("pred_to_val_ratio", ratio).withColumns(
        {k: F.coalesce(F.col("ok") & v, F.lit(False)) for k, v in flags.items()}
    )


# ---------------------------------------------------------------- summary


def loo_levels(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fold, seed and global aggregates of successful rows in one pass over grouping sets."""
    ok = row_alarms(rows).filter("ok")
    ap = F.coalesce("average_precision", F.lit(0.0))
    keys = [F.col(c) for c in by]
    fold, seed = F.col("heldout_segment"), F.col("seed")
    return ok.groupingSets([[*keys, fold], [*keys, seed], keys], *keys, fold, seed).agg(
        F.when(F.grouping("heldout_segment") == 0, "fold").when(F.grouping("seed") == 0, "seed").otherwise("all").alias("level"),
        steady_mean(F.col("val_f1")).alias("mean_f1"), F.median("val_f1").alias("median_f1"), F.min("val_f1").alias("min_f1"),
        steady_mean(ap).alias("mean_ap"), F.median(ap).alias("median_ap"),
        F.countDistinct("seed").alias("seeds"), F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(a)).alias(a) for a in ALARMS],
    )


def loo_summarize(rows: DataFrame, by: list[str], min_seeds: int = 3, expected_folds: list[str] | None = None,
                  expected_seeds: list | None = None, expected_tasks: int | None = None,
                  max_tasks: int | None = None, hard_fold_id: str = HARD_FOLD_ID) -> DataFrame:
    """One summary row per group; ready means some success and no warning of any kind.

    LOO rows are short but may be costly (an evaluation each), so they are worked out once for all parts of the summary.
    """
    rows, by = grouped(rows, by)
    rows = written(rows)
    totals = row_alarms(rows).groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds_requested"), F.count_if("ok").alias("folds_successful"),
        F.count_if(~F.col("ok")).alias("folds_failed"),
    )
    levels = loo_levels(rows, by)
    is_fold, is_seed, is_all = (F.col("level") == v for v in ("fold", "seed", "all"))
    fold_f1 = F.when(is_fold, F.col("mean_f1"))
    stats = levels.groupBy(*by).agg(
        F.median(fold_f1).alias("median_val_f1"), steady_mean(fold_f1).alias("mean_val_f1"), F.min(fold_f1).alias("min_val_f1"),
        F.max(fold_f1).alias("max_val_f1"), steady_mean(F.when(is_fold, F.col("mean_ap"))).alias("mean_average_precision"),
        F.max(F.when(is_all, F.col("median_ap"))).alias("median_average_precision"),
        F.min_by(F.when(is_fold, F.col("heldout_segment")),
                 F.when(is_fold, F.struct("mean_f1", "heldout_segment"))).alias("worst_fold_id"),
        F.median(F.when(is_seed, F.col("median_f1"))).alias("median_over_seeds_median_val_f1"),
        F.min(F.when(is_seed, F.col("median_f1"))).alias("worst_seed_median_val_f1"),
        F.max(F.when(is_all, F.col("seeds"))).alias("distinct_successful_seeds"),
        *[F.coalesce(F.max(F.when(is_all, F.col(a))), F.lit(0)).alias(f"{a}_count") for a in ALARMS],
    ).withColumn("worst_fold_val_f1", F.col("min_val_f1"))
    warned = _warnings_of(rows, by, min_seeds, expected_folds, expected_seeds, expected_tasks, max_tasks, hard_fold_id)
    warned = warned.groupBy(*by).agg(F.count(F.lit(1)).alias("warning_count"))
    out = totals
    for part in (stats, warned):
        out = out.join(part, by, "left")
    filled = ["distinct_successful_seeds", "warning_count", *[f"{a}_count" for a in ALARMS]]
    out = out.fillna(0, filled)
    return out.withColumn("promotion_ready", (F.col("folds_successful") > 0) & (F.col("warning_count") == 0))


def fold_means(rows: DataFrame, by: list[str]) -> DataFrame:
    ap = F.coalesce("average_precision", F.lit(0.0))
    return row_alarms(rows).filter("ok").groupBy(*by, "heldout_segment").agg(
        steady_mean(F.col("val_f1")).alias("val_f1"), steady_mean(ap).alias("average_precision"), F.countDistinct("seed").alias("successful_seeds"))


def seed_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    ap = F.coalesce("average_precision", F.lit(0.0))
    return row_alarms(rows).filter("ok").groupBy(*by, "seed").agg(
        F.avg("val_f1").alias("mean_val_f1"), F.median("val_f1").alias("median_val_f1"), F.min("val_f1").alias("min_val_f1"), F.avg(ap).alias("mean_average_precision"))


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    status = F.coalesce(F.nullif("fixed_threshold_status", F.lit("")), F.lit("missing"))
    return row_alarms(rows).filter("ok").groupBy(*by, status.alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def coverage(rows: DataFrame, by: list[str], folds: list[str] | None, seeds: list | None,
             successful_only: bool = False) -> DataFrame:
    """Missing folds (``seed`` NULL) and missing (fold, seed) pairs per group."""
    flagged = row_alarms(rows)
    groups = flagged.select(*by).distinct()
    seen = flagged.filter("ok") if successful_only else flagged
    text = F.col("heldout_segment").cast("string")
    if folds is None:
        wanted = flagged.select(*by, text.alias("heldout_segment")).distinct()
    else:
        wanted = groups.withColumn("heldout_segment", F.explode(F.array(*[F.lit(str(f)) for f in sorted(folds)])))
    have_fold = seen.select(*by, text.alias("heldout_segment")).distinct()
    no_fold = null_safe_join(wanted, have_fold, [*by, "heldout_segment"], "left_anti").withColumn(
        "seed", F.lit(None).cast("string"))
    out = no_fold.withColumn("kind", F.lit("missing_expected_fold"))
    if folds is None:
        out = out.limit(0)
    if seeds:
        pairs = wanted.withColumn("seed", F.explode(F.array(*[F.lit(str(s)) for s in seeds])))
        have = seen.select(*by, text.alias("heldout_segment"), F.col("seed").cast("string").alias("seed")).distinct()
        no_pair = null_safe_join(pairs, have, [*by, "heldout_segment", "seed"], "left_anti")
        out = out.unionByName(no_pair.withColumn("kind", F.lit("missing_expected_seed_repeat")))
    return out


def loo_warnings(rows: DataFrame, by: list[str], min_seeds: int = 3, expected_folds: list[str] | None = None,
                 expected_seeds: list | None = None, expected_tasks: int | None = None,
                 max_tasks: int | None = None, hard_fold_id: str = HARD_FOLD_ID) -> DataFrame:
    """Promotion warnings, one row each, ordered by (rule, heldout_segment, seed)."""
    rows, by = grouped(rows, by)
    return _warnings_of(written(rows), by, min_seeds, expected_folds, expected_seeds, expected_tasks, max_tasks, hard_fold_id)


def _warnings_of(rows: DataFrame, by: list[str], min_seeds: int, expected_folds: list[str] | None, expected_seeds: list | None,
                 expected_tasks: int | None, max_tasks: int | None, hard_fold_id: str) -> DataFrame:
    flagged = row_alarms(rows)
    fold, seed = F.col("heldout_segment").cast("string"), F.col("seed").cast("string")

    def named(rule: int, text: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), text.alias("warning"))

    def note(prefix: str, *parts: Column | str) -> Column:
        return F.concat(F.lit(prefix), *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    failed = F.coalesce(F.col("returncode"), F.lit(0)) != 0
    detail = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit(":"), F.col("error"))).otherwise("")
    per_row = reasons(
        (failed, named(4, note("failed_fold:", F.col("row_id"), detail))),
        (~failed & ~F.col("ok"), named(5, note("missing_or_invalid_val_f1:", F.col("row_id")))),
        (F.col("ok") & F.col("average_precision").isNull(), named(6, note("missing_average_precision:", F.col("row_id")))),
        *[(F.col(a), named(9 + i, note(f"{a}:", F.col("row_id")))) for i, a in enumerate(ALARMS)],
    )
    parts = [flagged.select(*by, fold.alias("heldout_segment"), seed.alias("seed"), F.inline(per_row))]

    ap = F.coalesce("average_precision", F.lit(0.0))
    per_fold = flagged.groupBy(*by, fold.alias("heldout_segment")).agg(
        F.countDistinct(F.when(F.col("ok"), F.col("seed"))).alias("n"), F.count_if("ok").alias("ok"),
        F.avg(F.when(F.col("ok"), F.col("val_f1"))).alias("f1"), F.avg(F.when(F.col("ok"), ap)).alias("ap"),
    )
    hard = F.col("heldout_segment") == hard_fold_id
    fold_notes = reasons(
        (hard & (F.col("f1") < HARD_FOLD_MIN_F1), named(7, note("hard_fold_low_f1:", F.col("heldout_segment"), ":", fixed_text(F.col("f1"))))),
        (hard & (F.col("ap") < HARD_FOLD_MIN_AP), named(8, note("hard_fold_low_ap:", F.col("heldout_segment"), ":", fixed_text(F.col("ap"))))),
        (F.col("n") < min_seeds, named(16, note("insufficient_fold_seed_repeats:", F.col("heldout_segment"), ":",
                                                F.col("n").cast("string"), f"/{min_seeds}"))),
    )
    none = F.lit(None).cast("string").alias("seed")
    parts.append(per_fold.select(*by, "heldout_segment", none, F.inline(fold_notes)))

    expected = "coalesce(expected, n)"
    per_group = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"),
        F.countDistinct(F.when(F.col("ok"), F.col("seed"))).alias("seeds"),
    ).withColumn("expected", F.lit(expected_tasks).cast("long"))
    group_notes = reasons(
        (F.lit(max_tasks is not None) & (F.col("n") < F.expr(expected)),
         named(1, note("partial_task_limit_applied:", F.col("n").cast("string"), "/", F.expr(expected).cast("string")))),
        ((F.col("ok") > 0) & (F.col("seeds") < min_seeds),
         named(15, note("insufficient_seed_repeats:", F.col("seeds").cast("string"), f"/{min_seeds}"))),
        (F.col("ok") == 0, named(18, F.lit("no_successful_folds"))),
    )
    parts.append(per_group.select(*by, F.lit(None).cast("string").alias("heldout_segment"), none, F.inline(group_notes)))

    if expected_folds or expected_seeds:
        planned = coverage(rows, by, expected_folds, expected_seeds).withColumn("rule", F.when(
            F.col("kind") == "missing_expected_fold", 2).otherwise(3))
        if expected_seeds:
            done = coverage(rows, by, expected_folds, expected_seeds, successful_only=True)
            planned = planned.unionByName(done.filter("kind = 'missing_expected_seed_repeat'").withColumn("rule", F.lit(17)))
        text = F.concat_ws(":", "kind", "heldout_segment", "seed")
        first = planned.select(*by, "heldout_segment", "seed", "rule", text.alias("warning"))
        parts.append(first.groupBy(*by, "heldout_segment", "seed", "warning").agg(F.min("rule").alias("rule"))
                     .select(*by, "heldout_segment", "seed", "rule", "warning"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def warning_lists(warnings: DataFrame, by: list[str]) -> DataFrame:
    """Ordered warning array per group; its length is bounded by rules x (folds x seeds) of the group."""
    item = F.struct("rule", F.coalesce("heldout_segment", F.lit("")).alias("f"), F.coalesce("seed", F.lit("")).alias("s"), "warning")
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda r: r["warning"])
    return warnings.groupBy(*by).agg(ordered.alias("promotion_warnings"))


# ---------------------------------------------------------------- diagnostics


def hard_fold(rows: DataFrame, by: list[str], fold_id: str = HARD_FOLD_ID) -> DataFrame:
    """Floors of one fold: means over its successful rows, pass flag, audit flag."""
    rows, by = grouped(rows, by)
    ok = row_alarms(rows).filter(F.col("ok") & (F.col("heldout_segment").cast("string") == fold_id))
    ap = F.coalesce("average_precision", F.lit(0.0))
    out = ok.groupBy(*by).agg(
        F.avg("val_f1").alias("val_f1"), F.avg(ap).alias("average_precision"),
        F.avg("ap_prevalence_lift").alias("mean_ap_prevalence_lift"),
        F.avg("val_positive_rate").alias("mean_val_positive_rate"),
        F.avg("pred_positive_rate").alias("mean_pred_positive_rate"),
    )
    return out.select(
        *by, F.lit(fold_id).alias("fold_id"), "val_f1", "average_precision",
        (F.col("average_precision") - HARD_FOLD_MIN_AP).alias("average_precision_floor_delta"),
        "mean_ap_prevalence_lift", "mean_val_positive_rate", "mean_pred_positive_rate",
        ((F.col("val_f1") >= HARD_FOLD_MIN_F1) & (F.col("average_precision") >= HARD_FOLD_MIN_AP)).alias("passed"),
        (F.col("average_precision") <= AUDIT_AP).alias("audit_labels"),
    )


def recommended_actions(rows: DataFrame, by: list[str], fold_id: str = HARD_FOLD_ID) -> DataFrame:
    """Ordered (ordinal, action) rows of a summary."""
    rows, by = grouped(rows, by)
    hard_ap = F.when(F.col("heldout_segment").cast("string") == fold_id, F.coalesce("average_precision", F.lit(0.0)))
    joined = row_alarms(rows).filter("ok").groupBy(*by).agg(
        F.max("fixed_threshold_not_ok").alias("fixed"), F.max("positive_rate_alarm").alias("rate"), (F.avg(hard_ap) <= AUDIT_AP).alias("audit_labels"))
    acts = reasons((F.coalesce("audit_labels", F.lit(False)), "audit_hard_fold_labels"), (F.col("fixed"), "calibrate_fixed_threshold"),
                   (F.col("rate"), "review_positive_rate_calibration"))
    return joined.select(*by, F.posexplode(acts).alias("ordinal", "action"))


def fold_diagnostics(rows: DataFrame, cap: float | None = None, low_f1: float = 0.04) -> DataFrame:
    """Per-row ratio, cap excess and low-F1 flags next to the alarm flags."""
    flagged = row_alarms(rows)
    limit = F.coalesce(F.col("max_pred_positive_rate_ratio") if "max_pred_positive_rate_ratio" in rows.columns
                       else F.lit(None).cast("double"), F.lit(cap).cast("double"))
    zero = F.col("zero_precision_or_recall") | F.coalesce((F.col("precision") == 0.0) | (F.col("recall") == 0.0), F.lit(False))
    out = flagged.withColumns({
        "cap": limit,
        "low_f1": F.coalesce(F.col("val_f1") < low_f1, F.lit(False)),
        "over_cap": F.coalesce(F.col("pred_to_val_ratio") > limit, F.lit(False)),
        "zero_precision_or_recall": zero,
    })
    order = ["low_f1", "over_cap", "zero_precision_or_recall", "positive_rate_alarm", "fixed_threshold_not_ok"]
    return out.withColumn("flags", F.array_join(reasons(*[(F.col(c), c) for c in order]), ", "))


def diagnostics_summary(diagnostics: DataFrame, by: list[str], fold_id: str = HARD_FOLD_ID) -> DataFrame:
    hard = F.col("heldout_segment").cast("string") == fold_id
    agg = diagnostics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("fixed_threshold_not_ok").alias("fixed_threshold_not_ok_count"),
        F.count_if("positive_rate_alarm").alias("positive_rate_alarm_count"),
        F.count_if("zero_precision_or_recall").alias("zero_precision_or_recall_count"),
        F.count_if("over_cap").alias("over_cap_count"), F.count_if("low_f1").alias("low_f1_count"),
        F.count_if(hard).alias("hard_rows"),
        F.avg(F.when(hard, F.coalesce("average_precision", F.lit(0.0)))).alias("_ap"),
        F.avg(F.when(hard, F.col("ap_prevalence_lift"))).alias("_lift"),
    )
    action = first_reason(
        ((F.col("fixed_threshold_not_ok_count") > 0) & (F.col("fixed_threshold_not_ok_count") == F.col("total_rows")),
         "diagnose fixed-threshold calibration across all LOO rows"),
        ((F.col("_ap") <= 0.03) | (F.col("_lift") < 1.5), "audit hard-fold labels/sampling before threshold tuning"),
        default="review linked LOO diagnostics",
    )
    return agg.withColumn("next_action", action).drop("_ap", "_lift")


def failure_reason_counts(diagnostics: DataFrame, by: list[str]) -> DataFrame:
    reason = F.coalesce(F.nullif("fixed_threshold_failure_reason", F.lit("")), "fixed_threshold_status", F.lit("unknown"))
    return diagnostics.filter("fixed_threshold_not_ok").groupBy(*by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def hard_fold_profile(rows: DataFrame, by: list[str], fold_id: str = HARD_FOLD_ID, tiles: DataFrame | None = None) -> DataFrame:
    """Failure mode of the hard fold; means take the seed rows plus the pooled fold value."""
    rows, by = grouped(rows, by)
    flagged = row_alarms(rows)
    mine = flagged.filter(F.col("heldout_segment").cast("string") == fold_id)
    ok = F.col("ok")
    ap0 = F.coalesce("average_precision", F.lit(0.0))
    agg = mine.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("val_f1").alias("sf"), F.count("val_f1").alias("nf"), F.min("val_f1").alias("minf"),
        F.sum("average_precision").alias("sa"), F.count("average_precision").alias("na"),
        F.avg(F.when(ok, F.col("val_f1"))).alias("pf"), F.avg(F.when(ok, ap0)).alias("pa"),
        F.avg("ap_prevalence_lift").alias("mean_ap_prevalence_lift"), F.avg("val_positive_rate").alias("mean_val_positive_rate"),
        F.avg("pred_positive_rate").alias("mean_pred_positive_rate"),
        F.max("weak_ap_prevalence_lift").alias("weak_lift"),
        F.max(F.coalesce(~F.col("fixed_threshold_status").isin("ok", "unknown", ""), F.lit(False))).alias("fixed_weak"),
    )
    pooled = F.when(F.col("pf").isNotNull(), 1).otherwise(0)
    agg = agg.withColumns({
        "mean_val_f1": (F.coalesce("sf", F.lit(0.0)) + F.coalesce("pf", F.lit(0.0))) / F.nullif(F.col("nf") + pooled, F.lit(0)),
        "min_val_f1": F.least("minf", "pf"),
        "mean_average_precision": (F.coalesce("sa", F.lit(0.0)) + F.coalesce("pa", F.lit(0.0))) / F.nullif(F.col("na") + pooled, F.lit(0)),
    })
    near = (F.col("weak_lift") | F.coalesce(F.col("mean_ap_prevalence_lift") < 2.0, F.lit(False))
            | F.coalesce(F.col("mean_average_precision") < F.col("mean_val_positive_rate") * 2.0, F.lit(False)))
    low_ap = F.coalesce(F.col("mean_average_precision") < 0.05, F.lit(False))
    low_f1 = F.coalesce(F.col("min_val_f1") < 0.04, F.lit(False))
    modes = [(near | low_ap, "low_ap_near_prevalence", "blocker", "audit_hard_fold_labels_and_sampling"),
             (low_f1, "weak_fold_low_f1", "blocker", "lower_positive_patch_pressure"),
             (F.col("fixed_weak"), "fixed_threshold_weak", "warning", "calibrate_probability_scale")]
    out = agg.select(
        *by, F.lit(fold_id).alias("fold_id"), "row_count", "mean_val_f1", "min_val_f1", "mean_average_precision",
        "mean_ap_prevalence_lift", "mean_val_positive_rate", "mean_pred_positive_rate",
        first_reason(*[(c, m) for c, m, _, _ in modes], default="review").alias("failure_mode"),
        first_reason(*[(c, s) for c, _, s, _ in modes], default="info").alias("severity"),
        first_reason(*[(c, a) for c, _, _, a in modes], default="review_hard_fold_evidence").alias("recommended_action"),
    )
    if tiles is not None:
        tile_ap = tiles.filter(F.col("segment_id").cast("string") == fold_id).groupBy(*by).agg(
            F.avg("average_precision").alias("full_tile_average_precision"))
        out = out.join(tile_ap, by, "left")
    return out


def failure_pattern(summary: DataFrame, profile: DataFrame, missing: DataFrame, by: list[str]) -> DataFrame:
    """First matching failure pattern of each summary, in priority order."""
    gaps = missing.groupBy(*by).agg(
        F.count_if(F.col("kind") == "missing_expected_fold").alias("_mf"),
        F.count_if(F.col("kind") == "missing_expected_seed_repeat").alias("_ms"))
    joined = summary.join(profile.select(*by, "failure_mode", "severity", "recommended_action"), by, "left").join(gaps, by, "left")
    rules = [
        (F.col("severity") == "blocker", F.concat(F.lit("hard_fold_"), F.col("failure_mode")), F.col("recommended_action")),
        (F.col("_mf") > 0, "missing_expected_folds", "complete_linked_loo_folds"),
        (F.col("_ms") > 0, "missing_seed_repeats", "complete_seed_repeats"),
        (F.col("zero_positive_validation_count") > 0, "zero_positive_validation", "audit_validation_labels"),
        (F.col("fixed_threshold_not_ok_count") > 0, "fixed_threshold_not_ok", "calibrate_fixed_threshold"),
        (F.col("positive_rate_alarm_count") > 0, "positive_rate_alarm", "review_positive_rate_calibration"),
        (F.col("weak_ap_prevalence_lift_count") > 0, "weak_ap_prevalence_lift", "improve_ranking_signal"),
    ]
    return joined.select(
        *by, first_reason(*[(c, p) for c, p, _ in rules], default="none").alias("pattern"),
        first_reason(*[(c, a) for c, _, a in rules], default="promotion_review").alias("next_step"),
        (~F.col("promotion_ready")).alias("blocks_promotion"),
    )


def weak_fold_row(rows: DataFrame, summary: DataFrame, by: list[str], artifact: str) -> DataFrame:
    """Row of the worst fold whose F1 is nearest to the fold mean; the first such row wins."""
    target = summary.select(*by, F.col("worst_fold_id").alias("_fold"), F.col("worst_fold_val_f1").alias("_f1"))
    joined = rows.join(target, by).filter((F.col("heldout_segment") == F.col("_fold")) & F.col(artifact).isNotNull())
    gap = F.abs(F.coalesce("val_f1", F.lit(0.0)) - F.col("_f1"))
    pick = F.min_by(F.struct("heldout_segment", "seed", artifact, "val_f1"), F.struct(gap, "seed"))
    return joined.groupBy(*by).agg(pick.alias("r")).select(*by, "r.*")
