"""Run-ledger analytics.

Operators take ``by`` (for example the research scope) and answer for every group in one job.
"Newest" means (ts, run_id) descending. Best-of lookups are ``max_by`` aggregates, which
combine map-side; top-k lists are ``row_number() <= k`` filters, which Spark limits per input
partition before the shuffle, so a hot group never travels whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalgate.functions.columns import bounded_join, falsy_zero, first_reason, floored_ratio, grouped, is_few, null_safe_join, number_of, reasons
from evalgate.functions.tables import HELD_OUT_MODES, PLANNER_SECTION, SEARCH_DEFAULTS
from evalgate.operators.rules import cost_rank, is_robust, lookup, mutation_family, scope_priority, validation_priority
from evalgate.session import checkpointed, written

HARD_SEGMENTS = ["20230530172803", "20230522181603"]


def optional(df: DataFrame, name: str, kind: str, default=None) -> Column:
    """A column the ledger may lack."""
    if name in df.columns:
        col = F.col(name).cast(kind)
        return col if default is None else F.coalesce(col, F.lit(default))
    return F.lit(default).cast(kind)


def metric_direction(metric: str) -> int:
    """1 when lower is better (losses), -1 otherwise."""
    return 1 if "loss" in metric.lower() else -1


def newest(ts: str = "ts", key: str = "run_id") -> Column:
    return F.struct(ts, key)


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group in the given order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


# ---------------------------------------------------------------- latest rows and upserts


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key; a map-side combined max_by instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def dedupe_runs(runs: DataFrame, signature: str = "signature") -> DataFrame:
    return latest_by(runs, [signature], ["ts", "run_id"])


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key; ``new`` must have unique keys."""
    kept = base.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_proposals(base: DataFrame, new: DataFrame, key: str = "proposal_id", created: str = "created_at") -> DataFrame:
    """Upsert that keeps the first creation time of a proposal."""
    first = base.select(key, F.col(created).alias("_first"))
    stamped = new.join(first, key, "left").withColumn(created, F.coalesce("_first", created)).drop("_first")
    return upsert(base, stamped.select(*new.columns), [key])


def apply_results(proposals: DataFrame, results: DataFrame) -> DataFrame:
    """Proposals with the status of their last result."""
    last = results.groupBy("proposal_id").agg(F.max_by("status", "id").alias("_status"))
    return proposals.join(last, "proposal_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def recent(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Newest n rows of a ledger table (a distributed top-n)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def upsert_diagnoses(base: DataFrame, new: DataFrame) -> DataFrame:
    """Diagnoses keyed ``run:code``."""
    keyed = new.withColumn("diagnosis_id", F.concat_ws(":", F.col("candidate_run_id").cast("string"), "code"))
    return upsert(base, keyed.select(*base.columns), ["diagnosis_id"])


# ---------------------------------------------------------------- lineage

LINEAGE = ["proposal_id", "hypothesis_id", "config_signature", "changed_path", "mutation_family", "arm_id", "parent_reason",
           "scope_policy", "search_strategy", "strategy_phase", "cost_tier", "proposal_score"]
LINEAGE_DOCS = ["proposal_score_components", "triage_failures", "score_reasons", "promotion_required"]


def lineage(runs: DataFrame, doc: str = "doc") -> DataFrame:
    """Proposal lineage of each run from its configuration document."""
    flat = [F.try_variant_get(doc, f"$.{PLANNER_SECTION}.{c}", "string").alias(c) for c in LINEAGE]
    nested = [F.to_json(F.try_variant_get(doc, f"$.{PLANNER_SECTION}.{c}", "variant")).alias(c) for c in LINEAGE_DOCS]
    return runs.select("run_id", "ts", *flat, *nested)


def observed_hypotheses(lineage_rows: DataFrame, hypotheses: DataFrame, limit: int | None = None) -> DataFrame:
    """Hypotheses seen in runs but not in the ledger; the newest run of each represents it. A given limit keeps the newest."""
    new = lineage_rows.filter("hypothesis_id IS NOT NULL AND hypothesis_id <> ''").join(
        hypotheses.select("hypothesis_id"), "hypothesis_id", "left_anti")
    first = new.groupBy("hypothesis_id").agg(F.max_by(F.struct("run_id", "ts", "parent_reason", "mutation_family"), newest()).alias("r"))
    out = first.select("hypothesis_id", F.coalesce("r.parent_reason", "r.mutation_family").alias("title"),
                       F.col("r.run_id").alias("parent_run_id"), F.lit("observed").alias("status"), F.col("r.ts").alias("ts"))
    return (out if limit is None else recent(out, ["ts", "parent_run_id"], limit)).drop("ts")


# ---------------------------------------------------------------- gates and blockers


def _rates(df: DataFrame) -> tuple[Column, Column]:
    pred, val = F.col("pred_positive_rate"), F.col("val_positive_rate")
    return F.when(pred.isNotNull() & val.isNotNull(), floored_ratio(pred, val, 1e-6)), val


def _not_positive() -> Column:
    return (falsy_zero(F.col("precision_")) <= 0) | (falsy_zero(F.col("recall_")) <= 0)


def _fixed_bad() -> Column:
    status = F.lower(F.coalesce("fixed_threshold_status", F.lit("")))
    return (status != "") & (status != "ok")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _multi(scope: Column) -> Column:
    s = F.coalesce(scope, F.lit(""))
    return s.contains("multi_segment") | s.contains("leave_one_out")


def gate_warnings(runs: DataFrame) -> DataFrame:
    """Planner gate: ordered warnings and eligibility."""
    ratio, _ = _rates(runs)
    thr = F.col("best_threshold")
    lift = optional(runs, "ap_prevalence_lift", "double")
    warn = reasons(
        (~_true(F.col("validation_mode").isin(HELD_OUT_MODES)), "validation_not_held_out"),
        (F.col("val_f1").isNull(), "missing_val_f1"),
        (F.col("average_precision").isNull(), "missing_average_precision"),
        (_not_positive(), "zero_precision_or_recall"),
        (_true((ratio > 3.5) | (ratio < 0.1)), "pred_positive_rate_ratio_suspicious"),
        (F.col("fixed_threshold_status").isNull(), "missing_fixed_threshold_status"),
        (_fixed_bad(), "fixed_threshold_status_weak"),
        (_true((thr <= 0.03) | (thr >= 0.94)), "best_threshold_at_sweep_edge"),
        (_true(lift < 1.25), "weak_ap_lift"),
        (_true(optional(runs, "checks_eligible", "boolean") == F.lit(False)), "promotion_checks_ineligible"),
        (optional(runs, "cron_safety", "boolean", False), "cron_safety_run_not_promotable"),
        (optional(runs, "oversized_patch", "boolean", False), "patch_size_exceeds_guidance"),
        (~_multi(F.col("research_scope")), "not_multisegment_scope"),
    )
    return runs.withColumn("gate_warnings", warn).withColumn("eligible", F.size("gate_warnings") == 0)


def blockers(runs: DataFrame) -> DataFrame:
    """Dashboard blockers (code, category, severity) and promotion status.

    Evidence flags ``loo_ready``, ``tile_ready``, ``tile_quality_fail``, ``hard_fold_mode``,
    ``weak_tile_status`` and ``loo_tile_quality_fail`` come from linked tables when present.
    """
    ratio, val = _rates(runs)
    lift = F.coalesce(optional(runs, "ap_prevalence_lift", "double"),
                      F.when(F.abs(val) >= 1e-9, F.col("average_precision") / val))
    scope = F.col("research_scope")
    robust = is_robust(F.col("model_name"), scope, scope)
    tiles = optional(runs, "tile_ready", "boolean", False)
    hard = optional(runs, "hard_fold_mode", "string")
    weak = optional(runs, "weak_tile_status", "string")
    f1 = falsy_zero(F.col("val_f1"))
    fixed = F.coalesce(optional(runs, "fixed_threshold_f1", "double"), f1)
    thr = F.col("best_threshold")
    tr, va = F.col("train_segment").cast("string"), F.col("val_segment").cast("string")
    rules = [
        (F.col("val_f1").isNull(), "missing_val_f1", "metrics", "blocker"),
        (F.col("average_precision").isNull(), "missing_average_precision", "metrics", "blocker"),
        (_not_positive(), "zero_precision_or_recall", "calibration", "blocker"),
        (_true((ratio > 3.5) | (ratio < 0.1)), "pred_positive_rate_ratio_suspicious", "calibration", "blocker"),
        (_true(val <= 0), "zero_positive_validation", "validation", "blocker"),
        (_true(lift < 1.25), "weak_ap_prevalence_lift", "validation", "blocker"),
        (_fixed_bad(), "fixed_threshold_status_weak", "calibration", "blocker"),
        (_true(optional(runs, "checks_eligible", "boolean") == F.lit(False)), "promotion_checks_ineligible", "promotion_checks", "blocker"),
        (optional(runs, "cron_safety", "boolean", False), "cron_safety_run_not_promotable", "policy", "blocker"),
        (~_multi(scope), "not_multisegment_scope", "validation", "blocker"),
        (~_true(F.col("validation_mode").isin(HELD_OUT_MODES)), "validation_not_held_out", "validation", "blocker"),
        (_true((va != "?") & (tr == va)), "validation_segment_leakage", "validation", "blocker"),
        (robust & ~optional(runs, "loo_ready", "boolean", False), "missing_seed_repeat_loo", "validation", "blocker"),
        (robust & ~tiles, "missing_full_tile_evidence", "inference", "blocker"),
        (robust & tiles & optional(runs, "tile_quality_fail", "boolean", False), "full_tile_quality_fail", "quality", "blocker"),
        (robust & _true(hard == "low_ap_near_prevalence"), "hard_fold_low_ap", "validation", "blocker"),
        (robust & _true(hard == "weak_fold_low_f1"), "hard_fold_low_f1", "validation", "blocker"),
        (robust & _true(weak == "missing"), "missing_weak_fold_full_tile_evidence", "inference", "blocker"),
        (robust & _true(weak == "warning"), "weak_fold_full_tile_quality_fail", "quality", "blocker"),
        (robust & optional(runs, "loo_tile_quality_fail", "boolean", False), "loo_full_tile_quality_fail", "quality", "blocker"),
        (_true((thr <= 0.03) | (thr >= 0.94)), "best_threshold_at_sweep_edge", "calibration", "warning"),
        ((f1 >= 0.2) & (fixed < 0.05), "fixed_threshold_f1_low", "calibration", "warning"),
    ]
    items = reasons(*[(c, F.struct(F.lit(code).alias("code"), F.lit(cat).alias("category"), F.lit(sev).alias("severity")))
                      for c, code, cat, sev in rules])
    out = runs.withColumn("blockers", items)
    hard_ones = F.filter("blockers", lambda b: b["severity"] != "warning")
    return out.withColumn("promotion_status", F.when(F.size(hard_ones) == 0, "eligible").otherwise("blocked"))


def quality_score(runs: DataFrame, variant: str, main_metric: str | None = None) -> Column:
    """Run quality. ``planner`` needs gate columns, ``dashboard`` needs blockers; ``search`` neither."""
    main = F.col(main_metric) if main_metric else F.lit(None).cast("double")
    base = falsy_zero(F.col("val_f1"), main)
    ap, f05 = falsy_zero(F.col("average_precision")), falsy_zero(F.col("val_f05"))
    ratio, _ = _rates(runs)
    off = F.least(F.abs(ratio - 1.0), F.lit(0.5))
    steep = (F.when(ratio > 3.0, F.least(F.lit(0.25), 0.03 * (ratio - 3.0)))
             .when(ratio < 0.25, F.least(F.lit(0.25), 0.03 * (0.25 / F.greatest(ratio, F.lit(1e-6))))).otherwise(0.0))
    zero = F.lit(0.0)
    if variant == "search":
        exact = floored_ratio(F.col("pred_positive_rate"), F.col("val_positive_rate"), 1e-12)
        return base + 0.25 * ap + 0.10 * f05 - F.coalesce(0.05 * F.least(F.abs(exact - 1.0), F.lit(0.5)), zero)
    if variant == "dashboard":
        return base + 0.25 * ap + 0.10 * f05 - F.coalesce(steep, zero) - 0.01 * F.size("blockers")
    if variant != "planner":
        raise ValueError(f"unknown variant {variant}")
    status = F.lower(F.coalesce("fixed_threshold_status", F.lit("")))
    fixed = F.when(F.col("fixed_threshold_status").isNull(), 0.03).when(status != "ok", 0.05).otherwise(0.0)
    gate = F.when(F.col("eligible"), F.lit(0.05)).otherwise(-0.01 * F.size("gate_warnings"))
    return base + 0.20 * ap + 0.10 * f05 - F.coalesce(0.05 * off, zero) - F.coalesce(steep, zero) - fixed + gate


def next_action(runs: DataFrame) -> Column:
    """Promotion next action of a gated run, in priority order."""

    def has(w: str) -> Column:
        return F.array_contains("gate_warnings", w)

    ok = F.col("eligible")
    return first_reason(
        (ok & ~optional(runs, "loo_ready", "boolean", False), "run_seed_repeat_leave_one_out"),
        (ok & ~optional(runs, "tile_ready", "boolean", False), "run_full_tile_validation"),
        (has("pred_positive_rate_ratio_suspicious"), "calibrate_prediction_rate"),
        (has("missing_fixed_threshold_status") | has("fixed_threshold_status_weak"), "calibrate_probability_scale"),
        (has("zero_precision_or_recall"), "repair_precision_recall"),
        (ok, "promotion_review"),
        default="continue_exploration",
    )


def failure_classes(runs: DataFrame) -> Column:
    """Ordered failure codes of a gated run."""
    pred, val = F.col("pred_positive_rate"), F.col("val_positive_rate")
    ratio = F.when(val > 0, floored_ratio(pred, val, 1e-6))
    ap, lift = F.col("average_precision"), optional(runs, "ap_prevalence_lift", "double")
    thr = F.col("best_threshold")
    text = F.concat_ws(" ", F.col("run_id").cast("string"), *[optional(runs, c, "string") for c in ("worst_fold_id", "heldout_segment", "val_npz")])
    hard = F.lit(False)
    for seg in HARD_SEGMENTS:
        hard = hard | text.contains(seg)

    def has(*names: str) -> Column:
        return F.arrays_overlap("gate_warnings", F.array(*[F.lit(n) for n in names]))

    failed = F.lower(optional(runs, "status", "string", "")).isin("oom", "timeout", "failed")
    return reasons(
        (_true(val <= 0), "zero_positive_validation"), (_true(ratio > 3.5), "calibration_high"), (_true(ratio < 0.1), "calibration_low"),
        (_not_positive(), "zero_precision_recall"),
        (_true(lift < 1.25) | _true((val > 0) & (ap <= val * 1.25)), "ap_near_prevalence"),
        (_true((thr <= 0.03) | (thr >= 0.94)), "threshold_edge"),
        (F.col("fixed_threshold_status").isNull() | _fixed_bad(), "fixed_threshold_weak"),
        (hard, "hard_fold_blocker"), (has("validation_not_held_out"), "validation_leakage"),
        (has("cron_safety_run_not_promotable", "patch_size_exceeds_guidance", "promotion_checks_ineligible") | failed, "resource_or_policy"),
    )


def failure_context(runs: DataFrame, by: list[str], n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failure counts, mean quality per family and changed paths of the newest n gated runs."""
    last = checkpointed(top_rows(runs, by, [F.col("ts").desc(), F.col("run_id").desc()], n))
    codes = last.select(*by, F.explode(failure_classes(last)).alias("failure")).groupBy(*by, "failure").agg(F.count(F.lit(1)).alias("runs"))
    scored = last.withColumn("_q", quality_score(last, "planner")).filter("changed_path <> ''")
    fam = scored.withColumn("family", mutation_family(F.col("changed_path"))).groupBy(*by, "family").agg(F.avg("_q").alias("mean_quality"))
    return codes, fam, last.filter("changed_path <> ''").select(*by, "changed_path").distinct()


# ---------------------------------------------------------------- proposals


# Planner change rules as (ordinal, model, path, default, factor, addend, low, high, digits, word, guard low, guard high,
# other path, what it must hold). The new number is value * factor + addend between low and high, with the default for an absent
# value; 0 digits stand for whole numbers, whose products are floored. A word is set as it is, "toggle" flips a boolean. A rule
# applies to values in [guard low, guard high). Another path must be "positive", "absent" or hold a word.
PLANNER_RULES = [
    (0, "torch", "training.learning_rate", "0.2", 0.6, 0.0, 0.001, 0.25, 6, None, None, None, None, None),
    (1, "torch", "training.learning_rate", "0.2", 1.5, 0.0, 0.001, 0.006, 6, None, None, None, None, None),
    (2, "torch", "training.positive_rate_loss_tolerance", "0.02", 0.5, 0.0, 0.001, 0.02, 4, None, None, None, None, None),
    (3, "torch", "training.positive_rate_loss_tolerance", "0.02", 1.5, 0.0, 0.001, 0.02, 4, None, None, None, None, None),
    (4, "torch", "training.positive_rate_loss_tolerance", "0.02", 0.0, 0.008, 0.001, 0.02, 4, None, None, None, None, None),
    (5, "torch", "training.positive_rate_loss_weight", "0.0", 1.0, -0.02, 0.0, 0.1, 4, None, None, None, None, None),
    (6, "torch", "training.positive_rate_loss_weight", "0.0", 1.0, 0.02, 0.0, 0.1, 4, None, None, None, None, None),
    (7, "torch", "training.dice_loss_weight", "0.0", 1.0, -0.15, 0.0, 0.8, 4, None, None, None, None, None),
    (8, "torch", "training.dice_loss_weight", "0.0", 1.0, 0.15, 0.0, 0.8, 4, None, None, None, None, None),
    (9, "torch", "training.focal_loss_weight", "0.0", 0.0, 0.1, 0.0, 0.5, 4, None, None, None, None, None),
    (10, "torch", "training.focal_loss_weight", "0.0", 0.0, 0.2, 0.0, 0.5, 4, None, None, None, None, None),
    (11, "torch", "training.tversky_loss_weight", None, 0.0, 0.15, 0.0, 0.5, 4, None, None, None, None, None),
    (12, "torch", "training.tversky_beta", None, 0.0, 0.8, 0.1, 0.9, 4, None, None, None, None, None),
    (13, "torch", "training.sampling_strategy", None, 0.0, 0.0, 0.0, 0.0, 4, "hard_mining", None, None, None, None),
    (14, "torch", "training.sampling_curriculum", None, 0.0, 0.0, 0.0, 0.0, 4, "warmup_then_hard", None, None, "training.sampling_curriculum", "absent"),
    (15, "torch", "evaluation.threshold", None, 0.0, 0.35, 0.05, 0.95, 4, None, None, None, None, None),
    (16, "torch", "evaluation.max_pred_positive_rate_ratio", "3.0", 0.0, 2.5, 1.5, 3.5, 4, None, 3.0, None, None, None),
    (16, "torch", "evaluation.max_pred_positive_rate_ratio", "3.0", 0.0, 3.0, 1.5, 3.5, 4, None, None, 3.0, None, None),
    (17, "torch", "evaluation.max_pred_positive_rate_ratio", "3.0", 0.0, 3.0, 1.5, 3.5, 4, None, None, 3.0, None, None),
    (17, "torch", "evaluation.max_pred_positive_rate_ratio", "3.0", 0.0, 3.5, 1.5, 3.5, 4, None, 3.0, None, None, None),
    (18, "torch", "evaluation.max_pred_positive_rate_ratio", "3.0", 0.0, 2.75, 1.5, 3.5, 4, None, None, None, None, None),
    (19, "torch", "balanced_calibration", None, 0.0, 0.0, 0.0, 0.0, 4, '{"max_pred_positive_rate_ratio":2.75,"positive_rate_loss_tolerance":0.008}', None, None, None, None),
    (20, "torch", "balanced_calibration", None, 0.0, 0.0, 0.0, 0.0, 4, '{"max_pred_positive_rate_ratio":3.0,"positive_rate_loss_weight":0.1}', None, None, None, None),
    (21, "torch", "model.base_channels", "8", 0.5, 0.0, 4.0, 16.0, 0, None, None, None, None, None),
    (22, "torch", "model.base_channels", "8", 2.0, 0.0, 4.0, 16.0, 0, None, None, None, None, None),
    (23, "torch", "training.epochs", "5", 1.0, -1.0, 2.0, 20.0, 0, None, None, None, None, None),
    (24, "torch", "training.epochs", "5", 1.0, 1.0, 2.0, 8.0, 0, None, None, None, None, None),
    (25, "torch", "training.batch_size", "8", 0.5, 0.0, 2.0, 32.0, 0, None, None, None, None, None),
    (26, "torch", "training.max_train_samples", "512", 1.0, 0.0, 1.0, 4096.0, 0, None, 1.0, None, None, None),
    (26, "torch", "training.max_train_samples", "512", 0.0, 1024.0, 1.0, 4096.0, 0, None, None, 1.0, None, None),
    (27, "torch", "training.augment_flips", "false", 0.0, 0.0, 0.0, 0.0, 4, "toggle", None, None, None, None),
    (28, "torch", "training.augment_rotation", "false", 0.0, 0.0, 0.0, 0.0, 4, "toggle", None, None, None, None),
    (29, "torch", "evaluation.tta_flips", "false", 0.0, 0.0, 0.0, 0.0, 4, "toggle", None, None, None, None),
    (30, "torch", "training.seed", "1337", 1.0, 17.0, 0.0, 1e18, 0, None, None, None, None, None),
    (31, "torch", "training.focal_gamma", None, 0.0, 2.0, 0.5, 5.0, 4, None, None, None, "training.focal_loss_weight", "positive"),
    (32, "torch", "training.focal_gamma", None, 0.0, 3.0, 0.5, 5.0, 4, None, None, None, "training.focal_loss_weight", "positive"),
    (33, "torch", "training.hard_negative_fraction", None, 0.0, 0.85, 0.1, 0.9, 4, None, None, None, "training.sampling_strategy", "hard_mining"),
    (34, "torch", "dataset.z_offsets", None, 0.0, 0.0, 0.0, 0.0, 4, "[-4,0,4]", None, None, None, None),
    (35, "torch", "dataset.z_offsets", None, 0.0, 0.0, 0.0, 0.0, 4, "[-6,-3,0,3,6]", None, None, None, None),
    (0, "numpy", "training.pos_weight", "2.0", 0.5, 0.0, 0.25, 25.0, 4, None, None, None, None, None),
    (1, "numpy", "training.pos_weight", "2.0", 1.25, 0.0, 0.25, 8.0, 4, None, None, None, None, None),
    (2, "numpy", "training.learning_rate", "0.2", 0.6, 0.0, 0.005, 0.25, 5, None, None, None, None, None),
    (3, "numpy", "training.learning_rate", "0.2", 1.6, 0.0, 0.001, 0.25, 5, None, None, None, None, None),
    (4, "numpy", "training.weight_decay", "0.0", 0.5, 0.0, 0.0, 0.05, 7, None, None, None, None, None),
    (5, "numpy", "training.weight_decay", "0.0", 0.0, 0.0003, 0.0000001, 0.05, 7, None, None, 1e-300, None, None),
    (5, "numpy", "training.weight_decay", "0.0", 3.0, 0.0, 0.0000001, 0.05, 7, None, 1e-300, None, None, None),
    (6, "numpy", "training.epochs", "5", 1.0, -2.0, 2.0, 20.0, 0, None, None, None, None, None),
    (7, "numpy", "training.epochs", "5", 1.0, 3.0, 2.0, 20.0, 0, None, None, None, None, None),
    (8, "numpy", "model.depth", "2", 0.0, 2.0, 1.0, 3.0, 0, None, None, 2.0, None, None),
    (8, "numpy", "model.depth", "2", 0.0, 1.0, 1.0, 3.0, 0, None, 2.0, 3.0, None, None),
    (8, "numpy", "model.depth", "2", 0.0, 2.0, 1.0, 3.0, 0, None, 3.0, None, None, None),
    (9, "numpy", "model.depth", "2", 0.0, 3.0, 1.0, 3.0, 0, None, None, 3.0, None, None),
    (9, "numpy", "model.depth", "2", 0.0, 1.0, 1.0, 3.0, 0, None, 3.0, None, None, None),
    (10, "numpy", "training.seed", "1337", 1.0, 17.0, 0.0, 1e18, 0, None, None, None, None, None),
    (11, "numpy", "model.name", "tiny_numpy_ink_logreg", 0.0, 0.0, 0.0, 0.0, 4, "tiny_numpy_mlp", None, None, None, None),
    (12, "mlp", "model.hidden_units", "24", 0.5, 0.0, 8.0, 96.0, 0, None, None, None, None, None),
    (13, "mlp", "model.hidden_units", "24", 2.0, 0.0, 8.0, 96.0, 0, None, None, None, None, None),
    (14, "mlp", "training.max_train_pixels", "600000", 2.0, 0.0, 100000.0, 1200000.0, 0, None, None, None, None, None),
    (15, "mlp", "training.max_train_pixels", "600000", 0.5, 0.0, 100000.0, 1200000.0, 0, None, None, None, None, None),
    (16, "mlp", "training.sample_positive_fraction", None, 0.0, 0.25, 0.05, 0.95, 4, None, None, None, "training.sample_positive_fraction", "not 0.25"),
    (16, "mlp", "training.sample_positive_fraction", None, 0.0, 0.5, 0.05, 0.95, 4, None, None, None, "training.sample_positive_fraction", "0.25"),
]

# Paths that a change sets besides its own, and those that it fills where they are absent.
ALSO_SET = {
    '{"max_pred_positive_rate_ratio":2.75,"positive_rate_loss_tolerance":0.008}': {"evaluation.max_pred_positive_rate_ratio": "2.75", "training.positive_rate_loss_tolerance": "0.008"},
    '{"max_pred_positive_rate_ratio":3.0,"positive_rate_loss_weight":0.1}': {"evaluation.max_pred_positive_rate_ratio": "3.0", "training.positive_rate_loss_weight": "0.1"},
    "training.tversky_beta": {"training.tversky_alpha": "0.2"},
}
ALSO_FILLED = {
    "hard_mining": {"training.hard_negative_fraction": "0.5"},
    "training.tversky_loss_weight": {"training.tversky_alpha": "0.3", "training.tversky_beta": "0.7"},
    "training.tversky_beta": {"training.tversky_loss_weight": "0.15"},
}


def planner_rules(spark) -> DataFrame:
    """The rules as a table; its size is fixed."""
    extra = [(ALSO_SET.get(r[9], ALSO_SET.get(r[2], {})), ALSO_FILLED.get(r[9], ALSO_FILLED.get(r[2], {}))) for r in PLANNER_RULES]
    return spark.createDataFrame(
        [(*r, *e) for r, e in zip(PLANNER_RULES, extra)],
        "ordinal int, model string, path string, default string, factor double, addend double, floor double, ceiling double, digits int, word string, "
        "guard_low double, guard_high double, other string, holds string, sets map<string,string>, fills map<string,string>")


def _number() -> Column:
    """Numeric value of a leaf; an automatic weight counts as its default of 2."""
    return F.coalesce(number_of(F.col("value")), F.when(F.lower("value") == "auto", 2.0))


def _proposed() -> Column:
    number = _number()
    step = F.when(F.col("factor") == 0, F.col("addend")).otherwise(number * F.col("factor") + F.col("addend"))
    moved = F.when(step.isNotNull(), F.round(F.least(F.greatest(step, F.col("floor")), F.col("ceiling")), 7))
    flipped = F.when(F.lower("value") == "true", "false").otherwise("true")
    return F.when(F.col("word") == "toggle", flipped).otherwise(F.coalesce(F.col("word"), moved.cast("string")))


def _changed() -> Column:
    new, old = F.col("proposed"), F.col("value")
    return new.isNotNull() & ~F.coalesce(number_of(new) == number_of(old), new == old)


def _leaf(path: Column | str) -> Column:
    return F.try_element_at("leaves", F.lit(path) if isinstance(path, str) else path)


def canonical(text: Column, path: Column | str) -> Column:
    """Text of a leaf as the search signature holds it; depth above 3 counts as 3."""
    return _canonical(text, number_of(text), F.lit(path) if isinstance(path, str) else path)


def _canonical(text: Column, number: Column, path: Column) -> Column:
    """``canonical`` of a text whose number is known."""
    number = F.round(number, 10)
    return F.coalesce(F.when((path == "model.depth") & (number > 3), "3.0"), number.cast("string"), text)


def searched_leaves() -> Column:
    """Canonical texts of the searched paths of the configuration in ``leaves``, absent ones by their default."""
    return F.array(*[F.coalesce(canonical(_leaf(p), p), canonical(F.lit(d), p)) for p, d in SEARCH_DEFAULTS.items()])


def _signature(texts: Column) -> Column:
    return F.sha2(F.array_join(texts, "|"), 256)


def changed_signature(path: Column, new: Column, sets: Column, fills: Column) -> Column:
    """Search signature of the configuration in ``leaves`` after a change; ``searched`` holds its ``searched_leaves``.

    ``new`` and the values of ``sets`` and ``fills`` are canonical texts. A change of one path replaces one text; only changes that set
    or fill others look at every path.
    """
    names, texts = F.array(*[F.lit(p) for p in SEARCH_DEFAULTS]), F.col("searched")
    place, n = F.array_position(names, path).cast("int"), len(SEARCH_DEFAULTS)
    one = F.when(place == 0, texts).otherwise(F.concat(F.slice(texts, 1, place - 1), F.array(new), F.slice(texts, place + 1, n)))

    def held(p: Column, i: Column) -> Column:
        old = F.get(texts, i)
        return F.when(p == path, new).otherwise(F.coalesce(F.try_element_at(sets, p), F.when(_leaf(p).isNotNull(), old), F.try_element_at(fills, p), old))

    return _signature(F.when((F.size(sets) == 0) & (F.size(fills) == 0), one).otherwise(F.transform(names, held)))


def base_documents(bases: DataFrame, by: list[str]) -> DataFrame:
    """One row per base with its leaves as a map, from flattened configurations (base_id, model_name, path, value as text)."""
    found = F.map_from_entries(F.collect_list(F.when(F.col("path") != "model.name", F.struct("path", "value"))))
    return bases.groupBy(*by, "base_id", "model_name").agg(F.map_concat(found, F.create_map(F.lit("model.name"), "model_name")).alias("leaves"))


def wide_documents(bases: DataFrame, by: list[str], leaves: dict[str, Column]) -> DataFrame:
    """``base_documents`` of bases that hold their leaves as columns: nothing is gathered."""
    pairs = [x for path, value in leaves.items() for x in (F.lit(path), value.cast("string"))]
    return bases.select(*by, "base_id", "model_name", F.create_map(*pairs, F.lit("model.name"), F.col("model_name")).alias("leaves"))


def _by_configuration(docs: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per configuration of a group, with the configuration and its hash.

    A configuration counts as its text; two texts of one configuration are only worked out twice.
    """
    each = docs.groupBy(*keys, _configuration().alias("_text")).agg(*aggregates)
    held = F.from_json("_text", "model_name string, leaves map<string,string>")
    rest = [c for c in each.columns if c != "_text"]
    return each.select(*rest, F.sha2("_text", 256).alias("config"), held.alias("_held")).select(*rest, "config", "_held.*")


def _configuration() -> Column:
    return F.to_json(F.struct("model_name", "leaves"))


def configurations(docs: DataFrame, by: list[str]) -> DataFrame:
    """One row per configuration of a group with the number of bases that hold it, written once; ``docs`` may be ``leading_bases``."""
    return written(_by_configuration(docs, by, (F.sum("bases") if "bases" in docs.columns else F.count(F.lit(1))).alias("bases")))


def leading_bases(docs: DataFrame, by: list[str], like: list[str]) -> DataFrame:
    """Of the bases of a group with one configuration and equal columns ``like`` the one with the lowest id, and how many they are.

    Written once. The candidates of the others have the same signatures and scores and come after its own, so a selection never takes them.
    """
    return written(_by_configuration(docs, [*by, *like], F.min("base_id").alias("base_id"), F.count(F.lit(1)).alias("bases")))


def search_signatures(docs: DataFrame, by: list[str]) -> DataFrame:
    """Signatures of the configurations as they are (a row per base or per configuration), for the novelty test."""
    return docs.select(*by, _signature(searched_leaves()).alias("candidate_signature")).distinct()


def expand_candidates(docs: DataFrame, rules: DataFrame, by: list[str], tested: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """One change per candidate of every base (``base_documents``), with the signature of the changed configuration.

    No-ops, repeated changes and changes whose signature the group has tested are left out. Candidates depend on the configuration
    alone: they are worked out once per configuration (``configs``: the ``configurations`` of these or more bases) and then meet the
    bases that hold it; where few bases share one, each base is worked on by itself.
    """
    configs = configurations(docs, by) if configs is None else configs
    known = checkpointed(tested.select(*by, "candidate_signature").distinct())
    few = is_few(known)

    def novel(out: DataFrame) -> DataFrame:
        return out.join(F.broadcast(known) if few else known, [*by, "candidate_signature"], "left_anti")

    size = configs.agg(F.countDistinct("config").alias("n"), F.sum("bases").alias("bases")).first()
    names = [*by, "base_id", "model_name", "ordinal", "model", "path", "value", "proposed", "candidate_signature"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size["n"] * 2 > (size["bases"] or 0):
        return novel(_changes(docs.repartition(parts, *by, "base_id"), rules, [*by, "base_id"])).select(*names)
    once = configs.select("config", "model_name", "leaves").repartition(parts, "config").dropDuplicates(["config"])
    of_groups = novel(_changes(once, rules, ["config"]).join(configs.select(*by, "config"), "config"))
    held_by = docs.select(*by, "base_id", F.col("config") if "config" in docs.columns else F.sha2(_configuration(), 256).alias("config"))
    # sizes of both sides are far from what a plan estimates; none is sent whole
    return null_safe_join(held_by.hint("merge"), of_groups, [*by, "config"]).select(*names)


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """The table with columns that later steps take as they are.

    The optimiser copies an expression to all places that use it, filters above all, and code that grows so large is not compiled.
    It does not look into a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _told(rules: DataFrame) -> DataFrame:
    """The rules with the numbers and canonical texts of their own words."""
    default = F.col("default")
    return rules.withColumns({
        "default_number": F.coalesce(number_of(default), F.when(F.lower(default) == "auto", 2.0)), "word_number": number_of(F.col("word")),
        "holds_number": number_of(F.col("holds")), "set_texts": F.transform_values("sets", lambda k, v: canonical(v, k)),
        "fill_texts": F.transform_values("fills", lambda k, v: canonical(v, k))})


def _changes(docs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of each document by the rules, without no-ops and repeated ones.

    Rules meet documents by the kind of model, so that an absent path counts with its default.
    """
    name = F.col("model_name")
    kinds = F.when(name.contains("torch"), F.array(F.lit("torch"))).when(name == "tiny_numpy_mlp", F.array(F.lit("numpy"), F.lit("mlp"))).otherwise(F.array(F.lit("numpy")))
    numbers = F.transform_values("leaves", lambda k, v: number_of(v))
    # the rules are a table of fixed size
    each = docs.withColumns({"searched": searched_leaves(), "numbers": numbers}).withColumn("model", F.explode(kinds)).join(F.broadcast(_told(rules)), "model")
    real, real_number, other, holds, whole = _leaf(F.col("path")), F.try_element_at("numbers", F.col("path")), F.col("other"), F.col("holds"), F.col("digits") == 0
    each = worked_out(each, real=real, real_number=real_number, other_text=_leaf(other), other_number=F.try_element_at("numbers", other), number=F.when(
        real.isNull(), F.col("default_number")).otherwise(F.coalesce(real_number, F.when(F.lower(real) == "auto", 2.0))))
    number, other, other_number = F.col("number"), F.col("other_text"), F.col("other_number")
    met = (F.when(holds.isNull(), True).when(holds == "positive", other_number > 0).when(holds == "absent", F.coalesce(other, F.lit("")).isin("", "null"))
           .when(holds == "not 0.25", ~F.coalesce(other_number == 0.25, F.lit(False))).otherwise(F.coalesce(other_number == F.col("holds_number"), other == holds)))
    guarded = F.coalesce(number >= F.col("guard_low"), F.col("guard_low").isNull()) & F.coalesce(number < F.col("guard_high"), F.col("guard_high").isNull())
    product = F.when(F.col("factor") == 0, 0.0).otherwise(F.when(whole, F.floor(number * F.col("factor"))).otherwise(number * F.col("factor")))
    moved = F.least(F.greatest(product + F.col("addend"), F.col("floor")), F.col("ceiling"))
    out = worked_out(each.filter(F.coalesce(met, F.lit(False)) & guarded), moved=moved, long=F.when(whole, moved.cast("long")))
    short = F.round(F.expr("CASE digits WHEN 4 THEN round(moved, 4) WHEN 5 THEN round(moved, 5) WHEN 6 THEN round(moved, 6) ELSE round(moved, 7) END"), 7)
    out = worked_out(out, short=F.when(whole, F.col("long").cast("double")).otherwise(short))
    flipped = F.when(F.lower(F.coalesce("real", "default")) == "true", "false").otherwise("true")
    text = F.when(whole, F.col("long").cast("string")).otherwise(F.col("short").cast("string"))
    out = worked_out(out, proposed=F.when(F.col("word") == "toggle", flipped).otherwise(F.coalesce("word", text)),
                     proposed_number=F.when(F.col("word").isNotNull(), F.col("word_number")).otherwise(F.col("short")))
    same = F.coalesce(F.col("proposed_number") == F.col("real_number"), F.col("proposed") == F.col("real"), F.lit(False))
    in_place = (F.size("sets") > 0) & F.col("word").isNotNull() & F.forall(F.map_entries("sets"), lambda e: F.coalesce(
        F.try_element_at("numbers", e["key"]) == number_of(e["value"]), F.lit(False)))
    out = worked_out(out.filter(F.col("proposed").isNotNull() & ~same & ~in_place), new=_canonical(F.col("proposed"), F.col("proposed_number"), F.col("path")))
    out = out.select(*keys, "model_name", "ordinal", "model", "path", F.col("real").alias("value"), "proposed",
                     changed_signature(F.col("path"), F.col("new"), F.col("set_texts"), F.col("fill_texts")).alias("candidate_signature"))
    # the keys include those that the documents are partitioned by, so the candidates of a document are not shuffled again
    return top_rows(out, [*keys, "model_name", "path", "proposed"], [F.col("ordinal")], 1, "_repeat").drop("_repeat")


# Relevance of a mutation family to a hard fold near prevalence.
HARD_FOLD_RELEVANCE = {"data_sampling": 2.0, "hard_fold_sampling_calibration": 2.2, "z_context": 1.5, "loss_calibration": 1.2,
                       "balanced_calibration": 1.2, "inference_calibration": 0.8, "model_family": -0.4, "replication": -0.6}


def score_candidates(candidates: DataFrame, by: list[str], counts: DataFrame, families: DataFrame, changed: DataFrame) -> DataFrame:
    """Seven additive components and their reasons; context tables are joined per group."""
    def flag(*codes: str) -> Column:
        return F.max(F.col("failure").isin(list(codes)))

    ctx = counts.groupBy(*by).agg(
        flag("hard_fold_low_ap_near_prevalence").alias("_hard_ap"), flag("hard_fold_blocker").alias("_hard"),
        flag("calibration_high", "calibration_low", "fixed_threshold_weak").alias("_cal"),
        flag("ap_near_prevalence").alias("_near"), F.lit(True).alias("_any"))
    c = candidates.withColumn("family", mutation_family(F.col("path")))
    c = bounded_join(c, checkpointed(ctx), by, "left").fillna(False, ["_hard_ap", "_hard", "_cal", "_near", "_any"])
    c = bounded_join(c, checkpointed(families.withColumnRenamed("mean_quality", "_prior")), [*by, "family"], "left")
    c = bounded_join(c, checkpointed(changed.select(*by, F.col("changed_path").alias("path"), F.lit(True).alias("_dup"))), [*by, "path"], "left")
    fam = F.col("family")
    cost = F.when(F.col("cost_tier") == "cheap", 1.0).when(F.col("cost_tier") == "normal", 0.4).otherwise(-1.0)
    relevant = fam.isin("loss_calibration", "data_sampling", "z_context", "balanced_calibration")
    calibrating = fam.isin("loss_calibration", "balanced_calibration", "inference_calibration")
    hard = F.when(F.col("_hard_ap"), F.coalesce(lookup(HARD_FOLD_RELEVANCE, fam), F.lit(-0.2))).when(
        F.col("_hard"), F.when(relevant, 1.5).otherwise(-0.2))
    parts = {
        "cost": cost,
        "hard_fold_relevance": hard,
        "calibration_relevance": F.when(F.col("_cal"), F.when(calibrating, 1.2).otherwise(0.0)),
        "threshold_only_penalty": F.when(F.col("_near") & (F.col("path") == "evaluation.threshold"), -2.5),
        "prior_family_performance": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_prior"))),
        "near_duplicate_penalty": F.when(F.col("_dup"), -1.0).when(F.col("_prior").isNotNull(), -0.25),
        "low_value_penalty": F.when((fam == "replication") & F.col("_any"), -0.4),
    }
    total = F.lit(0.0)
    for p in parts.values():
        total = total + F.coalesce(p, F.lit(0.0))
    tag = F.when(F.col("_hard_ap"), "hard_fold_low_ap").otherwise("hard_fold")
    why = reasons(
        (F.lit(True), F.concat(F.lit("cost_"), F.col("cost_tier"))),
        (_true(hard > 0), F.concat(tag, F.lit("_relevant"))),
        (_true(hard <= 0), F.concat(F.lit("weak_"), tag, F.lit("_relevance"))),
        (F.col("_cal") & calibrating, "calibration_relevant"),
        (parts["threshold_only_penalty"].isNotNull(), "threshold_only_low_value_when_ap_near_prevalence"),
        (F.col("_prior").isNotNull(), "prior_family_performance"),
        (F.col("_dup").isNotNull(), "near_duplicate_changed_path"),
        (F.col("_dup").isNull() & F.col("_prior").isNotNull(), "recent_family_penalty"),
        (parts["low_value_penalty"].isNotNull(), "replication_low_value_for_active_failures"),
    )
    out = c.withColumn("score", F.round(total, 6)).withColumn("score_reasons", why)
    return out.drop("_hard_ap", "_hard", "_cal", "_near", "_any", "_prior", "_dup")


def score_by_place(candidates: DataFrame, by: list[str], groups: DataFrame, paths: DataFrame, tiers: list[str],
                   counts: DataFrame, families: DataFrame, changed: DataFrame) -> DataFrame:
    """``score_candidates`` of candidates whose paths and cost tiers are known beforehand.

    A score depends on group, path and cost tier alone, so it is worked out once for each of them and looked up.
    """
    tier = F.explode(F.array(*[F.lit(t) for t in tiers]))
    places = groups.select(*by).distinct().crossJoin(F.broadcast(paths.select("path").distinct())).withColumn("cost_tier", tier)
    scores = checkpointed(score_candidates(places, by, counts, families, changed))
    return bounded_join(candidates, scores, [*by, "path", "cost_tier"], "left")


def select_proposals(scored: DataFrame, by: list[str], k: int, families: list[str] | None = None, signature: str = "candidate_signature") -> DataFrame:
    """Top k by (score, cost, ordinal); unique signatures, and one per family when families are required."""
    order = [F.col("score").desc(), cost_rank(F.col("cost_tier")), F.col("ordinal")]
    rows = scored if families is None else scored.filter(F.col("family").isin(families))
    if families is not None:
        rows = top_rows(rows, [*by, "family"], order, 1, "_family_rank").drop("_family_rank")
    rows = top_rows(rows, [*by, signature], order, 1, "_signature_rank").drop("_signature_rank")
    return top_rows(rows, by, order, k, "proposal_rank")


# ---------------------------------------------------------------- champions and decisions


def strategy_phase(runs: DataFrame, by: list[str], window: int = 12, min_delta: float = 0.005) -> DataFrame:
    """Plateau and phase of each group's gated torch runs."""
    runs, by = grouped(runs, by)
    q = runs.filter(F.col("model_name").contains("torch")).withColumn("_q", quality_score(runs, "planner"))
    q = q.withColumn("_next", next_action(q))
    newest_rows = top_rows(q, by, [F.col("ts").desc(), F.col("run_id").desc()], window)
    head = newest_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("_q").alias("recent_best"), F.min(newest()).alias("_cut"),
        F.max_by(F.struct("run_id", "_next"), F.struct("_q", "ts", "run_id")).alias("_best"))
    older = null_safe_join(q.select(*by, newest().alias("_key"), "_q"), head.select(*by, "_cut"), by).filter(F.col("_key") < F.col("_cut"))
    tail = older.groupBy(*by).agg(F.max("_q").alias("_old"))
    out = null_safe_join(head, tail, by, "left").withColumn("previous_best", F.coalesce("_old", "recent_best"))
    full = F.col("n") >= window
    plateau = full & (F.col("recent_best") <= F.col("previous_best") + min_delta)
    act = F.when(full, F.col("_best._next")).otherwise("continue_exploration")
    phase = F.when(plateau & (act != "continue_exploration"), "promote").when(plateau, "diversify").otherwise("exploit")
    return out.select(*by, "recent_best", "previous_best", plateau.alias("plateau"), phase.alias("phase"), act.alias("next_action"),
                      F.when(full, F.col("_best.run_id")).alias("candidate_run_id"))


def recent_range(runs: DataFrame, by: list[str], metric: str, window: int = 5, epsilon: float = 0.002) -> DataFrame:
    """Range of the metric over the newest runs; a plateau needs a full window within epsilon."""
    last = top_rows(runs, by, [F.col("ts").desc(), F.col("run_id").desc()], window)
    agg = last.groupBy(*by).agg(F.count(metric).alias("window_runs"), (F.max(metric) - F.min(metric)).alias("_d"))
    delta = F.when(F.col("window_runs") >= 2, F.col("_d"))
    return agg.select(*by, "window_runs", delta.alias("metric_delta"),
                      _true((F.col("window_runs") >= window) & (delta <= epsilon)).alias("plateau"))


def staleness(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Runs newer than the peak run."""
    sign = -metric_direction(metric)
    peak = runs.groupBy(*by).agg(F.max_by(newest(), F.struct(F.col(metric) * sign, "ts", "run_id")).alias("_peak"))
    j = null_safe_join(runs.select(*by, newest().alias("_key")), peak, by)
    return j.groupBy(*by).agg(F.max("_peak.run_id").alias("peak_run_id"), F.count_if(F.col("_key") > F.col("_peak")).alias("stale_runs_since_peak"))


def best_base(runs: DataFrame, by: list[str], metric: str, baseline: dict[str, object]) -> DataFrame:
    """Best run within the baseline's scope values."""
    rows = runs.filter(F.col(metric).isNotNull())
    for name, value in baseline.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    sign = -metric_direction(metric)
    return rows.groupBy(*by).agg(F.max_by(F.struct("run_id", metric), F.struct(F.col(metric) * sign, "ts", "run_id")).alias("r")).select(*by, "r.*")


def ranked_bases(runs: DataFrame, by: list[str], k: int, signature: str = "signature") -> DataFrame:
    """Recent torch bases of robust scopes, newest per signature, eligible first."""
    scope = F.col("research_scope")
    torch = runs.filter(F.col("model_name").contains("torch") & is_robust(F.lit("torch"), scope, scope))
    q = latest_by(torch.withColumn("_q", quality_score(torch, "planner")), [*by, signature], ["ts", "run_id"])
    order = [F.col("eligible").desc(), scope_priority(scope, scope), F.col("_q").desc(), F.col("run_id")]
    out = top_rows(q, by, order, k, "base_rank")
    kind = F.when(F.col("eligible"), "promotion-eligible recent base").otherwise("diagnostic recent base")
    return out.select(*by, "base_rank", "run_id", signature, kind.alias("base_kind"), F.col("_q").alias("quality"))


def manual_candidate(runs: DataFrame, by: list[str], failed_loo: DataFrame | None = None) -> DataFrame:
    """Best run that only misses leave-one-out or whole-map evidence; runs linked to a failed LOO are out."""
    ratio, _ = _rates(runs)
    act = next_action(runs)
    rows = runs.filter(
        F.col("model_name").contains("torch") & _multi(F.col("research_scope")) & (F.lower("fixed_threshold_status") == "ok")
        & F.col("val_f1").isNotNull() & F.col("average_precision").isNotNull() & ~_not_positive()
        & F.coalesce(ratio.between(0.1, 3.5), F.lit(True)) & optional(runs, "promotable", "boolean", True)
        & act.isin("run_seed_repeat_leave_one_out", "run_full_tile_validation"))
    if failed_loo is not None:
        rows = rows.join(failed_loo.select("run_id"), "run_id", "left_anti")
    rows = rows.withColumn("_q", quality_score(rows, "planner"))
    return rows.groupBy(*by).agg(F.max_by(F.struct("run_id", F.col("_q").alias("quality")), F.struct("_q", "ts", "run_id")).alias("r")).select(*by, "r.*")


def champions(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Peak, robust and promotion-eligible run per group; needs blockers()."""
    sign = -metric_direction(metric)
    scope = F.col("research_scope")
    robust = is_robust(F.col("model_name"), scope, scope)
    eligible = F.col("promotion_status") == "eligible"
    q = runs.withColumn("_q", quality_score(runs, "dashboard", metric))
    rank = F.struct(-validation_priority(F.col("validation_mode")), -scope_priority(scope, scope), F.col(metric) * sign, F.col("ts"), F.col("run_id"))

    def pick(cond: Column | None, key: Column) -> Column:
        rid = F.col("run_id") if cond is None else F.when(cond, F.col("run_id"))
        return F.max_by(rid, key if cond is None else F.when(cond, key))

    return q.groupBy(*by).agg(
        pick(None, F.struct(F.col(metric) * sign, "ts", "run_id")).alias("peak_score"),
        pick(robust, rank).alias("robust_candidate"),
        pick(eligible, F.struct("_q", "ts", "run_id")).alias("promotion_eligible"),
    )


def champion_classes(champs: DataFrame, by: list[str]) -> DataFrame:
    """(run, classes) rows; one run may hold several classes."""
    names = ["peak_score", "robust_candidate", "promotion_eligible"]
    long = champs.select(*by, F.posexplode(F.array(*names)).alias("pos", "run_id")).filter("run_id IS NOT NULL")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", label.alias("l")))), lambda s: s["l"])
    return long.groupBy(*by, "run_id").agg(F.array_join(ordered, ",").alias("champion_class"))


def validation_matrix(runs: DataFrame, metric: str) -> DataFrame:
    sign = -metric_direction(metric)
    best = F.max_by(F.struct("run_id", "validation_mode", metric), F.struct(F.col(metric) * sign, "ts", "run_id"))
    return runs.groupBy("train_segment", "val_segment").agg(F.count(F.lit(1)).alias("run_count"), best.alias("b")).select(
        "train_segment", "val_segment", "run_count", F.col("b.run_id").alias("best_run_id"),
        F.col("b.validation_mode").alias("validation_mode"), F.col(f"b.{metric}").alias("best_metric"))


def leaderboard(runs: DataFrame, tiles: DataFrame | None, by: list[str], k: int) -> DataFrame:
    """Ranked runs: quality of the best map (else of the run), eligibility and coverage bonuses."""
    from evalgate.operators.quality import metrics_verdict

    scored = metrics_verdict(runs)
    if tiles is not None:
        t = tiles.groupBy("run_id").agg(F.count(F.lit(1)).alias("_tiles"), F.max("quality_score").alias("_tile_score"))
        scored = scored.join(t, "run_id", "left")
    else:
        scored = scored.withColumns({"_tiles": F.lit(0), "_tile_score": F.lit(None).cast("double")})
    coverage = F.coalesce("_tiles", F.lit(0))
    score = F.coalesce("_tile_score", "quality_score")
    key = F.round(score + F.when(F.col("promotion_status") == "eligible", 0.15).otherwise(0.0) + 0.05 * F.least(coverage, F.lit(3)), 12)
    rows = scored.withColumn("_key", key).withColumn("_score", score).withColumn("coverage", coverage)
    order = [F.col("_key").desc(), falsy_zero(F.col("val_f1")).desc(), falsy_zero(F.col("average_precision")).desc(), F.col("run_id").desc()]
    return top_rows(rows, by, order, k).select(*by, "rank", "run_id", F.col("_score").alias("quality_score"), "coverage", "val_f1",
                                               "average_precision", "promotion_status")


def metric_trend(runs: DataFrame, by: list[str], k: int) -> DataFrame:
    """Newest k runs per group with their position from the oldest."""
    last = top_rows(runs, by, [F.col("ts").desc(), F.col("run_id").desc()], k, "age")
    pos = F.row_number().over(W.partitionBy(*by).orderBy("ts", "run_id"))
    return last.select(*by, pos.alias("position"), "run_id", "ts", "val_f1", "average_precision")


def gate_criteria(champs: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Six criteria rows of each group's target run (eligible champion, else robust one)."""
    scope = F.col("research_scope")
    flags = runs.select(
        F.col("run_id").alias("target"), F.col("validation_mode").isin(HELD_OUT_MODES).alias("heldout"),
        optional(runs, "loo_ready", "boolean", False).alias("loo"), optional(runs, "tile_ready", "boolean", False).alias("tile"),
        optional(runs, "weak_tile_status", "string", "not_applicable").isin("done", "not_applicable").alias("weak"),
        (F.col("promotion_status") == "eligible").alias("clear"), is_robust(F.col("model_name"), scope, scope).alias("robust"))
    base = champs.withColumn("target", F.coalesce("promotion_eligible", "robust_candidate")).join(flags, "target", "left")

    def crit(i: int, name: str, ok: Column, bad: str = "warning") -> Column:
        return F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("criterion"), F.when(_true(ok), "done").otherwise(bad).alias("state"))

    items = F.array(crit(0, "robust_candidate", F.col("robust_candidate").isNotNull(), "pending"), crit(1, "heldout_validation", F.col("heldout")),
                    crit(2, "seed_repeat_loo", F.col("loo")), crit(3, "full_tile", F.col("tile")), crit(4, "weak_fold_full_tile", F.col("weak")),
                    crit(5, "promotion_clear", F.col("clear")))
    ready = F.forall(items, lambda c: c["state"] == "done")
    return base.select(*by, "target", ready.alias("ready"), F.inline(items))


def blocker_counts(runs: DataFrame, by: list[str]) -> DataFrame:
    # an outer explode keeps the optimizer from deriving filters out of the large blocker expression
    codes = runs.select(*by, F.explode_outer("blockers.code").alias("code"))
    return codes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("runs")).filter("code IS NOT NULL")


def top_blockers(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    return top_rows(counts, by, [F.col("runs").desc(), F.col("code")], k)


def decision(champs: DataFrame, criteria: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Status and next step per group."""
    state = criteria.groupBy(*by).agg(
        F.max(F.when(F.col("criterion") == "seed_repeat_loo", F.col("state"))).alias("loo"),
        F.max(F.when(F.col("criterion") == "full_tile", F.col("state"))).alias("tile"), F.first("ready").alias("ready"))
    top = runs.select(F.col("run_id").alias("robust_candidate"), F.get("blockers", F.lit(0))["code"].alias("top_blocker"))
    j = null_safe_join(champs, state, by, "left").join(top, "robust_candidate", "left")
    has_eligible, has_robust = F.col("promotion_eligible").isNotNull(), F.col("robust_candidate").isNotNull()
    status = first_reason((has_eligible, "promotion_eligible"), (has_robust, "blocked"),
                          (F.col("peak_score").isNotNull(), "needs_robust_candidate"), default="no_runs")
    act = first_reason((has_eligible, "promote_or_verify"), (has_robust & (F.col("loo") != "done"), "run_seed_repeat_leave_one_out"),
                       (has_robust & (F.col("tile") != "done"), "run_full_tile_inference"), (has_robust, "resolve_blockers"),
                       (F.col("peak_score").isNotNull(), "convert_peak_run"), default="run_held_out_validation")
    return j.select(*by, status.alias("status"), act.alias("next_action"), "ready", F.when(~has_eligible, F.col("top_blocker")).alias("top_blocker"))


# ---------------------------------------------------------------- evidence links


def link_loo(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Newest LOO summary of each run: by listed run id first, else equal normalised config and fold-map tail.

    ``summaries`` has summary_id, ts, run_ids, loo_signature, fold_map; ``runs`` has run_id,
    loo_signature, fold_map. Both links are equi-joins; by configuration only the newest summary of each
    fold map and each fold map of the runs meet.
    """
    point, order = F.struct("summary_id", "summary_ts", "promotion_ready"), F.struct("summary_ts", "summary_id")
    cols = ["summary_id", F.col("ts").alias("summary_ts"), "promotion_ready"]
    by_id = runs.select("run_id").join(summaries.select(F.explode("run_ids").alias("run_id"), *cols), "run_id").withColumn("link", F.lit("run_id"))
    kinds = summaries.select("loo_signature", F.col("fold_map").alias("_fm"), *cols).groupBy("loo_signature", "_fm").agg(F.max_by(point, order).alias("s"))
    kinds = kinds.select("loo_signature", "_fm", "s.*", _tail(F.col("_fm")).alias("_tail"))
    wanted = runs.select("loo_signature", "fold_map").distinct().withColumn("_own", _tail(F.col("fold_map")))

    def newest_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(point, order).alias("s")).select(*keys, "s.*")

    # a missing map fits every map; of two maps one must end with the other: equi-joins on the ends of the longer one
    ends = _ends(wanted.filter("_own <> ''"), "_own", kinds, "_tail").withColumnRenamed("_end", "_tail").join(
        newest_of(kinds.filter("_tail <> ''"), ["loo_signature", "_tail"]), ["loo_signature", "_tail"])
    longer = newest_of(_ends(kinds.filter("_tail <> ''"), "_tail", wanted, "_own").withColumnRenamed("_end", "_own"), ["loo_signature", "_own"])
    found = [wanted.filter("coalesce(fold_map, '') = ''").join(newest_of(kinds, ["loo_signature"]), "loo_signature"),
             wanted.join(newest_of(kinds.filter("coalesce(_fm, '') = ''"), ["loo_signature"]), "loo_signature"),
             ends, wanted.join(longer, ["loo_signature", "_own"])]
    shared = ["loo_signature", "fold_map", "summary_id", "summary_ts", "promotion_ready"]
    fits = newest_of(reduce(DataFrame.unionByName, [f.select(*shared) for f in found]), ["loo_signature", "fold_map"])
    by_cfg = null_safe_join(runs.select("run_id", "loo_signature", "fold_map"), fits, ["loo_signature", "fold_map"]).select(
        "run_id", "summary_id", "summary_ts", "promotion_ready").withColumn("link", F.lit("config"))
    both = by_id.unionByName(by_cfg)
    pick = F.max_by(F.struct("summary_id", "link", "promotion_ready"), F.struct("summary_ts", "summary_id", F.col("link") == "run_id"))
    return both.groupBy("run_id").agg(pick.alias("s")).select("run_id", "s.*")


def _tail(path: Column) -> Column:
    """A path without leading ``./``; NULL for a missing or empty one."""
    return F.when(path != "", F.regexp_replace(path, r"^(\./)+", ""))


def _ends(rows: DataFrame, path: str, others: DataFrame, other: str) -> DataFrame:
    """Rows with those ends of a path that are as long as some path of the same signature among the others."""
    lengths = others.filter(F.col(other) != "").groupBy("loo_signature").agg(F.collect_set(F.length(other)).alias("_lengths"))
    fits = rows.join(lengths, "loo_signature").withColumn("_length", F.explode("_lengths")).filter(F.col("_length") <= F.length(path))
    return fits.withColumn("_end", F.expr(f"right({path}, _length)")).drop("_lengths", "_length")


def blocks_promotion(status: Column, verdict: Column, has_metrics: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return ((s != "") & (s != "ok")) | (_true(verdict.isin("fail", "review")) & has_metrics)


def tile_evidence(loo_rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """LOO rows with the whole map of their own held-out segment."""
    t = tiles.withColumnRenamed("segment_id", "heldout_segment").withColumnsRenamed(
        {c: f"tile_{c}" for c in tiles.columns if c not in ("artifact_dir", "segment_id")})
    return loo_rows.join(t, ["artifact_dir", "heldout_segment"])


def tile_readiness(tiles: DataFrame, key: str) -> DataFrame:
    """Whole-segment eligible evidence and any blocking quality verdict per artifact."""
    blocks = blocks_promotion(F.col("fixed_threshold_status"), F.col("verdict"), F.col("val_f1").isNotNull())
    ready = (F.col("region_type") == "whole_segment") & F.col("checks_eligible")
    return tiles.groupBy(key).agg(F.count(F.lit(1)).alias("tiles"), F.max(_true(ready)).alias("tile_ready"), F.max(blocks).alias("tile_quality_fail"))


def weak_tile_status(weak_rows: DataFrame, tiles: DataFrame, by: list[str]) -> DataFrame:
    """done / warning / missing for the map of each weak-fold row."""
    t = tiles.select("artifact_dir", F.col("segment_id").alias("heldout_segment"), F.lit(True).alias("_found"),
                     ((F.col("region_type") == "whole_segment") & F.col("checks_eligible")).alias("_ok"))
    t = t.groupBy("artifact_dir", "heldout_segment").agg(F.max("_found").alias("_found"), F.max("_ok").alias("_ok"))
    j = weak_rows.join(t, ["artifact_dir", "heldout_segment"], "left")
    return j.select(*by, "heldout_segment", F.when(F.col("_found").isNull(), "missing").when(F.col("_ok"), "done").otherwise("warning").alias("weak_tile_status"))


def promotion_actions(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Quality actions of all maps, fails before reviews, first per (action, segment).

    ``verdicts`` carries ``verdict, reasons, segment_id`` and an ``ordinal`` of the map.
    """
    from evalgate.operators.quality import quality_actions

    acts = quality_actions(verdicts)
    order = F.struct(F.when(F.col("verdict") == "fail", 0).otherwise(1), "ordinal", "reason_ordinal")
    pick = acts.groupBy(*by, "action", "segment_id").agg(F.min_by(F.struct("verdict", "reason", "severity", "ordinal", "reason_ordinal"), order).alias("r"))
    rows = pick.select(*by, "action", "segment_id", "r.*")
    sort = [F.when(F.col("verdict") == "fail", 0).otherwise(1), F.col("ordinal"), F.col("reason_ordinal")]
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*sort))).drop("ordinal", "reason_ordinal")


# ---------------------------------------------------------------- promotion results


def promotion_results(results: DataFrame, n: int = 20, doc: str = "payload") -> DataFrame:
    """Newest n promotion results with their reasons by fallback."""

    def text(path: str) -> Column:
        return F.nullif(F.try_variant_get(doc, path, "string"), F.lit(""))

    def listed(path: str) -> Column:
        return F.try_variant_get(doc, path, "array<string>")

    why = F.coalesce(listed("$.promotion_failure_reasons"), listed("$.diagnostic_summary.reasons"), F.array_compact(F.array(F.coalesce(text("$.error"), text("$.warning")))))
    flag = lambda p: F.coalesce(F.try_variant_get(doc, p, "boolean"), F.lit(False))
    rows = results.select("run_id", "ts", "status", why.alias("reasons"),
                          (flag("$.diagnostic_summary.summary_json_verified") | (F.try_variant_get(doc, "$.summary", "variant").isNotNull())).alias("summary_verified"),
                          (flag("$.diagnostic_summary.artifacts_verified") | flag("$.outputs_verified")).alias("artifacts_verified"))
    return recent(rows, ["ts", "run_id"], n)


def payload_reasons(doc: Column) -> Column:
    """Ordered, distinct reason codes of a promotion payload."""

    def filled(path: str) -> Column:
        v = F.try_variant_get(doc, f"$.{path}", "variant")
        t = F.to_json(v)
        return F.coalesce(~t.isin("null", "false", '""', "[]", "{}", "0"), F.lit(False))

    error = F.coalesce(F.try_variant_get(doc, "$.error", "string"), F.lit(""))
    code = F.coalesce(F.try_variant_get(doc, "$.returncode", "int"), F.lit(0))
    found = reasons(
        (filled("missing_outputs"), "reported_artifact_path_not_found"), (filled("empty_outputs"), "reported_artifact_empty"),
        (filled("missing_output_keys"), "full_tile_output_set_incomplete"), (filled("outside_output_dir"), "full_tile_output_outside_output_dir"),
        (filled("metrics_json_error"), "full_tile_metrics_json_invalid"), (filled("stale_summary_json"), "summary_json_stale"),
        (code != 0, "promotion_command_nonzero_exit"), (filled("outputs_verified"), "reported_artifacts_verified"),
        (filled("summary"), "summary_json_verified"),
        (error.contains("no current summary_json or validated outputs"), "summary_json_missing"),
        (error.contains("missing promotion checks"), "full_tile_metrics_missing_promotion_checks"),
        (error.contains("timed out"), "promotion_command_timeout"),
    )
    return F.when((F.size(found) == 0) & (error != ""), F.array(F.lit("promotion_command_failed"))).otherwise(F.array_distinct(found))


# ---------------------------------------------------------------- backtests and scorecards


def backtest_weights(runs: DataFrame, by: list[str], ap: list[float], f05: list[float], cal: list[float], k: int) -> DataFrame:
    """Mean F1 of the top k and quality of the top 5 for every weight combination.

    The top rows under the middle weights give every combination a floor: it has that many runs scoring no less, so a run
    below the floors of all combinations is in no top list. Only the few runs that pass a floor are spread over the grid.
    """
    grid = [(a, f, c) for a in ap for f in f05 for c in cal]
    most = max(k, 5)
    ratio, _ = _rates(runs)
    off = F.coalesce(F.least(F.abs(ratio - 1.0), F.lit(0.5)), F.lit(0.0))
    proxy = ((falsy_zero(F.col("val_f1")) > 0) & (falsy_zero(F.col("average_precision")) > 0) & (F.lower("fixed_threshold_status") == "ok")
             & ratio.between(0.1, 3.5) & ~_not_positive())
    slim = runs.select(*by, "run_id", "ts", falsy_zero(F.col("val_f1")).alias("f1"), falsy_zero(F.col("average_precision")).alias("ap"),
                       falsy_zero(F.col("val_f05")).alias("f05"), off.alias("off"), _true(proxy).alias("proxy"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))

    def score(a: float | Column, f: float | Column, c: float | Column) -> Column:
        return F.col("f1") + a * F.col("ap") + f * F.col("f05") - c * F.col("off")

    middle = score(*[sum(w) / len(w) for w in (ap, f05, cal)])
    seeds = top_rows(slim, by, [middle.desc()], most)
    enough = F.count(F.lit(1)) >= most
    floors = checkpointed(seeds.groupBy(*by).agg(*[F.when(enough, F.min(score(*w)) - 1e-9).otherwise(float("-inf")).alias(f"_f{i}") for i, w in enumerate(grid)]))
    above = F.greatest(*[score(*w) - F.col(f"_f{i}") for i, w in enumerate(grid)]) >= 0
    passing = bounded_join(slim, floors, by).filter(above).drop(*[f"_f{i}" for i in range(len(grid))])
    combos = F.array(*[F.struct(F.lit(a).alias("ap_weight"), F.lit(f).alias("f05_weight"), F.lit(c).alias("cal_weight")) for a, f, c in grid])
    rows = passing.select("*", F.inline(combos))
    keys = [*by, "ap_weight", "f05_weight", "cal_weight"]
    ranked = rows.withColumn("score", F.round(score(F.col("ap_weight"), F.col("f05_weight"), F.col("cal_weight")), 12))
    top = top_rows(ranked, keys, [F.col("score").desc(), F.col("ts"), F.col("run_id")], most)
    in_k, in_5 = F.col("rank") <= k, F.col("rank") <= 5
    return top.groupBy(*keys).agg(
        F.count_if(in_k).alias("top_k"), F.avg(F.when(in_k, F.col("f1"))).alias("mean_top_val_f1"),
        F.count_if(in_5 & F.col("proxy")).alias("eligible_proxy_top5"), F.count_if(in_5 & (F.col("ratio") > 3.0)).alias("pred_ratio_gt3_top5"))


def acceptance_gate(runs: DataFrame) -> Column:
    """First failure of the run acceptance gate, NULL when accepted."""
    names = ["val_f1", "average_precision", "precision_", "recall_", "val_positive_rate", "pred_positive_rate"]
    missing = F.lit(False)
    infinite = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
        infinite = infinite | F.isnan(n) | (F.abs(n) == float("inf"))
    ratio = F.col("pred_positive_rate") / F.nullif("val_positive_rate", F.lit(0.0))
    lift = F.coalesce(optional(runs, "ap_prevalence_lift", "double"), F.col("average_precision") / F.nullif("val_positive_rate", F.lit(0.0)))
    return first_reason(
        (missing | F.col("fixed_threshold_status").isNull(), "missing_metrics"), (infinite, "nonfinite_metric"),
        (F.col("val_f1") < 0.02, "val_f1_below_floor"), ((F.col("precision_") <= 0) | (F.col("recall_") <= 0), "zero_precision_recall"),
        (F.col("fixed_threshold_status") != "ok", "fixed_threshold_status"), (F.col("val_positive_rate") <= 0, "val_positive_rate"),
        ((ratio < 0.1) | (ratio > 3.5), "ratio_outside_band"), (lift < 1.25, "ap_prevalence_lift_below_floor"),
    )


def scorecard(runs: DataFrame, by: list[str]) -> DataFrame:
    """Best, latest and first F1, gain, percent of the 0.02 target and sanity ratio."""
    agg = runs.groupBy(*by).agg(
        F.max_by(F.struct("run_id", "val_f1"), F.struct("val_f1", "ts", "run_id")).alias("best"),
        F.max_by(F.struct("run_id", "val_f1", "pred_positive_rate", "val_positive_rate", "validation_mode"), newest()).alias("latest"),
        F.min_by(F.struct("val_f1"), newest()).alias("base"))
    gain = F.col("best.val_f1") - F.col("base.val_f1")
    ratio = floored_ratio(F.col("latest.pred_positive_rate"), F.col("latest.val_positive_rate"), 1e-12)
    percent = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(gain, F.lit(0.0)) / 0.02)) * 100)
    return agg.select(
        *by, F.col("best.run_id").alias("best_run_id"), F.col("best.val_f1").alias("best_f1"), F.col("latest.run_id").alias("latest_run_id"),
        F.col("latest.val_f1").alias("latest_f1"), F.col("base.val_f1").alias("baseline_f1"), gain.alias("gain_vs_baseline"), percent.alias("percent"),
        ratio.alias("sanity_ratio"), F.when(_true((ratio > 4) | (ratio < 0.25)), "warning").otherwise("ok").alias("sanity"),
        _true(F.col("latest.validation_mode").isin(HELD_OUT_MODES)).alias("validation_ok"))


def next_move(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Next move per group, by precedence of the evidence flags."""
    act = first_reason(
        (F.col("loo_blocks") | (F.col("hard_fold_severity") == "blocker"), "audit_linked_loo_hard_fold_failure"),
        (F.col("regressed_pairs") > 0, "review_full_tile_regression"), (F.col("recommended_cap").isNotNull(), "tighten_positive_rate_cap"),
        (F.col("mining_tiles") > 0, "review_fold_safe_hard_negative_mining"), (F.col("gate_ready"), "promotion_review"),
        default="follow_dashboard_next_action")
    ready = lookup({"audit_linked_loo_hard_fold_failure": "blocks_promotion", "review_full_tile_regression": "needs_review_before_claiming_lift",
                    "tighten_positive_rate_cap": "ready_from_existing_evidence", "review_fold_safe_hard_negative_mining": "review_before_artifact_writing",
                    "promotion_review": "ready_from_existing_evidence", "follow_dashboard_next_action": "needs_more_evidence"}, F.col("action"))
    return evidence.withColumn("action", act).select(*by, "action", ready.alias("readiness"))


# ---------------------------------------------------------------- action-targeted moves

# Change rules of the automatic actions: (action, ordinal, path, factor, addend, floor, ceiling, word, models).
ACTION_RULES = [
    ("calibrate_probability_scale", 0, "training.positive_rate_loss_weight", 1.0, 0.02, 0.02, 0.1, None, "torch"),
    ("calibrate_probability_scale", 1, "training.positive_rate_loss_tolerance", 0.5, 0.0, 0.001, 0.02, None, "torch"),
    ("calibrate_probability_scale", 2, "training.pos_weight", 0.85, 0.0, 0.25, 25.0, None, "torch"),
    ("calibrate_probability_scale", 3, "evaluation.threshold", 0.0, 0.33, 0.05, 0.95, None, "array"),
    ("calibrate_probability_scale", 4, "evaluation.threshold", 0.0, 0.35, 0.05, 0.95, None, "any"),
    ("calibrate_probability_scale", 5, "training.seed", 1.0, 17.0, 0.0, 1e18, None, "any"),
    ("calibrate_probability_scale", 6, "training.seed", 1.0, 31.0, 0.0, 1e18, None, "any"),
    ("calibrate_probability_scale", 7, "training.seed", 1.0, 53.0, 0.0, 1e18, None, "any"),
    ("calibrate_positive_rate", 0, "training.positive_rate_loss_weight", 1.0, -0.02, 0.0, 0.1, None, "torch"),
    ("calibrate_positive_rate", 1, "training.positive_rate_loss_weight", 1.0, 0.02, 0.0, 0.1, None, "torch"),
    ("calibrate_positive_rate", 2, "training.pos_weight", 0.8, 0.0, 0.25, 25.0, None, "any"),
    ("hard_fold_low_ap_near_prevalence", 0, "training.patch_sampling", 0.0, 0.0, 0.0, 0.0, "hard_mining", "torch"),
    ("hard_fold_low_ap_near_prevalence", 5, "evaluation.max_pred_positive_rate_ratio", 0.0, 2.75, 1.5, 3.5, None, "torch"),
    ("hard_fold_low_ap_near_prevalence", 6, "dataset.z_offsets", 0.0, 0.0, 0.0, 0.0, "[-4,0,4]", "torch"),
    ("hard_fold_low_ap_near_prevalence", 7, "dataset.z_offsets", 0.0, 0.0, 0.0, 0.0, "[-6,-3,0,3,6]", "torch"),
    ("improve_ranking_signal", 0, "training.epochs", 1.0, 1.0, 2.0, 8.0, None, "torch"),
    ("improve_ranking_signal", 1, "training.learning_rate", 0.6, 0.0, 0.001, 0.25, None, "torch"),
    ("mine_hard_negatives", 0, "training.sampling_strategy", 0.0, 0.0, 0.0, 0.0, "hard_mining", "torch"),
    ("repair_precision_recall", 0, "training.pos_weight", 0.75, 0.0, 0.25, 25.0, None, "any"),
    ("repair_precision_recall", 1, "training.dice_loss_weight", 1.0, 0.15, 0.0, 0.8, None, "torch"),
]

# Changes of several leaves at once, torch models only: (action, ordinal, path of the move, {leaf: value}).
_HARD = {"training.patch_sampling": "hard_mining", "training.hard_negative_fraction": "0.75"}
_RATE = {"training.positive_patch_fraction": "0.3", "training.positive_rate_loss_target": "auto_train"}
COMPOUND_RULES = [
    ("hard_fold_low_ap_near_prevalence", 1, "hard_fold_sampling_calibration", {**_HARD, "training.positive_patch_fraction": "0.3"}),
    ("hard_fold_low_ap_near_prevalence", 2, "hard_fold_sampling_calibration", {**_HARD, "training.positive_patch_fraction": "0.25"}),
    ("hard_fold_low_ap_near_prevalence", 3, "hard_fold_sampling_calibration",
     {**_HARD, **_RATE, "training.positive_rate_loss_weight": "0.05", "training.positive_rate_loss_tolerance": "0.015", "evaluation.max_pred_positive_rate_ratio": "2.75"}),
    ("hard_fold_low_ap_near_prevalence", 4, "hard_fold_sampling_calibration",
     {**_HARD, **_RATE, "training.positive_rate_loss_weight": "0.08", "training.positive_rate_loss_tolerance": "0.012", "evaluation.max_pred_positive_rate_ratio": "2.5"}),
]


def action_rules(spark) -> DataFrame:
    return spark.createDataFrame(
        ACTION_RULES, "action string, ordinal int, path string, factor double, addend double, floor double, ceiling double, word string, models string")


def compound_rules(spark) -> DataFrame:
    """A row per leaf of each compound change, with the whole change as sorted ``leaf=value`` text."""
    rows = [(a, o, m, leaf, want, ";".join(f"{k}={v}" for k, v in sorted(sets.items()))) for a, o, m, sets in COMPOUND_RULES for leaf, want in sets.items()]
    return spark.createDataFrame(rows, "action string, ordinal int, move string, path string, want string, proposed string")


def action_moves(bases: DataFrame, rules: DataFrame, by: list[str], k: int, compounds: DataFrame | None = None) -> DataFrame:
    """First k real changes per (group, action); bases carry model_name, path, value and the wanted action.

    A compound change is real if any of its leaves differs or is absent. The leaves that compounds name are gathered once per
    group; the bases never meet themselves.
    """
    torch = F.coalesce(F.col("model_name").contains("torch"), F.lit(False))
    fits = (F.col("models") == "any") | (torch & (F.col("models") == "torch")) | (~torch & (F.col("models") == "array"))
    changed = bases.join(F.broadcast(rules), ["action", "path"]).filter(fits).withColumn("proposed", _proposed()).filter(_changed())
    moves = changed.select(*by, "action", "ordinal", "path", "value", "proposed")
    if compounds is not None:
        whole_moves = compounds.groupBy("action", "ordinal", "move", "proposed").agg(F.collect_list(F.struct("path", "want")).alias("_wants"))
        leaf = F.broadcast(compounds.select("action", "path").distinct().withColumn("_named", F.lit(True)))
        held = bases.filter(torch).join(F.broadcast(compounds.select("action").distinct()), "action", "left_semi").join(leaf, ["action", "path"], "left")
        held = held.groupBy(*by, "action").agg(F.collect_list(F.when(F.col("_named"), F.struct("path", "value"))).alias("_held"))

        def kept(w: Column) -> Column:
            own = F.filter("_held", lambda h: h["path"] == w["path"])
            return (F.size(own) > 0) & F.forall(own, lambda h: F.coalesce(
                number_of(w["want"]) == number_of(h["value"]), w["want"] == h["value"], F.lit(False)))

        whole = held.join(F.broadcast(whole_moves), "action").filter(~F.forall("_wants", kept))
        whole = whole.select(*by, "action", "ordinal", F.col("move").alias("path"), "proposed")
        moves = moves.unionByName(whole.withColumn("value", F.lit(None).cast("string")))
    return top_rows(moves, [*by, "action"], [F.col("ordinal")], k, "move_rank")
