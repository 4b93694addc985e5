"""Quality of decoded probability maps: statistics, verdicts, actions, blockiness, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalgate.functions.columns import clip01, grouped, null_safe_join, reasons
from evalgate.functions.tables import QUALITY_ACTIONS
from evalgate.operators.metrics import quantiles, running_counts
from evalgate.operators.rules import lookup

HARD_FAIL = ["blank_or_no_positive_mask", "flooding", "flat_probabilities", "speckle_or_isolated_positives",
             "many_isolated_positives", "unstructured_noise", "high_frequency_noise"]


def clean_prob(col: str = "prob") -> Column:
    p = F.col(col).cast("double")
    finite = ~(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")))
    return F.when(finite, clip01(p)).otherwise(0.0)


def _quantile_columns(pixels: DataFrame, by: list[str], probs: list[float], names: list[str], value: str) -> DataFrame:
    counts = pixels.groupBy(*by, F.col(value).alias("prob")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("pos"))
    q = quantiles(running_counts(counts, by), by, probs)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("q_index") == i, F.col("threshold"))).alias(n) for i, n in enumerate(names)])


def map_stats(scores: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Statistics of each map from two line-wise windows and one aggregate.

    Columns are windowed first, rows second; a line of pixels is the unit of work, so a single
    huge map spreads over as many tasks as it has lines.
    """
    scores, by = grouped(scores, by)
    finite = ~(F.col("prob").isNull() | F.isnan("prob") | (F.abs("prob") == float("inf")))
    px = scores.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), clean_prob().alias("_p"),
                       finite.cast("int").alias("_finite"))
    px = px.withColumn("_m", F.when(F.col("_p") >= threshold, 1).otherwise(0))
    down = W.partitionBy(*by, "x").orderBy("y")
    across = W.partitionBy(*by, "y").orderBy("x")

    def after(col: str, w, axis: str) -> Column:
        return F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(col).over(w))

    px = px.withColumns({"_pv": after("_p", down, "y"), "_mv": after("_m", down, "y"), "_col3": F.sum("_m").over(down.rangeBetween(-1, 1))})
    px = px.withColumns({"_ph": after("_p", across, "x"), "_mh": after("_m", across, "x"),
                         "_nb": F.sum("_col3").over(across.rangeBetween(-1, 1)) - F.col("_m")})
    agg = px.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_finite").alias("finite_fraction"), F.sum("_m").alias("positives"),
        F.avg("_p").alias("mean"), F.var_pop("_p").alias("var"), F.stddev_pop("_p").alias("std"),
        F.count("_pv").alias("nv"), F.count("_ph").alias("nh"),
        F.sum(F.abs(F.col("_pv") - F.col("_p"))).alias("dv"), F.sum(F.abs(F.col("_ph") - F.col("_p"))).alias("dh"),
        F.avg(F.col("_p") * F.col("_pv")).alias("cv"), F.avg(F.col("_p") * F.col("_ph")).alias("ch"),
        F.avg(F.when(F.col("_pv").isNotNull(), F.col("_p") + F.col("_pv"))).alias("sv"),
        F.avg(F.when(F.col("_ph").isNotNull(), F.col("_p") + F.col("_ph"))).alias("sh"),
        F.count_if(F.col("_mv") != F.col("_m")).alias("tv"), F.count_if(F.col("_mh") != F.col("_m")).alias("th"),
        F.count_if((F.col("_m") == 1) & (F.col("_nb") >= 2)).alias("supported"),
        F.count_if((F.col("_m") == 1) & (F.col("_nb") == 0)).alias("isolated"),
    )
    q = _quantile_columns(px, by, [0.01, 0.05, 0.95, 0.99], ["q01", "q05", "q95", "q99"], "_p")
    s = null_safe_join(agg, q, by)
    edges = F.col("nv") + F.col("nh")
    mean = F.col("mean")
    cov_v = F.col("cv") - mean * F.col("sv") + mean * mean
    cov_h = F.col("ch") - mean * F.col("sh") + mean * mean
    cov = F.when(F.col("nv") * F.col("nh") > 0, (cov_v + cov_h) / 2).otherwise(F.coalesce(cov_v, cov_h))
    diff = F.when(edges > 0, (F.coalesce("dv", F.lit(0.0)) + F.coalesce("dh", F.lit(0.0))) / edges).otherwise(0.0)
    dyn = F.col("q99") - F.col("q01")

    def share(c: str) -> Column:
        return F.when(F.col("positives") > 0, F.col(c) / F.col("positives")).otherwise(0.0)

    return s.select(
        *by, "finite_fraction", (F.col("positives") / F.col("n")).alias("positive_rate"), dyn.alias("dynamic_range"),
        (F.col("q95") - F.col("q05")).alias("robust_spread"), "std", diff.alias("mean_abs_neighbor_diff"),
        (diff / F.greatest(dyn, F.lit(1e-6))).alias("noise_index"),
        F.when((F.col("var") > 1e-12) & cov.isNotNull(), cov / F.col("var")).otherwise(1.0).alias("neighbor_autocorr"),
        share("supported").alias("supported_positive_rate"), share("isolated").alias("isolated_positive_rate"),
        F.when(edges > 0, (F.col("tv") + F.col("th")) / edges).otherwise(0.0).alias("transition_density"), "positives",
    )


def map_verdict(stats: DataFrame) -> DataFrame:
    """Score, ordered flags and pass / review / fail."""
    rate, dyn, noise = F.col("positive_rate"), F.col("dynamic_range"), F.col("noise_index")
    auto, sup, iso, trans = (F.col(c) for c in ("neighbor_autocorr", "supported_positive_rate", "isolated_positive_rate", "transition_density"))
    rate_score = (F.when(rate < 0.001, 0.0).when(rate < 0.005, 0.25).when(rate <= 0.50, 1.0).when(rate >= 0.75, 0.0)
                  .otherwise(clip01((0.75 - rate) / 0.25)))
    contrast = clip01((dyn - 0.05) / 0.25)
    coherence = clip01((sup - 0.25) / 0.50) * (1.0 - clip01((trans - 0.15) / 0.35))
    smooth = clip01(auto / 0.50) * (1.0 - clip01((noise - 0.25) / 0.50))
    some = F.col("positives") > 0
    flags = reasons(
        (F.col("finite_fraction") < 0.999, "invalid_values"), (rate < 0.001, "blank_or_no_positive_mask"),
        (rate >= 0.75, "flooding"), ((rate >= 0.60) & (rate < 0.75), "possible_flooding"),
        ((dyn < 0.05) | (F.col("std") < 0.015), "flat_probabilities"), (some & (sup < 0.25), "speckle_or_isolated_positives"),
        (some & (iso > 0.30), "many_isolated_positives"), (trans > 0.40, "fragmented_threshold_mask"),
        ((auto < 0.05) & (trans > 0.30), "unstructured_noise"), ((noise > 0.50) & (auto < 0.20), "high_frequency_noise"),
    )
    out = stats.withColumn("score", 0.25 * rate_score + 0.25 * contrast + 0.30 * coherence + 0.20 * smooth).withColumn("flags", flags)
    bad = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in HARD_FAIL])) | (F.col("score") < 0.45)
    verdict = F.when(bad, "fail").when((F.col("score") < 0.70) | (F.size("flags") > 0), "review").otherwise("pass")
    return out.withColumn("verdict", verdict)


def metrics_verdict(df: DataFrame) -> DataFrame:
    """Quality score, ordered reasons and verdict from a metrics record."""

    def opt(name: str, kind: str = "double") -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    f1, ap, val, pred, fixed = (opt(c) for c in ("val_f1", "average_precision", "val_positive_rate", "pred_positive_rate", "fixed_threshold_f1"))
    has_rate = val > 1e-12
    lift = F.coalesce(opt("ap_prevalence_lift"), F.when(has_rate, ap / val))
    ratio = F.when(has_rate, pred / val)
    near, wide = ratio.between(0.5, 2.0), ratio.between(0.25, 3.0)
    zero = F.lit(0.0)
    weak = fixed < 0.5 * f1
    score = (F.coalesce(F.least(F.lit(0.35), f1), zero)
             + F.coalesce(F.least(F.lit(0.25), F.greatest(zero, (lift - 1.0) * 0.15)), zero)
             + F.when(near, 0.25).when(wide, 0.12).otherwise(0.0)
             + F.when(fixed >= 0.5 * f1, 0.15).otherwise(0.0))
    why = reasons(
        (ratio.isNotNull() & ~wide, "positive_rate_ratio_suspicious"),
        (weak, F.coalesce(F.nullif(opt("fixed_threshold_failure_reason", "string"), F.lit("")), F.lit("fixed_threshold_weak"))),
        (wide & ~near, "positive_rate_ratio_review"), (lift < 1.25, "weak_ap_lift"), (f1 < 0.12, "weak_full_tile_f1"),
    )
    out = df.withColumn("quality_score", score).withColumn("reasons", why)
    suspicious = F.array_contains("reasons", "positive_rate_ratio_suspicious")
    verdict = (F.when((F.size("reasons") == 0) & (F.col("quality_score") >= 0.70), "pass")
               .when((F.col("quality_score") >= 0.45) & ~suspicious, "review").otherwise("fail"))
    return out.withColumn("verdict", verdict)


def quality_actions(verdicts: DataFrame) -> DataFrame:
    """One action row per distinct reason of each non-passing verdict.

    A warning becomes a blocker when the verdict is a fail; an empty reason list falls back to
    the verdict's own name.
    """
    v = F.col("verdict")
    fallback = F.array(F.when(v == "review", "quality_review").otherwise("quality_failed"))
    listed = F.when(F.size("reasons") > 0, F.array_distinct("reasons")).otherwise(fallback)
    rows = verdicts.filter(v != "pass").select("*", F.posexplode(listed).alias("reason_ordinal", "reason"))
    action = F.coalesce(lookup({k: a for k, (a, _) in QUALITY_ACTIONS.items()}, F.col("reason")), F.lit("quality_review"))
    base = F.coalesce(lookup({k: s for k, (_, s) in QUALITY_ACTIONS.items()}, F.col("reason")), F.when(v == "review", "warning").otherwise("blocker"))
    return rows.withColumns({"action": action, "severity": F.when(v == "fail", "blocker").otherwise(base)})


def blockiness(scores: DataFrame, by: list[str], blocks: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """Largest boundary to internal difference ratio over block sizes and axes."""
    scores, by = grouped(scores, by)
    px = scores.select(*by, "y", "x", clean_prob().alias("_p"))
    rows = W.partitionBy(*by, "x").orderBy("y")
    cols = W.partitionBy(*by, "y").orderBy("x")
    d = px.withColumn("_dv", F.abs(F.col("_p") - F.lag("_p").over(rows))).withColumn("_dh", F.abs(F.col("_p") - F.lag("_p").over(cols)))
    lines = d.filter("_dv IS NOT NULL").groupBy(*by, F.lit("row").alias("axis"), F.col("y").alias("line")).agg(F.avg("_dv").alias("_d")).unionByName(
        d.filter("_dh IS NOT NULL").groupBy(*by, F.lit("col").alias("axis"), F.col("x").alias("line")).agg(F.avg("_dh").alias("_d")))
    shape = px.groupBy(*by).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    dyn = _quantile_columns(px, by, [0.01, 0.99], ["q01", "q99"], "_p")
    shape = null_safe_join(shape, dyn, by)
    per = null_safe_join(lines, shape.select(*by, "_h", "_w"), by).withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    length = F.when(F.col("axis") == "row", F.col("_h")).otherwise(F.col("_w"))
    edge = F.col("line") % F.col("block") == 0
    ratio = per.filter(length > F.col("block") * 2).groupBy(*by, "block", "axis").agg(
        (F.avg(F.when(edge, F.col("_d"))) / F.greatest(F.avg(F.when(~edge, F.col("_d"))), F.lit(1e-6))).alias("_ratio"))
    found = ratio.groupBy(*by).agg(F.max("_ratio").alias("_i"), F.max_by("block", F.struct("_ratio", -F.col("block"))).alias("_b"))
    out = null_safe_join(shape, found, by, "left")
    skip = (F.col("_h") < 16) | (F.col("_w") < 16) | (F.col("q99") - F.col("q01") < 0.05) | F.col("_i").isNull() | (F.col("_i") <= 0)
    index = F.when(skip, 0.0).otherwise(F.col("_i"))
    return out.select(*by, index.alias("blockiness_index"), (index >= 8.0).alias("blockiness_suspect"), F.when(~skip, F.col("_b")).alias("block_size"))


def downsample(scores: DataFrame, by: list[str], max_side: int = 384, value: str = "prob") -> DataFrame:
    """Area mean on a grid of at most ``max_side`` per side; a map that already fits is unchanged."""
    scores, by = grouped(scores, by)
    shape = scores.groupBy(*by).agg((F.max("y") + 1).cast("long").alias("h"), (F.max("x") + 1).cast("long").alias("w"))
    scale = F.greatest(F.col("h") / max_side, F.col("w") / max_side, F.lit(1.0))
    shape = shape.withColumns({"oh": F.greatest(F.lit(1), F.bround(F.col("h") / scale).cast("long")),
                               "ow": F.greatest(F.lit(1), F.bround(F.col("w") / scale).cast("long"))})
    j = null_safe_join(scores.select(*by, "y", "x", value), shape, by)
    yb = F.floor(((F.col("y") + 1) * F.col("oh") - 1) / F.col("h"))
    xb = F.floor(((F.col("x") + 1) * F.col("ow") - 1) / F.col("w"))
    return j.groupBy(*by, yb.alias("y"), xb.alias("x")).agg(F.avg(value).alias(value))


def map_summary(scores: DataFrame, metrics: DataFrame | None, by: list[str], max_side: int = 384, default_threshold: float = 0.5) -> DataFrame:
    """Shape, range, rate at the chosen threshold, preview mask mean and preview warnings."""
    scores, by = grouped(scores, by)
    if metrics is not None:
        chosen = metrics.select(*by, F.col("best_threshold").alias("threshold"))
        scores = null_safe_join(scores, chosen, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(default_threshold)))
    else:
        scores = scores.withColumn("threshold", F.lit(default_threshold))
    scores = scores.withColumn("_m", (F.col("prob") >= F.col("threshold")).cast("double"))
    base = scores.groupBy(*by).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.min("prob").alias("prob_min"), F.avg("prob").alias("prob_mean"),
        F.max("prob").alias("prob_max"), F.max("threshold").alias("threshold"), F.avg("_m").alias("pred_positive_rate"))
    p95 = _quantile_columns(scores.withColumn("p", F.col("prob").cast("double")), by, [0.95], ["prob_p95"], "p")
    mask = downsample(scores.drop("prob").withColumnRenamed("_m", "prob"), by, max_side).groupBy(*by).agg(F.avg("prob").alias("mask_preview_mean"))
    out = base
    for part in (p95, mask, blockiness(scores, by)):
        out = null_safe_join(out, part, by)
    shrunk = (F.col("height") > max_side) | (F.col("width") > max_side)
    warn = reasons((shrunk, "preview_downsampled_area_mean_not_full_resolution"),
                   (F.col("blockiness_suspect"), "possible_blocky_or_nearest_neighbor_probability_map"))
    return out.withColumn("preview_warnings", warn)
