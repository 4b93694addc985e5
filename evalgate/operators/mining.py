"""Hard-negative mining: false-positive tiles, mined-set inventory, decisions and the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.functions.columns import first_reason, reasons, safe_ratio
from evalgate.functions.ordering import placed
from evalgate.operators.grid import covering_tiles, extract_at, map_sizes
from evalgate.operators.ledger import optional, top_rows


def false_positive_tiles(scores: DataFrame, keys: list[str], patch: int, stride: int, threshold: float, max_rate: float = 0.001) -> DataFrame:
    """Covering tiles with false positives and hardly a label: label_rate, fp_rate and prob_mean of each."""
    tiles = covering_tiles(scores.select(*keys, "y", "x", "prob", "label"), keys, map_sizes(scores, keys), patch, stride)
    truth = F.col("label") > 0.5
    agg = tiles.groupBy(*keys, "y0", "x0").agg(
        F.avg(truth.cast("double")).alias("label_rate"), F.avg(((F.col("prob") >= threshold) & ~truth).cast("double")).alias("fp_rate"),
        F.avg("prob").alias("prob_mean"))
    return agg.filter((F.col("label_rate") <= max_rate) & (F.col("fp_rate") > 0))


def mine_tiles(scores: DataFrame, keys: list[str], patch: int, stride: int, threshold: float, n: int, max_rate: float = 0.001) -> DataFrame:
    """Top n false-positive tiles per map by (fp rate, mean score, y, x) descending."""
    return best_tiles(false_positive_tiles(scores, keys, patch, stride, threshold, max_rate), keys, n)


def best_tiles(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    # tile means are sums over pixels in any order; rank at 12 digits so equal tiles stay equal
    order = [F.round("fp_rate", 12).desc(), F.round("prob_mean", 12).desc(), F.col("y0").desc(), F.col("x0").desc()]
    return top_rows(found, keys, order, n, "mine_rank")


def mining_statistics(scores: DataFrame, keys: list[str], patch: int, stride: int, threshold: float, n: int, max_rate: float = 0.001) -> DataFrame:
    """Record of a mining run per map: settings, candidate tiles, mined samples and their label, score and false-positive rates.

    Tiles are of one size, so the labels' rate over all mined pixels is the mean of the tiles' rates. A map without candidates
    has zeros.
    """
    found = false_positive_tiles(scores, keys, patch, stride, threshold, max_rate)
    totals = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_patches"))
    mined = best_tiles(found, keys, n).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("label_rate").alias("positive_rate"), F.max("fp_rate").alias("max_fp_rate"), F.avg("prob_mean").alias("mean_probability"))
    out = scores.select(*keys).distinct().join(totals, keys, "left").join(mined, keys, "left")
    named = {"patch_size": patch, "stride": stride, "max_patches": n, "threshold": float(threshold), "max_label_positive_rate": float(max_rate)}
    return out.fillna(0).select(*keys, *[F.lit(v).alias(k) for k, v in named.items()], "candidate_patches", "samples", "positive_rate", "max_fp_rate", "mean_probability")


def mined_patches(pixels: DataFrame, mined: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """Image arrays of the mined origins."""
    return extract_at(pixels, mined, keys, patch)


def mined_inventory(sets: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Counts, rates, warnings and status of each mined set.

    ``sets`` holds the sidecar facts (``segment_id, provenance, has_metadata, metadata_error``);
    ``patches`` the labels.
    """
    from evalgate.operators.grid import positive_rate

    rate = patches.select(key, positive_rate().alias("_r"), F.size("label").alias("_n"))
    agg = rate.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), (F.sum(F.col("_r") * F.col("_n")) / F.sum("_n")).alias("pixel_positive_rate"),
                                F.avg((F.col("_r") > 0.001).cast("double")).alias("positive_patch_rate"))
    j = sets.join(agg, key, "left")
    none = F.size(F.coalesce("provenance", F.array().cast("array<string>"))) == 0
    warn = reasons(
        (F.col("samples").isNull(), "schema_error"), (~F.col("has_metadata"), "missing_metadata"), (F.col("metadata_error"), "metadata_parse_error"),
        (none, "missing_provenance_segment"), (F.coalesce("samples", F.lit(0)) == 0, "zero_samples"),
        (F.col("pixel_positive_rate") > 0.001, "positive_contaminated"))
    reject = F.exists("warnings", lambda w: w.isin("schema_error", "metadata_parse_error", "zero_samples", "missing_provenance_segment"))
    return j.withColumn("warnings", warn).withColumn("status", F.when(F.size("warnings") == 0, "eligible").when(reject, "reject").otherwise("review"))


def fold_eligibility(inventory: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """(set, held-out segment) rows with eligible / rejected and the reason.

    The held-out list is the fold catalogue (a handful of segment ids) and is attached as one
    array; forbidden pairs come from an equi-join on the exploded provenance.
    """
    held = folds.agg(F.sort_array(F.collect_set("heldout_segment")).alias("h")).select("h").scalar()
    pairs = inventory.select(key, "status", F.explode(held).alias("heldout_segment"))
    bad = inventory.select(key, F.explode("provenance").alias("heldout_segment")).distinct().withColumn("_bad", F.lit(True))
    j = pairs.join(bad, [key, "heldout_segment"], "left")
    why = F.when(F.col("status") != "eligible", F.col("status")).when(F.col("_bad"), "provenance_includes_heldout_segment")
    return j.select(key, "heldout_segment", why.isNull().alias("eligible"), why.alias("reason"))


def fold_sets(inventory: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """A row per held-out segment: how many sets it may use, how many its provenance or their status forbids, and the first usable one.

    Only the exceptions are rows: (set, segment) of eligible sets whose provenance names the segment. Counts are totals less
    exceptions. The first usable set is the first of all or the successor of a forbidden one, whichever is free and earliest.
    """
    held = folds.select("heldout_segment").distinct()
    sets = placed(inventory.filter("status = 'eligible'").select(key, "provenance"), [key])
    eligible = sets.agg(F.count(F.lit(1))).scalar()
    total = inventory.agg(F.count(F.lit(1))).scalar()
    forbidden = sets.select("place", F.explode("provenance").alias("heldout_segment")).distinct()
    counts = forbidden.groupBy("heldout_segment").agg(F.count(F.lit(1)).alias("_bad"))
    tried = held.withColumn("place", F.lit(0).cast("long")).union(forbidden.select("heldout_segment", (F.col("place") + 1).alias("place")).join(held, "heldout_segment"))
    free = tried.join(forbidden, ["heldout_segment", "place"], "left_anti").groupBy("heldout_segment").agg(F.min("place").alias("place"))
    first = free.join(sets.select("place", F.col(key).alias("first_set")), "place", "left").drop("place")
    j = held.join(counts, "heldout_segment", "left").join(first, "heldout_segment", "left")
    bad = F.coalesce("_bad", F.lit(0))
    return j.select("heldout_segment", (eligible - bad).alias("eligible_sets"), bad.alias("own_sets"), (total - eligible).alias("rejected_sets"), "first_set")


def rejected_sets(inventory: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """(set, held-out segment, reason) of what a plan may not use: a segment of NULL stands for all of them."""
    by_status = inventory.filter("status <> 'eligible'").select(key, F.lit(None).cast("string").alias("heldout_segment"), F.col("status").alias("reason"))
    held = folds.select("heldout_segment").distinct()
    own = inventory.filter("status = 'eligible'").select(key, F.explode("provenance").alias("heldout_segment")).distinct().join(held, "heldout_segment")
    return by_status.unionByName(own.withColumn("reason", F.lit("provenance_includes_heldout_segment")))


def plan_preconditions(inventory: DataFrame, folds: DataFrame) -> DataFrame:
    """A row per held-out segment: the value that a configuration must hold out, and whether any set was mined from it.

    A plan's configuration must equal the segment and must not be in the list of all segments of any set; the list is the
    distinct provenance, which is joined and not carried along.
    """
    forbidden = inventory.select(F.explode("provenance").alias("heldout_segment")).distinct().withColumn("_in", F.lit(True))
    held = folds.select("heldout_segment").distinct()
    return held.join(forbidden, "heldout_segment", "left").select("heldout_segment", F.col("_in").isNotNull().alias("in_forbidden_segments"), F.col("_in").isNull().alias("precondition_holds"))


def candidate_tiles(tiles: DataFrame, by: list[str]) -> DataFrame:
    """One tile per (artifact, segment): the first, or the first with a risk summary; first-seen order kept."""
    rest = [c for c in tiles.columns if c not in {*by, "artifact_dir", "segment_id"}]
    pick = F.min_by(F.struct(*rest), F.struct((~F.col("has_risk")).cast("int"), "ordinal"))
    return tiles.groupBy(*by, "artifact_dir", "segment_id").agg(pick.alias("r"), F.min("ordinal").alias("first_seen")).select(
        *by, "artifact_dir", "segment_id", "first_seen", "r.*")


def needs_mining(tiles: DataFrame, ratio: float = 2.0) -> Column:
    """Explicit mining action, or a high ratio with a weak fixed threshold."""
    acts = optional(tiles, "actions", "array<string>")
    explicit = F.coalesce(F.array_contains(acts, "mine_hard_negatives"), F.lit(False))
    rate = safe_ratio(F.col("pred_positive_rate"), F.col("val_positive_rate"))
    weak = (F.coalesce(F.col("fixed_threshold_status").isin("weak", "failed", "zero_f1"), F.lit(False))
            | F.coalesce(F.array_contains(optional(tiles, "reasons", "array<string>"), "fixed_threshold_weak"), F.lit(False))
            | (F.coalesce("fixed_threshold_f1", F.lit(0.0)) <= 0))
    return explicit | F.coalesce((rate >= ratio) & weak, F.lit(False))


def risk_decision(tiles: DataFrame, keep: float = 0.95) -> DataFrame:
    """Tighten the cap, mine, review or compare.

    ``risk`` is a struct of ``selected_f1, selected_f05, selected_ratio, cap_binding`` and
    ``f1_2, f05_2, f1_25, f05_25, f1_3, f05_3``; NULL when the summary is missing.
    """
    r = F.col("risk")
    f1 = F.coalesce(F.nullif(r["selected_f1"], F.lit(0.0)), F.nullif(F.col("val_f1"), F.lit(0.0)), F.lit(0.0))
    ratio = F.coalesce(F.nullif(r["selected_ratio"], F.lit(0.0)), safe_ratio(F.col("pred_positive_rate"), F.col("val_positive_rate")))

    def kept(cap: str) -> Column:
        a = r[f"f1_{cap}"] / F.greatest(r["selected_f1"], F.lit(1e-12))
        b = r[f"f05_{cap}"] / F.greatest(r["selected_f05"], F.lit(1e-12))
        return F.coalesce((a >= keep) & (b.isNull() | (b >= keep)), F.lit(False))

    rules = [
        (r.isNull() | (f1 <= 0), "run_cap_comparison", "missing_threshold_risk_summary", None),
        (r["selected_f1"].isNull(), "run_cap_comparison", "partial_threshold_risk_summary", None),
        (kept("2"), "tighten_positive_rate_cap", "prratio2_preserves_selected_f1_f05", 2.0),
        (kept("25"), "tighten_positive_rate_cap", "prratio2p5_preserves_selected_f1_f05", 2.5),
        (kept("3"), "tighten_positive_rate_cap", "prratio3_preserves_selected_f1_f05", 3.0),
        (F.coalesce(r["cap_binding"], F.lit(False)) | F.coalesce(ratio >= 2.0, F.lit(False)), "mine_hard_negatives", "lower_ratio_caps_reduce_selected_f1_or_f05", None),
    ]
    return tiles.withColumns({
        "decision": first_reason(*[(c, a) for c, a, _, _ in rules], default="review_threshold_risk"),
        "decision_reason": first_reason(*[(c, w) for c, _, w, _ in rules], default="no_ratio_pressure"),
        "target_cap": first_reason(*[(c, F.lit(t).cast("double")) for c, _, _, t in rules]),
        "decision_ratio": ratio,
    })


def mining_plan(tiles: DataFrame, sets: DataFrame, by: list[str], max_tiles: int, ratio: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Tiles to mine (first ``max_tiles`` per group) and the extra sets each held-out segment may use (of ``fold_sets``)."""
    decided = risk_decision(candidate_tiles(tiles, by))
    explicit = F.coalesce(F.array_contains(optional(decided, "actions", "array<string>"), "mine_hard_negatives"), F.lit(False))
    compare = (F.col("decision") == "run_cap_comparison") & optional(decided, "has_threshold_rows", "boolean", False)
    mine = needs_mining(decided, ratio) & (explicit | ~((F.col("decision") == "tighten_positive_rate_cap") | compare))
    chosen = top_rows(decided.filter(mine), by, [F.col("first_seen"), F.col("artifact_dir"), F.col("segment_id")], max_tiles, "mine_order")
    return chosen, sets.filter("eligible_sets > 0").select("heldout_segment", "eligible_sets", "first_set")


def cap_recommendation(recommended: DataFrame, by: list[str]) -> DataFrame:
    """Loosest of the strictest passing caps; any artifact without one blocks the recommendation."""
    blocked = F.count_if(F.col("recommended_cap").isNull())
    return recommended.groupBy(*by).agg(
        F.count(F.lit(1)).alias("artifacts"), blocked.alias("blockers"),
        F.when(blocked == 0, F.max("recommended_cap")).alias("target_cap"))


def cap_blockers(recommended: DataFrame, by: list[str]) -> DataFrame:
    """A row per artifact that blocks its group's recommendation, with the reason; ``error`` names a comparison that failed."""
    error = optional(recommended, "error", "string")
    reason = F.when(error.isNotNull(), "cap_comparison_error").otherwise("no_cap_preserves_retention")
    return recommended.filter(F.col("recommended_cap").isNull() | error.isNotNull()).select(*by, reason.alias("reason"), error.alias("error"))
