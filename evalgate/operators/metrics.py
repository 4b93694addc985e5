"""Evaluation metrics over the ``scores`` fact, for all groups in one job.

Scale notes. Every operator first collapses pixels to ``(by, prob)`` counts or to
partial sums, so the shuffle carries pre-aggregated rows. Ranks and running counts of a group that one task can
sort are one window. Groups of more than ``CELL_ROWS`` rows are taken in two levels: a count per (group, score cell), a
running sum over those few cells, and a window inside one cell. Cells are placed by the mass of scores, so one hot group
spreads over hundreds of cells of about equal size and is never sorted by a single task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalgate.functions.columns import bounded_join, first_reason, floored_ratio, grouped, null_safe_join, reasons
from evalgate.functions.scores import (
    CELL_ROWS,
    EVEN_THRESHOLDS,
    QUANTILE_STEPS,
    QUANTILES,
    SWEEP_METRICS,
    cell_borders,
    cell_of,
    confusion_columns,
    ece_bin,
    f_scores,
    is_positive,
)
from evalgate.session import checkpointed

# Positive-rate caps reported by the threshold risk summary.
RISK_CAPS = [2.0, 2.5, 3.0, 3.5]
LOG_LOSS_EPS = 1e-7


@dataclass
class EvalConfig:
    """Evaluation settings of one job; a rate target is a number, ``"auto_val"`` or None."""

    fixed_threshold: float = 0.5
    max_ratio: float | None = None
    min_ratio: float | None = None
    target_rate: float | str | None = None
    bins: int = 15
    dice_fixed_f1: bool = False
    caps: list[float] = field(default_factory=lambda: list(RISK_CAPS))


# ---------------------------------------------------------------- counts at one threshold


def confusion(scores: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    scores, by = grouped(scores, by)
    pred, truth = F.col("prob") >= threshold, is_positive(F.col("label"))
    counts = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
    )
    cols = confusion_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("n"))
    return counts.select(*by, F.lit(float(threshold)).alias("threshold"), "n", "tp", "fp", "fn",
                         *[c.alias(k) for k, c in cols.items()])


def dice_value(tp: Column, fp: Column, fn: Column) -> Column:
    return 2.0 * tp / (2.0 * tp + fp + fn + 1e-12)


def dice(scores: DataFrame, threshold: float, by: list[str], mask: str | None = None) -> DataFrame:
    """Dice with an optional mask column; masked-out pixels do not count."""
    scores, by = grouped(scores, by)
    kept = F.coalesce(F.col(mask).cast("boolean"), F.lit(False)) if mask else F.lit(True)
    pred, truth = F.col("prob") >= threshold, F.col("label") >= 0.5
    return (
        scores.groupBy(*by)
        .agg(
            F.count_if(kept & pred & truth).alias("tp"),
            F.count_if(kept & pred & ~truth).alias("fp"),
            F.count_if(kept & ~pred & truth).alias("fn"),
        )
        .withColumn("dice", dice_value(F.col("tp"), F.col("fp"), F.col("fn")))
    )


def metric_discrepancy(scores: DataFrame, threshold: float, by: list[str], tolerance: float = 0.005) -> DataFrame:
    """Both F1 forms from one count; ``flagged`` when they differ by more than the tolerance."""
    out = confusion(scores, threshold, by)
    keys = [c for c in out.columns if c not in {"threshold", "n", "tp", "fp", "fn", *SWEEP_METRICS}]
    d = dice_value(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select(*keys, "f1", d.alias("dice"), (F.abs(F.col("f1") - d) > tolerance).alias("flagged"))


# ---------------------------------------------------------------- value counts and running counts


def value_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, prob) -> n, pos; combined map-side, ties become one row."""
    return scores.groupBy(*by, "prob").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_positive(F.col("label"))).alias("pos")
    )


def counted(scores: DataFrame, by: list[str]) -> DataFrame:
    """`value_counts` with the sum of labels: everything but the order of mixed ties follows from it."""
    return scores.groupBy(*by, "prob").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_positive(F.col("label"))).alias("pos"), F.sum(F.col("label").cast("double")).alias("label_sum"))


#: Buckets of group hashes that are counted first, to find the few that can hold a large group.
HOT_BUCKETS = 65_536


def hot_groups(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """Groups with more rows than one task should sort, or None; the input bounds their number (rows / CELL_ROWS).

    A large group lies in a large bucket of hashes. Buckets are few and counted map-side, so groups are shuffled only
    if one of theirs is large.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(HOT_BUCKETS))
    large = checkpointed(rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS).select("_bucket"))
    if large.isEmpty():
        return None
    found = rows.select(*by, bucket.alias("_bucket")).join(F.broadcast(large), "_bucket", "left_semi")
    hot = checkpointed(found.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS).select(*by))
    return None if hot.isEmpty() else hot


def running_counts(values: DataFrame, by: list[str], then: list[str] | None = None, borders: list[float] | None = None,
                   hot: DataFrame | None = None) -> DataFrame:
    """Add counts down to and including each row (``ge_n``, ``ge_pos``), group totals (``all_n``,
    ``all_pos``) and the next higher and lower scores (``hi_prob``, ``lo_prob``); rows are ordered by prob descending,
    then by ``then``. Groups in ``hot`` (all without it) are cut into cells, with the given borders or those of the
    values themselves; without borders (an empty list) every group is one window."""
    borders = cell_borders(values, "prob")[0] if borders is None else borders
    order = [F.col("prob").desc(), *(then or [])]
    if not borders:
        group = W.partitionBy(*by).orderBy(*order)
        down = group.rowsBetween(W.unboundedPreceding, 0)
        whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return values.withColumns({
            "all_n": F.sum("n").over(whole), "all_pos": F.sum("pos").over(whole), "ge_n": F.sum("n").over(down), "ge_pos": F.sum("pos").over(down),
            "hi_prob": F.lag("prob").over(group), "lo_prob": F.lead("prob").over(group)})
    cell = cell_of(F.col("prob"), borders)
    if hot is not None:
        values = bounded_join(values, hot.withColumn("_hot", F.lit(True)), by, "left")
        cell = F.when(F.col("_hot"), cell).otherwise(0)
    values = values.withColumn("_cell", cell).drop("_hot")
    cells = values.groupBy(*by, "_cell").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"), F.min("prob").alias("_min"), F.max("prob").alias("_max"))
    group = W.partitionBy(*by)
    down = group.orderBy(F.col("_cell").desc())
    above = down.rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        *by,
        "_cell",
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_off_n"),
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_off_pos"),
        F.lag("_min").over(down).alias("_above"),
        F.lead("_max").over(down).alias("_below"),
        F.sum("_n").over(group).alias("all_n"),
        F.sum("_pos").over(group).alias("all_pos"),
    )
    ordered = W.partitionBy(*by, "_cell").orderBy(*order)
    inside = ordered.rowsBetween(W.unboundedPreceding, 0)
    return (
        null_safe_join(values, cells, [*by, "_cell"])
        .withColumn("ge_n", F.sum("n").over(inside) + F.col("_off_n"))
        .withColumn("ge_pos", F.sum("pos").over(inside) + F.col("_off_pos"))
        .withColumn("hi_prob", F.coalesce(F.lag("prob").over(ordered), F.col("_above")))
        .withColumn("lo_prob", F.coalesce(F.lead("prob").over(ordered), F.col("_below")))
        .drop("_cell", "_off_n", "_off_pos", "_above", "_below")
    )


def _counted_down(scores: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Running counts of the values, with cells for the hot groups of the scores only."""
    hot = hot_groups(scores, by)
    return running_counts(values, by, borders=[] if hot is None else cell_borders(scores, "prob")[0], hot=hot)


#: Positives of one score that are summed term by term; longer runs are ranked as rows.
TERMS = 256


def average_precision(scores: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Mean precision at the rank of each positive; 0 when a group has none. Ranks follow (prob desc, order asc).

    A group that one task can sort is ranked by one window, with one shuffle of its rows. Larger ones are never sorted whole.
    """
    scores, by = grouped(scores, by)
    cold, large = _by_size(scores, by)
    out = _ranked_precision(cold, by, order).select(*by, "positives", "average_precision")
    return out if large is None else out.unionByName(_ranged_precision(large, by, order))


def evaluated(scores: DataFrame, threshold: float, by: list[str], order: list[str]) -> DataFrame:
    """`confusion` at one threshold with `average_precision` (and `positives`) beside it: small groups are shuffled once for both."""
    scores, by = grouped(scores, by)
    cold, large = _by_size(scores, by)
    pred = F.col("prob") >= threshold
    out = _ranked_precision(cold, by, order, pred)
    if large is not None:
        counts = confusion(large, threshold, by).select(*by, "n", "tp", "fp", "fn")
        out = out.unionByName(null_safe_join(_ranged_precision(large, by, order), counts, by))
    cols = confusion_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("n"))
    return out.select(*by, "n", "tp", "fp", "fn", *[c.alias(k) for k, c in cols.items()], "positives", "average_precision")


def _by_size(scores: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups that one task can sort, and those of larger ones if there are any."""
    hot = hot_groups(scores, by)
    if hot is None:
        return scores, None
    marked = bounded_join(scores, hot.withColumn("_hot", F.lit(True)), by, "left")
    return marked.filter(F.col("_hot").isNull()).drop("_hot"), marked.filter("_hot").drop("_hot")


def _ranked_precision(scores: DataFrame, by: list[str], order: list[str], pred: Column | None = None) -> DataFrame:
    ranks = W.partitionBy(*by).orderBy(F.col("prob").desc(), *order)
    down = ranks.rowsBetween(W.unboundedPreceding, 0)
    extra = [c for c in order if c not in by]
    ranked = scores.select(*by, "prob", *extra, is_positive(F.col("label")).cast("long").alias("pos")).select(
        *by, "pos", (F.lit(True) if pred is None else pred).alias("_pred"), F.row_number().over(ranks).alias("rank"), F.sum("pos").over(down).alias("hits"))
    truth = F.col("pos") == 1
    found = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_pred") & truth).alias("tp"), F.count_if(F.col("_pred") & ~truth).alias("fp"),
        F.count_if(~F.col("_pred") & truth).alias("fn"), F.sum("pos").alias("positives"), F.sum(F.when(truth, F.col("hits") / F.col("rank"))).alias("_sum"))
    return found.select(*by, "n", "tp", "fp", "fn", "positives", F.when(F.col("positives") > 0, F.col("_sum") / F.col("positives")).otherwise(0.0).alias("average_precision"))


def _ranged_precision(scores: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Average precision of large groups.

    Equal scores are cut into ranges of the first order column, by the mass of its values. A range whose rows are all positive
    has known hits and ranks, one without a positive adds nothing; only rows of mixed ranges are ranked one by one.
    """
    extra = [c for c in order if c not in by]
    borders, ids = cell_borders(scores, "prob", order[0])
    rows = scores.select(*by, "prob", *extra, is_positive(F.col("label")).cast("long").alias("pos")).withColumn("_range", cell_of(F.col(order[0]), ids))
    blocks = rows.groupBy(*by, "prob", "_range").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))
    cum = running_counts(blocks, by, ["_range"], borders)
    before_n, before_pos = F.col("ge_n") - F.col("n"), F.col("ge_pos") - F.col("pos")
    long = (F.col("pos") > 0) & ((F.col("pos") < F.col("n")) | (F.col("n") > TERMS))
    terms = F.aggregate(F.sequence(F.lit(1), F.when(long, 1).otherwise(F.col("n").cast("int"))), F.lit(0.0), lambda s, k: s + (before_pos + k) / (before_n + k))
    part = F.when((F.col("pos") == 0) | long, 0.0).when(F.col("n") == 1, (before_pos + 1) / (before_n + 1)).otherwise(terms)
    whole = cum.groupBy(*by).agg(F.max("all_pos").alias("positives"), F.sum(part).alias("_sum"))
    mixed = cum.filter(long).select(*by, "prob", "_range", before_n.alias("_before_n"), before_pos.alias("_before_pos"))
    inside = W.partitionBy(*by, "prob", "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ranked = null_safe_join(rows, mixed, [*by, "prob", "_range"]).select(
        *by, "pos", (F.count(F.lit(1)).over(inside) + F.col("_before_n")).alias("rank"), (F.sum("pos").over(inside) + F.col("_before_pos")).alias("hits"))
    ties = ranked.filter("pos = 1").groupBy(*by).agg(F.sum(F.col("hits") / F.col("rank")).alias("_ties"))
    total = F.col("_sum") + F.coalesce("_ties", F.lit(0.0))
    return null_safe_join(whole, ties, by, "left").select(
        *by, "positives", F.when(F.col("positives") > 0, total / F.col("positives")).otherwise(0.0).alias("average_precision"))


# ---------------------------------------------------------------- calibration and score statistics


def calibration_error(scores: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error; bin sums first, then one small aggregate per group."""
    scores, by = grouped(scores, by)
    per_bin = scores.groupBy(*by, ece_bin(F.col("prob"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("prob").alias("conf"),
        F.count_if(is_positive(F.col("label"))).alias("pos"),
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") / F.col("n") - F.col("pos") / F.col("n")) * F.col("n"))
    return per_bin.groupBy(*by).agg(
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("expected_calibration_error")
    )


def _loss_terms() -> dict[str, Column]:
    p, y = F.col("prob").cast("double"), F.col("label").cast("double")
    truth = is_positive(F.col("label")).cast("double")
    return {
        "brier_score": F.avg((p - truth) * (p - truth)),
        "log_loss": -F.avg(y * F.ln(p + LOG_LOSS_EPS) + (1.0 - y) * F.ln(1.0 - p + LOG_LOSS_EPS)),
    }


def brier_log_loss(scores: DataFrame, by: list[str]) -> DataFrame:
    scores, by = grouped(scores, by)
    return scores.groupBy(*by).agg(*[c.alias(k) for k, c in _loss_terms().items()])


def ap_lift(ap: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Prevalence and average precision over prevalence."""
    scores, by = grouped(scores, by)
    rate = scores.groupBy(*by).agg(F.avg(is_positive(F.col("label")).cast("double")).alias("val_positive_rate"))
    return null_safe_join(ap, rate, by).withColumn(
        "ap_prevalence_lift", floored_ratio(F.col("average_precision"), F.col("val_positive_rate"), 1e-12)
    )


def ranked_lift(scores: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`ap_lift` straight from the scores, from one pass over them."""
    scores, by = grouped(scores, by)
    rate = (F.col("positives") / F.col("n")).alias("val_positive_rate")
    return evaluated(scores, 0.5, by, order).select(*by, "positives", "average_precision", rate).withColumn(
        "ap_prevalence_lift", floored_ratio(F.col("average_precision"), F.col("val_positive_rate"), 1e-12))


def quantiles(cum: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles from running counts: ``(by, q_index, threshold, ge_n, ge_pos)``.

    Each distinct score knows the ranks it covers and the next higher score, so it works out
    its own quantiles: no group is held in one aggregation buffer and nothing is shuffled.
    ``ge_*`` count scores at or above the quantile.
    """
    n, below = F.col("all_n"), F.col("all_n") - F.col("ge_n")
    steps = (n - 1).cast("double")
    index = F.sequence(F.lit(0), F.lit(len(probs) - 1))
    table = F.array(*[F.lit(p) for p in probs])
    rows = cum.withColumns({"_below": below, "_steps": steps})

    def at(i: Column) -> Column:
        return F.col("_steps") * F.element_at(table, i + 1)

    def covered(i: Column) -> Column:
        return (F.floor(at(i)) >= F.col("_below")) & (F.floor(at(i)) < F.col("_below") + F.col("n"))

    def value(i: Column) -> Column:
        same = F.col("hi_prob").isNull() | (F.floor(at(i)) + 1 < F.col("_below") + F.col("n"))
        return F.when(same, F.col("prob")).otherwise(F.col("prob") + (F.col("hi_prob") - F.col("prob")) * (at(i) - F.floor(at(i))))

    hits = F.filter(index, covered)
    pairs = F.transform(hits, lambda i: F.struct(i.alias("q_index"), value(i).alias("threshold")))
    found = rows.select(*by, "prob", "n", "pos", "ge_n", "ge_pos", "all_n", "all_pos", F.inline(pairs))
    above = F.col("threshold") > F.col("prob")
    return found.select(*by, "q_index", "threshold", F.when(above, F.col("ge_n") - F.col("n")).otherwise(F.col("ge_n")).alias("ge_n"),
                        F.when(above, F.col("ge_pos") - F.col("pos")).otherwise(F.col("ge_pos")).alias("ge_pos"), "all_n", "all_pos")


def score_stats(scores: DataFrame, by: list[str]) -> DataFrame:
    scores, by = grouped(scores, by)
    values = value_counts(scores, by)
    base = values.groupBy(*by).agg(
        F.min("prob").alias("prob_min"),
        (F.sum(F.col("prob") * F.col("n")) / F.sum("n")).alias("prob_mean"),
        F.max("prob").alias("prob_max"),
    )
    p95 = quantiles(_counted_down(scores, values, by), by, [0.95]).select(*by, F.col("threshold").alias("prob_p95"))
    return null_safe_join(base, p95, by)


# ---------------------------------------------------------------- threshold sweep


def _with_metrics(counts: DataFrame, kept: list[str]) -> DataFrame:
    """Metrics of each row of counts; precision and recall are columns of their own first, so that F scores don't repeat them."""
    plain = counts.select(*kept, *[F.col(c).cast("double").alias(f"_{c}") for c in ("ge_pos", "ge_n", "all_pos", "all_n")])
    rates = plain.select(
        *kept, (F.col("_ge_pos") / F.greatest("_ge_n", F.lit(1.0))).alias("precision"), (F.col("_ge_pos") / F.greatest("_all_pos", F.lit(1.0))).alias("recall"),
        (F.col("_ge_n") / F.col("_all_n")).alias("pred_positive_rate"), (F.col("_all_pos") / F.col("_all_n")).alias("val_positive_rate"))
    f05, f1 = f_scores(F.col("precision"), F.col("recall"))
    return rates.select(*kept, "precision", "recall", f05.alias("f05"), f1.alias("f1"), "pred_positive_rate", "val_positive_rate")


def _first_quantile(rank: Column) -> Column:
    """Index of the first quantile at or above a rank of the group; evenly spaced, so a guess by arithmetic is at most one off."""
    gap = (QUANTILES[-1] - QUANTILES[0]) / (QUANTILE_STEPS - 1)
    guess = F.ceil((rank / F.col("_steps") - QUANTILES[0]) / gap) - 1
    start = F.when(F.col("_steps") > 0, F.least(F.greatest(guess, F.lit(0)), F.lit(QUANTILE_STEPS))).otherwise(0).cast("int")
    below = [F.when(F.col("_steps") * F.get(F.array(*[F.lit(q) for q in QUANTILES]), start + i) < rank, 1).otherwise(0) for i in range(3)]
    return start + below[0] + below[1] + below[2]


def _quantile_thresholds(fixed: Column) -> Column:
    """Thresholds of the row of a score: ``fixed`` ones, and the quantiles above the next lower score up to this one.

    An interpolated quantile lies between the last rank of the lower score and this one. Rounding may put it on either: a score
    looks at both of its gaps, so that each threshold belongs to one row. Of the upper gap only the first quantile can round to it.
    """
    table, none = F.array(*[F.lit(q) for q in QUANTILES]), F.array().cast("array<double>")
    prob, low, high, steps = F.col("prob"), F.col("lo_prob"), F.col("hi_prob"), F.col("_steps")
    last = F.col("_below") + F.col("n") - 1
    at = steps * F.get(table, F.col("_own"))
    on = (at < last) | ((at < last + 1) & (high.isNull() | (prob + (high - prob) * (at - last) == prob)))
    own = F.when(on & prob.isNotNull(), F.array(prob)).otherwise(none)
    gap = F.transform(F.slice(table, F.col("_gap") + 1, F.col("_own") - F.col("_gap")), lambda q: low + (prob - low) * (steps * q - (F.col("_below") - 1)))
    gap = F.when(low.isNull() | prob.isNull(), none).otherwise(F.filter(gap, lambda v: v > low))
    return F.array_distinct(F.concat(fixed, gap, own))


def default_steps(cum: DataFrame, by: list[str], fixed: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The default sweep in steps, a narrow change of running counts: a row per distinct score.

    Every threshold above the next lower score up to this one (``thresholds``) has the counts of this row, so its metrics
    are columns. The highest score also holds the thresholds ``beyond`` it, where nothing is predicted positive.
    """
    cuts = sorted({*EVEN_THRESHOLDS, fixed})
    grid, size = F.array(*[F.lit(c) for c in cuts]), len(cuts)
    rows = cum.withColumns({"_below": F.col("all_n") - F.col("ge_n"), "_steps": (F.col("all_n") - 1).cast("double"),
                            "_to": cell_of(F.col("prob"), cuts), "_from": cell_of(F.col("lo_prob"), cuts)})
    rows = rows.withColumn("_own", _first_quantile(F.col("_below")))
    rows = rows.withColumn("_gap", F.when(F.col("lo_prob").isNull(), F.col("_own")).otherwise(F.least("_own", _first_quantile(F.col("_below") - 1))))
    none = F.array().cast("array<double>")
    rows = rows.select(*by, *keep, "ge_n", "ge_pos", "all_n", "all_pos",
                       _quantile_thresholds(F.slice(grid, F.col("_from") + 1, F.col("_to") - F.col("_from"))).alias("thresholds"),
                       F.when(F.col("hi_prob").isNull(), F.slice(grid, F.col("_to") + 1, size - F.col("_to"))).otherwise(none).alias("beyond"))
    lowest = [F.array_min("thresholds").alias("lowest"), F.get("beyond", 0).alias("lowest_beyond")]
    return _with_metrics(rows.select("*", *lowest), [*by, *keep, "thresholds", "beyond", "lowest", "lowest_beyond"])


def sweep_steps(scores: DataFrame, by: list[str], fixed: float = 0.5) -> DataFrame:
    """`threshold_sweep` over the default grid in steps (``default_steps``). Selections take either form."""
    scores, by = grouped(scores, by)
    return default_steps(_counted_down(scores, value_counts(scores, by), by), by, fixed)


def _points(rows: DataFrame) -> list[dict[str, Column]]:
    """What a row offers for selection: lowest threshold, metrics, number of thresholds and all of them."""
    plain = {c: F.col(c) for c in (*SWEEP_METRICS, "val_positive_rate")}
    if "thresholds" not in rows.columns:
        return [plain | {"threshold": F.col("threshold"), "count": F.lit(1), "all": F.array("threshold")}]
    zero = {c: F.lit(0.0) for c in SWEEP_METRICS} | {"val_positive_rate": F.col("val_positive_rate")}
    return [p | {"threshold": F.col(low), "count": F.size(a), "all": F.col(a)}
            for p, a, low in ((plain, "thresholds", "lowest"), (zero, "beyond", "lowest_beyond"))]


def _best_point(rows: DataFrame, key, allowed=lambda p: F.lit(True)) -> Column:
    """Aggregate: the allowed point with the greatest key, which ends with the lowest threshold."""
    found = [F.when(p["threshold"].isNotNull() & allowed(p), F.struct(
        F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key(p))]).alias("key"),
        F.struct(*[p[c].alias(c) for c in ("threshold", *SWEEP_METRICS)]).alias("point"))) for p in _points(rows)]
    return F.max(found[0] if len(found) == 1 else F.greatest(*found))["point"]


def _flat(steps: DataFrame, by: list[str]) -> DataFrame:
    """Steps as one row per threshold."""
    held = lambda own: lambda v: F.struct(v.alias("threshold"), F.lit(own).alias("_own"))
    rows = steps.select(*by, *SWEEP_METRICS, "val_positive_rate", F.inline(F.concat(F.transform("thresholds", held(True)), F.transform("beyond", held(False)))))
    return rows.select(*by, "threshold", *[F.when(F.col("_own"), F.col(c)).otherwise(0.0).alias(c) for c in SWEEP_METRICS], "val_positive_rate")


def threshold_grid(scores: DataFrame, by: list[str], fixed: float = 0.5) -> DataFrame:
    """Distinct thresholds per group: even points, score quantiles and the fixed one."""
    scores, by = grouped(scores, by)
    return _flat(sweep_steps(scores, by, fixed), by).select(*by, "threshold")


def approximate_grid(scores: DataFrame, by: list[str], fixed: float = 0.5, accuracy: int = 10_000) -> DataFrame:
    """`threshold_grid` with quantiles from a mergeable summary: one aggregate, whose size per group doesn't grow with its scores.

    A quantile threshold is a score of the group whose rank is off by the group's rows over ``accuracy`` at most; the exact grid
    interpolates between neighbours, this one doesn't.
    """
    scores, by = grouped(scores, by)
    summary = scores.groupBy(*by).agg(F.percentile_approx(F.col("prob").cast("double"), QUANTILES, accuracy).alias("q"))
    points = F.array(*[F.lit(t) for t in [*EVEN_THRESHOLDS, fixed]])
    return summary.select(*by, F.explode(F.array_distinct(F.concat(points, "q"))).alias("threshold"))


def threshold_sweep(scores: DataFrame, by: list[str], grid: DataFrame | None = None, fixed: float = 0.5) -> DataFrame:
    """Confusion metrics at every threshold of the default grid, or of ``grid(by, threshold)``.

    A given grid is merged into the value counts as empty marker rows, so the sweep is one
    running sum and never a pixels x thresholds join.
    """
    scores, by = grouped(scores, by)
    if grid is None:
        return _flat(sweep_steps(scores, by, fixed), by)
    values = value_counts(scores, by)
    markers = grid.select(*by, F.col("threshold").cast("double").alias("prob"), F.lit(0).cast("long").alias("n"),
                          F.lit(0).cast("long").alias("pos"), F.lit(1).alias("_marker")).distinct()
    merged = values.withColumn("prob", F.col("prob").cast("double")).withColumn("_marker", F.lit(0)).unionByName(markers)
    cum = running_counts(merged, by, ["_marker"], cell_borders(scores, "prob")[0]).filter("_marker = 1 AND all_n > 0")
    return _with_metrics(cum.withColumnRenamed("prob", "threshold"), [*by, "threshold"])


# ---------------------------------------------------------------- operating point


def _target(cfg: EvalConfig) -> Column | None:
    if cfg.target_rate is None:
        return None
    if isinstance(cfg.target_rate, str):
        if cfg.target_rate.strip().lower() not in {"auto", "auto_val", "val"}:
            raise ValueError("target rate must be a number or auto_val")
        return F.col("val_positive_rate")
    return F.lit(float(cfg.target_rate))


def _ratio_of(p: dict[str, Column]) -> Column:
    return floored_ratio(p["pred_positive_rate"], p["val_positive_rate"], 1e-12)


def _selection(rows: DataFrame, cfg: EvalConfig) -> list[Column]:
    """Aggregates of ``select_threshold``."""
    target = _target(cfg)

    def key(metric: str):
        return lambda p: [p[metric], -F.abs(p["pred_positive_rate"] - target) if target is not None else F.lit(0.0), p["precision"],
                          -p["pred_positive_rate"], -p["threshold"]]

    def in_band(p: dict[str, Column]) -> Column:
        ok = F.lit(True)
        if cfg.max_ratio is not None:
            ok = ok & (_ratio_of(p) <= float(cfg.max_ratio))
        if cfg.min_ratio is not None:
            ok = ok & (_ratio_of(p) >= float(cfg.min_ratio))
        return ok

    return [_best_point(rows, key("f1")).alias("any"), _best_point(rows, key("f1"), in_band).alias("banded"),
            _best_point(rows, key("f05"))["f05"].alias("val_f05"), F.max("val_positive_rate").alias("val_positive_rate")]


def _chosen(cfg: EvalConfig) -> dict[str, Column]:
    banded = cfg.max_ratio is not None or cfg.min_ratio is not None
    return {"best": F.coalesce("banded", "any"),
            "threshold_selection": F.when(F.col("banded").isNotNull() & F.lit(banded), "positive_rate_constrained").otherwise("best_f1")}


def select_threshold(rows: DataFrame, by: list[str], cfg: EvalConfig) -> DataFrame:
    """Best F1 inside the ratio band (all rows when it is empty) and unconstrained best F0.5; of sweep rows or steps."""
    found = rows.groupBy(*by).agg(*_selection(rows, cfg)).withColumns(_chosen(cfg))
    return found.select(*by, "best", "val_f05", "val_positive_rate", "threshold_selection")


def selected_columns(selected: DataFrame, by: list[str]) -> DataFrame:
    return selected.select(
        *by,
        F.col("best.threshold").alias("best_threshold"), F.col("best.f1").alias("val_f1"), "val_f05",
        F.col("best.precision").alias("precision"), F.col("best.recall").alias("recall"),
        F.col("best.pred_positive_rate").alias("pred_positive_rate"), "val_positive_rate", "threshold_selection",
    )


def fixed_status_columns(fixed_f1: Column, fixed_rate: Column, fixed_p: Column, fixed_r: Column,
                         best_f1: Column) -> dict[str, Column]:
    """Status of the fixed threshold against the selected F1, with the first failing reason."""
    ok = fixed_f1 >= 0.5 * best_f1
    reason = first_reason(
        (ok, "ok"),
        (fixed_rate <= 0.0, "no_fixed_positive_predictions"),
        (fixed_p <= 0.0, "fixed_zero_precision"),
        (fixed_r <= 0.0, "fixed_zero_recall"),
        default="weak_relative_to_selected_f1",
    )
    return {"fixed_threshold_status": F.when(ok, "ok").otherwise("weak"), "fixed_threshold_failure_reason": reason}


def _at_fixed(rows: DataFrame, fixed: float) -> Column:
    """Aggregate: the point of the fixed threshold."""
    points = [F.when(F.array_contains(p["all"], fixed), F.struct(*[p[c].alias(c) for c in SWEEP_METRICS])) for p in _points(rows)]
    return F.max(F.coalesce(*points))


def fixed_status(scores: DataFrame, by: list[str], cfg: EvalConfig) -> DataFrame:
    scores, by = grouped(scores, by)
    rows = sweep_steps(scores, by, cfg.fixed_threshold)
    found = rows.groupBy(*by).agg(*_selection(rows, cfg), _at_fixed(rows, cfg.fixed_threshold).alias("fixed")).withColumns(_chosen(cfg))
    cols = fixed_status_columns(F.col("fixed.f1"), F.col("fixed.pred_positive_rate"), F.col("fixed.precision"), F.col("fixed.recall"), F.col("best.f1"))
    return found.select(*by, F.col("fixed.f1").alias("fixed_threshold_f1"), F.col("best.f1").alias("val_f1"), *[c.alias(k) for k, c in cols.items()])


def _cap_key(p: dict[str, Column]) -> list[Column]:
    return [p["f1"], p["precision"], -p["pred_positive_rate"], -p["threshold"]]


def caps_by_group(rows: DataFrame, by: list[str], caps: list[float]) -> DataFrame:
    """One row per group: for each cap the best row within it and how many rows were eligible (``caps``); of sweep rows or steps."""

    def one(cap: float) -> Column:
        ok = lambda p: _ratio_of(p) <= cap
        counts = [F.when(ok(p), p["count"]).otherwise(0) for p in _points(rows)]
        return F.struct(
            F.lit(float(cap)).alias("cap"),
            F.sum(reduce(lambda a, b: a + b, counts).cast("long")).alias("eligible_threshold_count"),
            _best_point(rows, _cap_key, ok).alias("best"),
        )

    return rows.groupBy(*by).agg(F.array(*[one(c) for c in caps]).alias("caps"), _best_point(rows, _cap_key).alias("unconstrained"),
                                 F.max("val_positive_rate").alias("val_positive_rate"))


def best_under_caps(rows: DataFrame, by: list[str], caps: list[float]) -> DataFrame:
    """One row per (group, cap): best row within the cap and how many rows were eligible; of sweep rows or steps."""
    return caps_by_group(rows, by, caps).select(*by, "unconstrained", "val_positive_rate", F.inline("caps"))


def threshold_risk(rows: DataFrame, selected: DataFrame, by: list[str], cfg: EvalConfig) -> DataFrame:
    """Cap comparison rows per group: retained F1/F0.5 against the selected and unconstrained rows."""
    caps = list(cfg.caps)
    if cfg.max_ratio is not None and float(cfg.max_ratio) not in caps:
        caps.append(float(cfg.max_ratio))
    table = null_safe_join(best_under_caps(rows, by, caps), selected.select(*by, F.col("best").alias("selected")), by)

    def floor(name: str) -> Column:
        return F.greatest(F.col(name), F.lit(1e-12))

    sel_ratio = floored_ratio(F.col("selected.pred_positive_rate"), F.col("val_positive_rate"), 1e-12)
    binding = reasons(*[(F.abs(sel_ratio - c) <= 0.15, "x") for c in RISK_CAPS])
    configured = F.lit(False) if cfg.max_ratio is None else F.abs(F.col("cap") - float(cfg.max_ratio)) < 1e-9
    return table.select(
        *by, "cap", configured.alias("configured"), "eligible_threshold_count",
        F.col("best.threshold").alias("best_threshold"), F.col("best.f1").alias("best_f1"),
        F.col("best.f05").alias("best_f05"), F.col("best.pred_positive_rate").alias("best_pred_positive_rate"),
        (F.col("best.f1") / floor("selected.f1")).alias("f1_retained_vs_selected"),
        (F.col("best.f05") / floor("selected.f05")).alias("f05_retained_vs_selected"),
        (F.col("best.f1") / floor("unconstrained.f1")).alias("f1_retained_vs_unconstrained"),
        (F.col("best.f05") / floor("unconstrained.f05")).alias("f05_retained_vs_unconstrained"),
        sel_ratio.alias("selected_pred_to_val_ratio"), (F.size(binding) > 0).alias("cap_binding"),
    )


# ---------------------------------------------------------------- full record


def evaluate(scores: DataFrame, by: list[str], order: list[str], cfg: EvalConfig | None = None,
             with_risk: bool = False) -> DataFrame:
    """The full evaluation record of every group.

    Scores are read twice: once to be counted by value, and once more to be ranked with their ties. Running counts hold all that
    the record needs besides, so it is one aggregate of their rows; nothing is written.
    """
    cfg = cfg or EvalConfig()
    scores, by = grouped(scores, by)
    values = counted(scores, by)
    cum = _counted_down(scores, values, by)
    cum = cum.withColumns({"_p95": _interpolated(0.95), "_bin": ece_bin(F.col("prob"), cfg.bins)})
    rows = default_steps(cum, by, cfg.fixed_threshold, ("prob", "n", "pos", "label_sum", "_p95", "_bin"))
    out = rows.groupBy(*by).agg(*_selection(rows, cfg), _at_fixed(rows, cfg.fixed_threshold).alias("fixed"), F.max("_p95").alias("prob_p95"),
                                *[c.alias(k) for k, c in _value_statistics(cfg.bins).items()]).withColumns(_chosen(cfg))
    fixed_f1 = F.col("fixed.f1")
    if cfg.dice_fixed_f1:
        alt = dice(scores, cfg.fixed_threshold, by).select(*by, F.col("dice").alias("_dice"))
        out, fixed_f1 = null_safe_join(out, alt, by), F.col("_dice")
    status = fixed_status_columns(fixed_f1, F.col("fixed.pred_positive_rate"), F.col("fixed.precision"), F.col("fixed.recall"), F.col("best.f1"))
    out = out.select(
        *by, F.col("best.threshold").alias("best_threshold"), F.col("best.f1").alias("val_f1"), "val_f05", F.col("best.precision").alias("precision"),
        F.col("best.recall").alias("recall"), F.col("best.pred_positive_rate").alias("pred_positive_rate"), "val_positive_rate", "threshold_selection",
        fixed_f1.alias("fixed_threshold_f1"), F.col("fixed.precision").alias("fixed_threshold_precision"), F.col("fixed.recall").alias("fixed_threshold_recall"),
        *[c.alias(k) for k, c in status.items()], *_STATISTICS, "prob_p95")
    out = null_safe_join(out, average_precision(scores, by, order).select(*by, "average_precision"), by)
    out = out.withColumn(
        "ap_prevalence_lift", floored_ratio(F.col("average_precision"), F.col("val_positive_rate"), 1e-12)
    )
    if with_risk:
        risk = threshold_risk(rows, select_threshold(rows, by, cfg), by, cfg)
        listed = [c for c in risk.columns if c not in by]
        risk = risk.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*listed))).alias("threshold_risk_summary"))
        out = null_safe_join(out, risk, by)
    return out


def _interpolated(q: float) -> Column:
    """The quantile of the group on the row whose ranks hold it, else NULL."""
    at = (F.col("all_n") - 1).cast("double") * q
    below, rank = F.col("all_n") - F.col("ge_n"), F.floor(at)
    value = F.when(F.col("hi_prob").isNull() | (rank + 1 < below + F.col("n")), F.col("prob")).otherwise(
        F.col("prob") + (F.col("hi_prob") - F.col("prob")) * (at - rank))
    return F.when((rank >= below) & (rank < below + F.col("n")), value)


_STATISTICS = ["expected_calibration_error", "pixels", "prob_min", "prob_mean", "prob_max", "brier_score", "log_loss"]


def _value_statistics(bins: int) -> dict[str, Column]:
    """Aggregates of counted values with their ``_bin``: calibration error, losses and score statistics."""
    p, n, pos, y = F.col("prob").cast("double"), F.col("n"), F.col("pos"), F.col("label_sum")
    brier = n * p * p - 2.0 * p * pos + pos
    loss = y * F.ln(p + LOG_LOSS_EPS) + (n - y) * F.ln(1.0 - p + LOG_LOSS_EPS)
    total, place = F.sum("n"), F.col("_bin")

    def gap(b: int) -> Column:
        held, conf, hits = (F.sum(F.when(place == b, c)) for c in (n, p * n, pos))
        return F.coalesce(F.abs(conf / held - hits / held) * held, F.lit(0.0))

    found = [reduce(lambda a, b: a + b, [gap(b) for b in range(bins)]) / total, total, F.min("prob"), F.sum(p * n) / total, F.max("prob"),
             F.sum(brier) / total, -F.sum(loss) / total]
    return dict(zip(_STATISTICS, found, strict=True))


# ---------------------------------------------------------------- loss diagnostics


@dataclass
class LossConfig:
    focal_alpha: float = 0.25
    focal_gamma: float = 2.0
    tversky_alpha: float = 0.3
    tversky_beta: float = 0.7
    tversky_gamma: float = 1.0
    bce_weight: float = 0.5
    dice_weight: float = 0.5
    target_rate: float = 0.1
    tolerance: float = 0.0


def loss_metrics(scores: DataFrame, patch: list[str], by: list[str], cfg: LossConfig | None = None) -> DataFrame:
    """Soft Dice and Tversky per patch then averaged; focal, BCE and rate excess over pixels."""
    cfg = cfg or LossConfig()
    scores, by = grouped(scores, by)
    eps = 1e-12
    p = F.least(F.greatest(F.col("prob").cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col("label").cast("double")
    truth = is_positive(F.col("label"))
    bce = -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))
    pt = F.when(truth, p).otherwise(1.0 - p)
    alpha = F.when(truth, cfg.focal_alpha).otherwise(1.0 - cfg.focal_alpha)
    keys = [*by, *[c for c in patch if c not in by]]
    sums = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p * y).alias("tp"), F.sum(p).alias("sp"), F.sum(y).alias("sy"),
        F.sum(p * (1.0 - y)).alias("fp"), F.sum((1.0 - p) * y).alias("fn"), F.sum(bce).alias("bce"),
        F.sum(alpha * F.pow(1.0 - pt, F.lit(cfg.focal_gamma)) * bce).alias("focal"),
    )
    soft_dice = 1.0 - (2.0 * F.col("tp") + 1.0) / (F.col("sp") + F.col("sy") + 1.0)
    tversky = 1.0 - (F.col("tp") + 1.0) / (
        F.col("tp") + cfg.tversky_alpha * F.col("fp") + cfg.tversky_beta * F.col("fn") + 1.0
    )
    if cfg.tversky_gamma != 1.0:
        tversky = F.pow(tversky, F.lit(cfg.tversky_gamma))
    total = F.sum("n")
    excess = F.greatest(F.lit(0.0), F.abs(F.sum("sp") / total - cfg.target_rate) - cfg.tolerance)
    return sums.groupBy(*by).agg(
        F.avg(soft_dice).alias("soft_dice_loss"),
        (F.sum("bce") / total).alias("bce_loss"),
        (F.sum("focal") / total).alias("focal_loss"),
        (cfg.bce_weight * F.sum("bce") / total + cfg.dice_weight * F.avg(soft_dice)).alias("combo_loss"),
        F.avg(tversky).alias("tversky_loss"),
        (excess * excess).alias("rate_excess_loss"),
    )


def positive_weight(scores: DataFrame, by: list[str], cap: float = 10.0) -> DataFrame:
    """min(sqrt(neg/pos), cap) with both counts floored at 1."""
    scores, by = grouped(scores, by)
    pos = F.greatest(F.count_if(is_positive(F.col("label"))), F.lit(1)).cast("double")
    neg = F.greatest(F.count_if(~is_positive(F.col("label"))), F.lit(1)).cast("double")
    return scores.groupBy(*by).agg(F.least(F.sqrt(neg / pos), F.lit(cap)).alias("pos_weight"))
