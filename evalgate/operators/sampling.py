"""Samples and batches in hash order.

Draws are ordered by ``md5(seed|id)``: the same rows come out whatever the partitioning or
engine. Ranks inside a group use hash-prefix cells, so a hot group is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalgate.functions.columns import hash_order, hash_uniform, null_safe_join


def hash_rank(df: DataFrame, by: list[str], seed: int | str, ids: list[str], name: str = "rank") -> DataFrame:
    """1-based rank of each row in its group's hash order, with the group size as ``<name>_n``."""
    rows = df.withColumn("_h", hash_order(seed, *[F.col(i) for i in ids])).withColumn("_cell", F.substring("_h", 1, 3))
    cells = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    before = group.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(group).alias(f"{name}_n"))
    inside = F.row_number().over(W.partitionBy(*by, "_cell").orderBy("_h", *ids))
    return null_safe_join(rows, cells, [*by, "_cell"]).withColumn(name, inside + F.col("_off")).drop("_h", "_cell", "_off")


def sample_n(df: DataFrame, n: int, seed: int, ids: list[str], by: list[str] | None = None) -> DataFrame:
    """n rows without replacement per group (all when there are fewer)."""
    return hash_rank(df, by or [], seed, ids, "_rank").filter(F.col("_rank") <= n).drop("_rank", "_rank_n")


def balanced_sample(px: DataFrame, n: int, fraction: float, seed: int, ids: list[str], by: list[str]) -> DataFrame:
    """Positives up to ``round(n*fraction)`` and negatives for the rest of the budget."""
    rows = px.withColumn("_pos", F.col("label") > 0.5)
    ranked = hash_rank(rows, [*by, "_pos"], seed, ids, "_rank")
    size = ranked.groupBy(*by).agg(F.max(F.when(F.col("_pos"), F.col("_rank_n"))).alias("_p"))
    take = F.least(F.coalesce("_p", F.lit(0)), F.lit(int(round(n * fraction))))
    keep = F.col("_rank") <= F.when(F.col("_pos"), take).otherwise(F.lit(n) - take)
    return null_safe_join(ranked.filter(F.col("_rank") <= n), size, by).filter(keep).drop("_pos", "_rank", "_rank_n", "_p")


def hard_mining_sample(patches: DataFrame, n: int, seed: int, ids: list[str], by: list[str], positive_fraction: float = 0.5,
                       hard_fraction: float = 0.5, min_ink: float = 0.001, max_ink: float = 0.0) -> DataFrame:
    """Positives weighted by ink, hard negatives from the most textured pool, random negatives, back-fill.

    Needs ``ink_fraction`` and ``texture``. One window keeps the first rows of four orders per group: n positives by weighted
    hash, 3 n negatives by texture, and 2 n rows of each hash order, enough since the stages before take n rows at most. The
    stages then work on those few rows alone; counts of a group travel as one more row of it, so nothing is joined. Where the
    limits overlap, a patch above ``min_ink`` is a positive only.
    """
    positive = F.col("ink_fraction") > min_ink
    negative = (F.col("ink_fraction") <= max_ink) & ~positive
    idc = [F.col(i) for i in ids]
    row = F.struct(*patches.columns)
    drawn = lambda name: F.conv(F.substring(hash_order(f"{seed}:{name}", *idc), 1, 15), 16, 10).cast("double")
    # one order key per list, smallest first; null leaves a row out of a list
    orders = {
        "positive": F.when(positive, -F.ln(hash_uniform(f"{seed}:positive", *idc)) / F.col("ink_fraction")),
        "pool": F.when(negative, -F.col("texture").cast("double")), "random": F.when(negative, drawn("random")), "fill": drawn("fill"),
    }
    most = {"positive": n, "pool": 3 * n, "random": 2 * n, "fill": 2 * n}
    lists = F.array(*[F.struct(F.lit(k).alias("_list"), o.alias("_key")) for k, o in orders.items()])
    # numbered before the rows are spread over the lists, so that the copies of a row share its number
    numbered = patches.select(*by, row.alias("_row"), F.struct(*ids).alias("_ids"), lists.alias("_lists"), F.monotonically_increasing_id().alias("_no"))
    flat = numbered.select(*by, "_no", "_row", "_ids", F.inline("_lists"))
    first = W.partitionBy(*by, "_list").orderBy("_key", "_ids", "_no")
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("_list")]
    kept = flat.filter("_key IS NOT NULL").withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= 3 * n).filter(F.col("_rank") <= limit)
    ranks = kept.groupBy(*by, "_no").agg(F.first("_row").alias("_row"), F.first("_ids").alias("_ids"), *[F.max(F.when(F.col("_list") == k, F.col("_rank"))).alias(f"_{k}") for k in orders])
    counts = patches.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.count_if(positive).alias("_np"), F.count_if(negative).alias("_nn"))
    group = W.partitionBy(*by)
    rows = ranks.unionByName(counts, allowMissingColumns=True).withColumns({c: F.max(c).over(group) for c in ("_all", "_np", "_nn")}).filter("_no IS NOT NULL")
    rows = rows.withColumn("_tp", F.least(F.col("_np"), F.lit(int(round(n * positive_fraction)))))
    rows = rows.withColumn("_th", F.least(F.col("_nn"), F.bround((n - F.col("_tp")) * hard_fraction).cast("long")))
    rows = rows.withColumn("_tr", F.greatest(F.lit(0), n - F.col("_tp") - F.col("_th")))

    def earliest(mask: Column, order: list[Column]) -> Column:
        """Rank of the masked rows among themselves."""
        return F.when(mask, F.row_number().over(group.orderBy(F.when(mask, 0).otherwise(1), *order)))

    of_row = [F.col(f"_ids.{i}") for i in ids]
    in_pool = F.coalesce(F.col("_pool") <= 3 * F.col("_th"), F.lit(False))
    hashed = hash_order(f"{seed}:hard", *of_row)
    rows = rows.withColumn("_hard", F.coalesce(earliest(in_pool, [hashed, F.col("_ids"), F.col("_no")]) <= F.col("_th"), F.lit(False)))
    free = F.col("_random").isNotNull() & ~F.col("_hard")
    rows = rows.withColumn("_some", F.coalesce(earliest(free, [F.col("_random")]) <= F.col("_tr"), F.lit(False)))
    rows = rows.withColumn("_picked", F.coalesce(F.col("_positive") <= F.col("_tp"), F.lit(False)))
    rows = rows.withColumn("_chosen", F.col("_picked") | F.col("_hard") | F.col("_some")).withColumn("_got", F.count_if("_chosen").over(group))
    spare = ~F.col("_chosen") & F.col("_fill").isNotNull()
    rows = rows.withColumn("_back", F.coalesce(earliest(spare, [F.col("_fill")]) <= n - F.col("_got"), F.lit(False)))
    stage = (F.when(F.col("_all") <= n, "all").when(F.col("_picked"), "positive").when(F.col("_hard"), "hard_negative")
             .when(F.col("_some"), "random_negative").when(F.col("_back"), "fill"))
    return rows.withColumn("stage", stage).filter("stage IS NOT NULL").select("_row.*", "stage")


def curriculum(configs: DataFrame, keys: list[str]) -> DataFrame:
    """Sampling strategy per epoch from ``curriculum`` (name), ``initial, final, switch_epoch`` and ``epochs``.

    A mapping sets ``switch_epoch``, or just ``initial``/``final``; a warm-up name switches half way.
    """
    default = F.greatest(F.lit(1), F.floor(F.coalesce("epochs", F.lit(2)) / 2))
    named = F.col("curriculum").isin("uniform_to_hard_mining", "warmup_then_hard")
    mapped = F.col("initial").isNotNull() | F.col("final").isNotNull() | F.col("switch_epoch").isNotNull()
    switch = F.when(mapped, F.coalesce("switch_epoch", default)).otherwise(default)
    rows = configs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("epochs", F.lit(1)), F.lit(1)).cast("int") - 1)))
    phase = F.when(F.col("epoch") < switch, F.coalesce("initial", F.lit("random"))).otherwise(F.coalesce("final", F.lit("hard_mining")))
    return rows.select(*keys, "epoch", F.when(named | mapped, phase).otherwise(F.col("curriculum")).alias("strategy"))


def batch_size_for(batch: int, groups: int) -> int:
    """Batch size as a multiple of the group count."""
    if groups <= 1 or batch % groups == 0:
        return batch
    lower = batch - batch % groups
    return lower if lower >= groups else groups


def stratified_batches(df: DataFrame, group: str, batch: int, seed: int, ids: list[str], groups: int) -> DataFrame:
    """Batches with an equal share per group; small groups go round again in a new order.

    ``groups`` is the number of distinct groups; the batch size must be a multiple of it.
    """
    if batch < groups or batch % groups:
        raise ValueError("batch size must be a positive multiple of the group count")
    per = batch // groups
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.floor(F.count(F.lit(1)) / batch).cast("int").alias("b"))
    need = total.select((F.col("b") * per).cast("int")).scalar()
    sizes = sizes.withColumn("_need", need)
    cycles = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_need") / F.col("_n")).cast("int") - 1, F.lit(0)))
    rows = null_safe_join(df, sizes.withColumn("_c", cycles), [group]).withColumn("cycle", F.explode("_c")).drop("_c")
    ranked = hash_rank(rows, [group, "cycle"], seed, ["cycle", *ids], "_rank")
    pos = F.col("cycle") * F.col("_n") + F.col("_rank")
    return ranked.withColumn("_p", pos).filter(F.col("_p") <= F.col("_need")).withColumn(
        "batch", F.floor((F.col("_p") - 1) / per).cast("int")).drop("_p", "_n", "_need", "_rank", "_rank_n")


def cursor_batches(df: DataFrame, batch: int, seed: int, ids: list[str], epochs: int, per_epoch: int | None = None) -> DataFrame:
    """A fixed shuffled order read by a cursor that carries on across epochs and wraps at the end."""
    ranked = hash_rank(df, [], seed, ids, "_rank")
    span = F.col("_rank_n") if per_epoch is None else F.lit(per_epoch)
    first = F.col("_rank") - 1
    laps = F.floor((F.lit(epochs) * span - 1 - first) / F.col("_rank_n")).cast("int")
    at = ranked.filter(laps >= 0).withColumn("_lap", F.explode(F.sequence(F.lit(0), laps)))
    slot = first + F.col("_lap") * F.col("_rank_n")
    return at.withColumns({"epoch": F.floor(slot / span).cast("int"), "position": (slot % span).cast("long")}).withColumn(
        "batch", F.floor(F.col("position") / batch).cast("int")).drop("_rank", "_rank_n", "_lap")


def segment_groups(inputs: DataFrame, keys: list[str], sample_count: str, arrival: list[str] | None = None) -> DataFrame:
    """Group index ranges of a combined set from its input list.

    ``inputs`` has one row per (keys, position) with ``segment`` and ``samples``; groups number
    segments by first appearance. Sets whose counts disagree give no rows. Rows of one position are taken in the
    order of the columns ``arrival``, from the smallest up without them, so reruns agree.
    """
    order = W.partitionBy(*keys).orderBy("position", *(arrival or ["samples", "segment"]))
    rows = inputs.withColumn("first_index", F.coalesce(F.sum("samples").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumns({"_total": F.sum("samples").over(W.partitionBy(*keys)), "_seen": F.min("position").over(W.partitionBy(*keys, "segment"))})
    rows = rows.withColumn("group_index", F.dense_rank().over(W.partitionBy(*keys).orderBy("_seen")) - 1)
    return rows.filter(F.col("_total") == F.col(sample_count)).select(*keys, "position", "segment", "samples", "first_index", "group_index")
