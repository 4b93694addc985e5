"""Grid and patch operators.

Pixels are rows ``(keys, c, y, x, v)``. Tiles are assigned by arithmetic on the coordinates,
line windows are partitioned by a row or column of pixels, and arrays are only built for one
patch at a time, so no task holds a whole map.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalgate.functions.columns import grouped, hash_order, hash_uniform, null_safe_join


# ---------------------------------------------------------------- volumes


def select_layers(chunks: DataFrame, z_offsets: list[int]) -> DataFrame:
    """Pixels of the layers ``depth div 2 + offset`` (clipped), read only from chunks holding them."""
    depth = chunks.groupBy("segment_id", "level").agg(F.max(F.col("z0") + F.col("dz")).alias("depth"))
    offsets = F.posexplode(F.array(*[F.lit(o) for o in z_offsets])).alias("c", "offset")
    center = F.floor(F.col("depth") / 2)
    wanted = depth.select("segment_id", "level", "depth", offsets).select(
        "segment_id", "level", "c", F.least(F.greatest(center + F.col("offset"), F.lit(0)), F.col("depth") - 1).cast("int").alias("z"))
    hit = chunks.join(wanted, ["segment_id", "level"]).filter((F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z0") + F.col("dz")))
    plane = (F.col("dy") * F.col("dx")).cast("int")
    layer = F.slice("data", ((F.col("z") - F.col("z0")) * plane + 1).cast("int"), plane)
    px = hit.select("segment_id", "level", "c", "z", "y0", "x0", "dx", F.posexplode(layer).alias("k", "v"))
    return px.select("segment_id", "level", "c", "z", (F.col("y0") + F.floor(F.col("k") / F.col("dx"))).cast("int").alias("y"),
                     (F.col("x0") + F.col("k") % F.col("dx")).cast("int").alias("x"), "v")


# ---------------------------------------------------------------- origins


def _starts(length: Column, patch: int, stride: int, cover: bool) -> Column:
    last = (length - patch).cast("int")
    grid = F.sequence(F.lit(0), last, F.lit(stride))
    return F.array_distinct(F.concat(grid, F.array(last))) if cover else grid


def fitting(segments: DataFrame, keys: list[str], height: Column, width: Column, patch: int) -> DataFrame:
    """Segments as they are; one smaller than the patch fails the job, with its keys."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    small = F.raise_error(F.concat(F.lit(f"smaller than the patch size {patch}: "), name)).cast("int")
    return segments.withColumn("h", F.when((height >= patch) & (width >= patch), F.col("h")).otherwise(small))


def tile_origins(segments: DataFrame, keys: list[str], patch: int, stride: int) -> DataFrame:
    """Covering origins of each (keys, h, w): the stride grid plus a flush last tile per axis."""
    ok = fitting(segments, keys, F.col("h"), F.col("w"), patch)
    ys = ok.select(*keys, "w", F.explode(_starts(F.col("h"), patch, stride, True)).alias("y0"))
    return ys.select(*keys, "y0", F.explode(_starts(F.col("w"), patch, stride, True)).alias("x0"))


def tiled_origins(segments: DataFrame, keys: list[str], patch: int, stride: int, limit: int = 0, seed: int = 0) -> DataFrame:
    """Origins inside the x-region [x_lo, x_hi) without the flush tile; a limit keeps the first ones in hash order."""
    ok = fitting(segments, keys, F.col("h"), F.col("x_hi") - F.col("x_lo"), patch)
    ys = ok.select(*keys, "x_lo", "x_hi", F.explode(_starts(F.col("h"), patch, stride, False)).alias("y0"))
    xs = F.sequence(F.col("x_lo").cast("int"), (F.col("x_hi") - patch).cast("int"), F.lit(stride))
    out = ys.select(*keys, "y0", F.explode(xs).alias("x0"))
    if not limit:
        return out
    order = hash_order(seed, *[F.col(k) for k in keys], F.col("y0"), F.col("x0"))
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return out.withColumn("_rn", rn).filter(F.col("_rn") <= limit).drop("_rn")


def summed_area(pixels: DataFrame, keys: list[str], value: str = "label") -> DataFrame:
    """Inclusive 2-D prefix sums by two line windows; ``area`` at (y, x) sums everything above and left."""
    across = W.partitionBy(*keys, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    rows = pixels.select(*keys, "y", "x", F.sum(F.col(value).cast("double")).over(across).alias("_r"))
    return rows.select(*keys, "y", "x", F.sum("_r").over(down).alias("area"))


def patch_sums(area: DataFrame, boxes: DataFrame, keys: list[str], ids: list[str], patch: int) -> DataFrame:
    """Sum over the patch at each box (keys, ids, y0, x0): four prefix-sum lookups as one equi-join."""
    corners = F.array(
        F.struct((F.col("y0") + patch - 1).alias("y"), (F.col("x0") + patch - 1).alias("x"), F.lit(1.0).alias("s")),
        F.struct((F.col("y0") - 1).alias("y"), (F.col("x0") + patch - 1).alias("x"), F.lit(-1.0).alias("s")),
        F.struct((F.col("y0") + patch - 1).alias("y"), (F.col("x0") - 1).alias("x"), F.lit(-1.0).alias("s")),
        F.struct((F.col("y0") - 1).alias("y"), (F.col("x0") - 1).alias("x"), F.lit(1.0).alias("s")),
    )
    look = boxes.select(*keys, *ids, "y0", "x0", F.inline(corners))
    joined = look.join(area, [*keys, "y", "x"], "left")
    return joined.groupBy(*keys, *ids, "y0", "x0").agg(F.sum(F.coalesce(F.col("s") * F.col("area"), F.lit(0.0))).alias("patch_sum"))


def ranked_positives(labels: DataFrame, keys: list[str]) -> DataFrame:
    """1-based rank of each positive pixel in (y, x) order: line counts first, then ranks inside a line."""
    pos = labels.filter(F.col("label") > 0.5).select(*keys, "y", "x")
    lines = pos.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*keys).orderBy("y").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.select(*keys, "y", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"), F.sum("n").over(W.partitionBy(*keys)).alias("positives"))
    inside = F.row_number().over(W.partitionBy(*keys, "y").orderBy("x"))
    return pos.join(lines, [*keys, "y"]).withColumn("rank", inside + F.col("_off")).drop("_off")


def sample_origins(labels: DataFrame, keys: list[str], n: int, fraction: float, patch: int, seed: int = 13,
                   max_rate: float = 0.001, attempts: int | None = None, mask: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """n origins per segment: a share jittered around positive pixels, the rest low-label patches.

    With ``regions`` (keys, x_lo, x_hi; x_hi beyond the map is cut) patches and positive pixels are those inside a segment's
    range of columns; a segment without a region has no draws, and a region narrower than the patch fails the job.

    Every draw is a hash of (seed, segment, draw), so the result does not depend on partitions.
    Rejected candidates are tried in order and the last attempt is taken as it is; with a
    mask, a candidate needs a mask mean above one half instead of a low label rate. 32 attempts
    follow the first one, 100 with a mask.
    """
    attempts = (32 if mask is None else 100) if attempts is None else attempts
    bounds = map_sizes(labels, keys)
    if regions is None:
        bounds = bounds.withColumns({"_lo": F.lit(0), "_hi": F.col("w")})
    else:
        bounds = null_safe_join(bounds, regions.select(*keys, F.col("x_lo").cast("int").alias("_lo"), F.col("x_hi").cast("int").alias("_hi")), keys)
        bounds = bounds.withColumn("_hi", F.least("_hi", "w"))
        labels = null_safe_join(labels, bounds.select(*keys, "_lo", "_hi"), keys).withColumn("_inside", (F.col("x") >= F.col("_lo")) & (F.col("x") < F.col("_hi"))).drop("_lo", "_hi")
    inside = labels if regions is None else labels.filter("_inside")
    positives = inside.filter(F.col("label") > 0.5).groupBy(*keys).agg(F.count(F.lit(1)).alias("positives"))
    shape = null_safe_join(bounds, positives, keys, "left").fillna(0, ["positives"])
    shape = fitting(shape, keys, F.col("h"), F.col("_hi") - F.col("_lo"), patch)
    draws = shape.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ids = [F.col(k) for k in keys] + [F.col("draw")]

    def u(tag: str, *more: Column) -> Column:
        return hash_uniform(f"{seed}:{tag}", *ids, *more)

    draws = draws.withColumn("near", (F.col("positives") > 0) & (u("kind") < fraction))
    near = draws.filter("near").withColumn("rank", F.floor(u("pick") * F.col("positives")).cast("long") + 1)
    near = near.join(ranked_positives(inside, keys).select(*keys, "rank", "y", "x"), [*keys, "rank"])

    def clipped(at: Column, tag: str, low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(at - F.floor(u(tag) * patch), high - patch)).cast("int")

    near = near.select(*keys, "draw", clipped(F.col("y"), "jy", F.lit(0), F.col("h")).alias("y0"), clipped(F.col("x"), "jx", F.col("_lo"), F.col("_hi")).alias("x0"),
                       F.lit("positive").alias("source"))
    tries = draws.filter("NOT near").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts))))
    at = F.col("attempt")
    tries = tries.select(*keys, "draw", "attempt", F.floor(u("ty", at) * (F.col("h") - patch + 1)).cast("int").alias("y0"),
                         (F.col("_lo") + F.floor(u("tx", at) * (F.col("_hi") - F.col("_lo") - patch + 1))).cast("int").alias("x0"))
    area = summed_area(labels if mask is None else mask, keys, "label" if mask is None else "mask")
    means = patch_sums(area, tries, keys, ["draw", "attempt"], patch).withColumn("rate", F.col("patch_sum") / (patch * patch))
    good = (F.col("rate") <= max_rate) if mask is None else (F.col("rate") > 0.5)
    pick = F.min_by(F.struct("y0", "x0"), F.when(good, F.col("attempt")).otherwise(F.when(at == attempts, F.lit(attempts + 1))))
    far = means.groupBy(*keys, "draw").agg(pick.alias("o")).select(*keys, "draw", "o.y0", "o.x0", F.lit("background").alias("source"))
    return near.unionByName(far)


# ---------------------------------------------------------------- patches


def covering_tiles(pixels: DataFrame, keys: list[str], sizes: DataFrame, patch: int, stride: int) -> DataFrame:
    """Each pixel once per covering tile that holds it, with the tile origin (y0, x0)."""

    def holders(at: Column, length: Column) -> Column:
        first = F.greatest(F.ceil((at - patch + 1) / stride), F.lit(0)).cast("int")
        last = F.least(F.floor(at / stride), F.floor((length - patch) / stride)).cast("int")
        grid = F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: (i * stride).cast("int"))).otherwise(
            F.array().cast("array<int>"))
        flush = F.when(at >= length - patch, F.array((length - patch).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.concat(grid, flush))

    sized = null_safe_join(pixels, fitting(sizes, keys, F.col("h"), F.col("w"), patch), keys)
    rows = sized.withColumn("y0", F.explode(holders(F.col("y"), F.col("h")))).withColumn("x0", F.explode(holders(F.col("x"), F.col("w"))))
    return rows.drop("h", "w")


def map_sizes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))


def extract_patches(pixels: DataFrame, keys: list[str], patch: int, stride: int, sizes: DataFrame | None = None) -> DataFrame:
    """Flat [C, H, W] array per covering origin; a patch is the largest thing one row holds."""
    sizes = map_sizes(pixels, keys) if sizes is None else sizes
    return extract_at(pixels, tile_origins(sizes, keys, patch, stride), keys, patch)


def pixel_blocks(pixels: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Blocks of side x side pixels as one row each: (keys, _yc, _xc, cells), cells being (c, y, x, v) in order."""
    cells = F.sort_array(F.collect_list(F.struct("c", "y", "x", "v"))).alias("cells")
    at = [F.floor(F.col(axis) / side).alias(f"_{axis}c") for axis in ("y", "x")]
    return pixels.groupBy(*keys, *at).agg(cells)


def pixels_at(pixels: DataFrame, origins: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """Pixels inside each given origin's patch: an equi-join on the at most four grid cells it touches."""
    px = pixels.withColumns({"_yc": F.floor(F.col("y") / patch), "_xc": F.floor(F.col("x") / patch)})
    inside = (F.col("y").between(F.col("y0"), F.col("y0") + patch - 1)) & (F.col("x").between(F.col("x0"), F.col("x0") + patch - 1))
    return null_safe_join(px, block_spots(origins, keys, patch), [*keys, "_yc", "_xc"]).filter(inside).drop("_yc", "_xc")


def block_spots(origins: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """Each distinct origin with the at most four blocks that its patch touches."""
    spots = origins.select(*keys, "y0", "x0").distinct()
    for axis in ("y", "x"):
        cells = F.array_distinct(F.array(F.floor(F.col(f"{axis}0") / patch), F.floor((F.col(f"{axis}0") + patch - 1) / patch)))
        spots = spots.withColumn(f"_{axis}c", F.explode(cells))
    return spots


def extract_at(pixels: DataFrame, origins: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """Flat [C, H, W] array per given origin.

    Pixels are shuffled once, into blocks of the patch's size; a patch takes its part of the at most four blocks that it
    touches as arrays, however many patches overlap there. Each block is a key of its own, so a giant map is many tasks.
    """
    parts = null_safe_join(block_spots(origins, keys, patch), pixel_blocks(pixels, keys, patch), [*keys, "_yc", "_xc"])
    y0, x0 = F.col("y0"), F.col("x0")
    mine = F.filter("cells", lambda s: s["y"].between(y0, y0 + patch - 1) & s["x"].between(x0, x0 + patch - 1))
    cut = parts.select(*keys, "y0", "x0", mine.alias("part")).filter(F.size("part") > 0)
    cells = F.sort_array(F.flatten(F.collect_list("part")))
    return cut.groupBy(*keys, "y0", "x0").agg(F.transform(cells, lambda s: s["v"]).alias("image"))


# ---------------------------------------------------------------- stitching


def blend_line(patch: int, floor: float = 0.05) -> list[float]:
    """Floored Hann window over one axis."""
    one = np.hanning(patch)
    if not one.any():
        one = np.ones(patch)
    return [float(v) for v in np.maximum(one, floor)]


def blend_weight(dy: Column, dx: Column, patch: int, floor: float = 0.05) -> Column:
    """Weight of a pixel inside its tile, scaled so the window maximum is one."""
    top = max(max(blend_line(patch, floor)) ** 2, 1e-6)

    def axis(i: Column) -> Column:
        if patch == 1:
            return F.lit(1.0)
        return F.greatest(0.5 - 0.5 * F.cos(i * (2.0 * math.pi / (patch - 1))), F.lit(floor))

    return axis(dy) * axis(dx) / top


def stitch(tile_probs: DataFrame, keys: list[str], patch: int, floor: float = 0.05) -> DataFrame:
    """Overlap-add: weighted mean of tile probabilities per pixel, with its weight and tile count."""
    w = blend_weight(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"), patch, floor)
    return tile_probs.withColumn("_w", w).groupBy(*keys, "y", "x").agg(
        (F.sum(F.col("prob") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias("prob"),
        F.sum("_w").alias("weight"), F.count(F.lit(1)).alias("tiles"))


def stitch_stats(tile_probs: DataFrame, stitched: DataFrame, keys: list[str]) -> DataFrame:
    n = tile_probs.select(*keys, "y0", "x0").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("patches"))
    w = stitched.groupBy(*keys).agg(F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"))
    return null_safe_join(n, w, keys)


def ensemble_mean(preds: DataFrame, keys: list[str], h: str = "h", w: str = "w") -> DataFrame:
    """Mean over views, models and seeds after undoing the flip named in ``view`` (id, h, v, hv)."""
    y = F.when(F.col("view").isin("v", "hv"), F.col(h) - 1 - F.col("y")).otherwise(F.col("y"))
    x = F.when(F.col("view").isin("h", "hv"), F.col(w) - 1 - F.col("x")).otherwise(F.col("x"))
    return preds.select(*keys, y.alias("y"), x.alias("x"), "prob").groupBy(*keys, "y", "x").agg(F.avg("prob").alias("prob"))


# ---------------------------------------------------------------- patch statistics and splits


def positive_rate(label: str = "label") -> Column:
    n = F.aggregate(label, F.lit(0).cast("long"), lambda acc, v: acc + F.when(v > 0.5, 1).otherwise(0))
    return n / F.size(label)


def patch_stats(patches: DataFrame, by: list[str]) -> DataFrame:
    """Positive rate, share of positive patches and rate quantiles; a patch has few distinct rates."""
    rows = patches.select(*by, positive_rate().alias("_r"), F.size("label").alias("_n"))
    q = F.percentile("_r", F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), (F.sum(F.col("_r") * F.col("_n")) / F.sum("_n")).alias("positive_rate"),
                                F.avg((F.col("_r") > 0).cast("double")).alias("positive_patch_fraction"), q.alias("q"))
    return out.select(*by, "samples", "positive_rate", "positive_patch_fraction", *[F.col("q")[i].alias(f"rate_q{i}") for i in range(5)])


def column_tops(labels: DataFrame, heights: DataFrame, keys: list[str], patch: int, steps: dict[str, int]) -> DataFrame:
    """Largest patch sum of each column (keys, x0), a column of the result per step: over the patches that begin every ``step`` rows.

    Only pixels with a label are summed, so a column without any has no row. A pixel goes to the few patches that hold it, and
    sums meet map-side; no line of the map is one group.
    """
    every = math.gcd(*steps.values())
    first = F.greatest(F.ceil((F.col("y") - patch + 1) / every), F.lit(0)).cast("int")
    last = F.floor(F.col("y") / every).cast("int")
    marked = labels.filter(F.col("label") != 0).withColumn("label", F.col("label").cast("double")).filter(first <= last)
    down = marked.select(*keys, "x", "label", F.explode(F.sequence(first, last)).alias("_k"))
    held = down.select(*keys, "label", (F.col("_k") * every).alias("y0"), F.explode(F.sequence(F.greatest(F.col("x") - patch + 1, F.lit(0)), F.col("x"))).alias("x0"))
    sums = held.groupBy(*keys, "y0", "x0").agg(F.sum("label").alias("_s"))
    inside = sums.join(heights, keys).filter(F.col("y0") <= F.col("h") - patch)
    return inside.groupBy(*keys, "x0").agg(*[F.max(F.when(F.col("y0") % step == 0, F.col("_s"))).alias(name) for name, step in steps.items()])


def split_regions(labels: DataFrame, keys: list[str], patch: int, stride: int | None = None) -> DataFrame:
    """Train and validation x-regions with the best balanced positive score, else the 70 % split.

    Candidate strips come from a short sequence per map. Tiles of all strips begin in the same rows, so a strip's best tile is the
    best of its columns, and pixels are summed once for all strips.
    """
    stride = stride or patch
    shape = labels.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"), F.avg("label").alias("_rate"))
    gap = F.greatest(F.lit(patch), F.floor(F.col("w") / 50)).cast("int")
    half = F.floor(gap / 2).cast("int")
    shape = shape.withColumn("_half", half)
    cut = F.floor(F.col("w") * 0.7).cast("int")
    shape = shape.withColumns({
        "d_train": F.struct(F.lit(0).alias("lo"), F.greatest(F.lit(patch), cut - F.col("_half")).alias("hi")),
        "d_val": F.struct(F.least(F.col("w") - patch, cut + F.col("_half")).alias("lo"), F.col("w").alias("hi")),
    })
    lo = F.greatest(patch + F.col("_half"), F.floor(F.col("w") * 0.15)).cast("int")
    hi = F.least(F.col("w") - patch - F.col("_half"), F.floor(F.col("w") * 0.85)).cast("int")
    step = F.greatest(F.lit(patch), F.floor(F.col("w") / 32)).cast("int")
    cand = shape.filter((F.col("_rate") > 0) & (hi >= lo)).withColumn("split_x", F.explode(F.sequence(lo, hi, step)))
    left = F.struct(F.lit(0).alias("lo"), F.greatest(F.lit(patch), F.col("split_x") - F.col("_half")).alias("hi"))
    right = F.struct(F.least(F.col("w") - patch, F.col("split_x") + F.col("_half")).alias("lo"), F.col("w").alias("hi"))
    both = F.array(F.struct(F.lit(0).alias("side"), left.alias("train"), right.alias("val")), F.struct(F.lit(1).alias("side"), right.alias("train"), left.alias("val")))
    cand = cand.select(*keys, "h", "w", "split_x", F.inline(both))
    roles = F.array(F.struct(F.lit("train").alias("role"), F.col("train").alias("region"), F.lit(patch).alias("step")),
                    F.struct(F.lit("val").alias("role"), F.col("val").alias("region"), F.lit(stride).alias("step")))
    boxes = cand.select(*keys, "h", "split_x", "side", F.inline(roles))
    boxes = boxes.filter((F.col("region.hi") - F.col("region.lo") >= patch) & (F.col("h") >= patch))
    boxes = boxes.select(*keys, "split_x", "side", "role", F.explode(F.sequence(F.col("region.lo"), F.col("region.hi") - patch, F.col("step"))).alias("x0"))
    tops = column_tops(labels, shape.select(*keys, "h"), keys, patch, {"train": patch, "val": stride})
    score = boxes.join(tops, [*keys, "x0"]).groupBy(*keys, "split_x", "side").agg(
        F.max(F.when(F.col("role") == "train", F.col("train"))).alias("_t"), F.max(F.when(F.col("role") == "val", F.col("val"))).alias("_v"))
    t, v = (F.coalesce(c, F.lit(0.0)) / (patch * patch) for c in ("_t", "_v"))
    scored = cand.join(score, [*keys, "split_x", "side"]).withColumns({"train_score": t, "val_score": v}).withColumn("balance", F.least("train_score", "val_score"))
    order = F.struct("balance", "val_score", "train_score", F.col("val.hi") - F.col("val.lo"), -F.col("split_x"), -F.col("side"))
    best = scored.filter("balance > 0").groupBy(*keys).agg(F.max_by(F.struct("train", "val"), order).alias("b"))
    out = null_safe_join(shape, best, keys, "left")
    train, val = F.coalesce("b.train", "d_train"), F.coalesce("b.val", "d_val")
    return out.select(*keys, train["lo"].alias("train_lo"), train["hi"].alias("train_hi"), val["lo"].alias("val_lo"), val["hi"].alias("val_hi"),
                      F.col("b").isNull().alias("is_default"),
                      (F.greatest(train["lo"], val["lo"]) < F.least(train["hi"], val["hi"])).alias("overlap"))


# ---------------------------------------------------------------- features


def pixel_features(pixels: DataFrame, patch: list[str], depth: int = 3, channels: bool = False) -> DataFrame:
    """Value, bias and texture features per pixel and channel; rolls wrap around the patch edge.

    With ``channels`` the across-channel mean, centre difference, deviation and last-first are added.
    """
    col = W.partitionBy(*patch, "c", "x").orderBy("y")
    row = W.partitionBy(*patch, "c", "y").orderBy("x")
    full_col, full_row = (w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing) for w in (col, row))
    out = pixels.withColumn("bias", F.when(F.col("c") == 0, 1.0).otherwise(0.0))
    if depth >= 2:
        out = out.withColumns({"_u": F.lag("v").over(col), "_d": F.lead("v").over(col), "_f": F.first("v").over(full_col), "_l": F.last("v").over(full_col)})
        out = out.withColumns({"_lf": F.lag("v").over(row), "_rt": F.lead("v").over(row), "_rf": F.first("v").over(full_row), "_rl": F.last("v").over(full_row)})
        up, down = F.coalesce("_u", "_l"), F.coalesce("_d", "_f")
        left, right = F.coalesce("_lf", "_rl"), F.coalesce("_rt", "_rf")
        mean4 = (up + down + left + right) / 4.0
        feats = {"mean4": mean4, "residual": F.col("v") - mean4}
        if depth >= 3:
            def gradient(before: str, after: str) -> Column:
                b, a, v = F.col(before), F.col(after), F.col("v")
                return F.when(b.isNull(), a - v).when(a.isNull(), v - b).otherwise((a - b) / 2.0)

            gy, gx = gradient("_u", "_d"), gradient("_lf", "_rt")
            feats |= {"gx": gx, "gy": gy, "grad2": gx * gx + gy * gy, "laplacian": up + down + left + right - 4.0 * F.col("v")}
        out = out.withColumns(feats).drop("_u", "_d", "_f", "_l", "_lf", "_rt", "_rf", "_rl")
    if channels and depth >= 2:
        at = W.partitionBy(*patch, "y", "x")
        n = F.max("c").over(at) + 1
        center = F.max(F.when(F.col("c") == F.col("_mid"), F.col("v"))).over(at)
        out = out.withColumn("_mid", F.floor(n / 2)).withColumns({
            "depth_mean": F.avg("v").over(at), "depth_center_diff": center - F.avg("v").over(at), "depth_std": F.stddev_pop("v").over(at),
            "depth_span": F.max_by("v", "c").over(at) - F.min_by("v", "c").over(at)}).drop("_mid")
    return out


def feature_names(channels: int = 1, depth: int = 3) -> list[str]:
    """Names of the features of a pixel with so many channels; a single channel has no number."""
    of_channel = ["v"] + ["mean4", "residual"] * (depth >= 2) + ["gx", "gy", "grad2", "laplacian"] * (depth >= 3)
    own = [f"{n}_{c}" if channels > 1 else n for c in range(channels) for n in of_channel]
    across = ["depth_mean", "depth_center_diff", "depth_std", "depth_span"] if channels > 1 and depth >= 2 else []
    return ["bias", *own, *across]


def patch_features(patches: DataFrame, keys: list[str], channels: int = 1, depth: int = 3) -> DataFrame:
    """`pixel_features` of patches that are flat arrays ``image`` (channel by channel, ``h`` x ``w``): a row per pixel, all channels in it.

    A stencil reads its neighbours from the patch's own array, so there is no shuffle. Pixels come as (keys, y, x, features).
    """
    h, w, image = F.col("h"), F.col("w"), F.col("image")
    at = lambda c, y, x: F.get(image, (c * h * w + y * w + x).cast("int"))

    def around(c: int, y: Column, x: Column) -> Column:
        before = lambda i, n: F.when(i == 0, n - 1).otherwise(i - 1)
        after = lambda i, n: F.when(i == n - 1, 0).otherwise(i + 1)
        return F.struct(at(c, y, x).alias("v"), at(c, before(y, h), x).alias("up"), at(c, after(y, h), x).alias("down"),
                        at(c, y, before(x, w)).alias("left"), at(c, y, after(x, w)).alias("right"))

    def derived(p: Column, c: int) -> dict[str, Column]:
        q = p[f"c{c}"]
        out = {"v": q["v"]}
        if depth >= 2:
            mean4 = (q["up"] + q["down"] + q["left"] + q["right"]) / 4.0
            out |= {"mean4": mean4, "residual": q["v"] - mean4}
        if depth >= 3:
            def slope(i: Column, n: Column, b: Column, a: Column) -> Column:
                # a patch of one row or column has no slope
                return F.when(n == 1, None).when(i == 0, a - q["v"]).when(i == n - 1, q["v"] - b).otherwise((a - b) / 2.0)

            gy, gx = slope(p["y"], h, q["up"], q["down"]), slope(p["x"], w, q["left"], q["right"])
            out |= {"gx": gx, "gy": gy, "grad2": gx * gx + gy * gy, "laplacian": q["up"] + q["down"] + q["left"] + q["right"] - 4.0 * q["v"]}
        return {f"{n}_{c}" if channels > 1 else n: e for n, e in out.items()}

    def pixel(p: Column) -> Column:
        found = {"bias": F.lit(1.0)}
        for c in range(channels):
            found |= derived(p, c)
        if channels > 1 and depth >= 2:
            values = [p[f"c{c}"]["v"] for c in range(channels)]
            mean = sum(values[1:], values[0]) / float(channels)
            square = sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / float(channels)
            found |= {"depth_mean": mean, "depth_center_diff": values[channels // 2] - mean, "depth_std": F.sqrt(square), "depth_span": values[-1] - values[0]}
        return F.struct(p["y"].cast("int").alias("y"), p["x"].cast("int").alias("x"), *[found[n].alias(n) for n in feature_names(channels, depth)])

    def neighbours(k: Column) -> Column:
        y, x = F.floor(k / w), k % w
        return F.struct(y.alias("y"), x.alias("x"), *[around(c, y, x).alias(f"c{c}") for c in range(channels)])

    places = F.sequence(F.lit(0), (h * w - 1).cast("int"))
    return patches.select(*keys, F.inline(F.transform(F.transform(places, neighbours), pixel)))


def patch_texture(patches: DataFrame, keys: list[str], channels: int = 1) -> DataFrame:
    """`texture` of patches that are flat arrays: mean squared gradient of the centre channel, without a shuffle of pixels."""
    size = F.col("h") * F.col("w")
    middle = F.slice("image", (F.lit(channels // 2) * size + 1).cast("int"), size.cast("int"))
    return patch_features(patches.withColumn("image", middle), keys, 1, 3).groupBy(*keys).agg(F.avg("grad2").alias("texture"))


def standardize(train: DataFrame, val: DataFrame, by: list[str], features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sets scaled by the train mean and population deviation of each group."""
    stats = train.groupBy(*by).agg(*[F.avg(f).alias(f"_m_{f}") for f in features],
                                   *[F.greatest(F.stddev_pop(f), F.lit(1e-6)).alias(f"_s_{f}") for f in features])

    def scale(df: DataFrame) -> DataFrame:
        j = null_safe_join(df, stats, by)
        return j.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}") for f in features}).drop(
            *[f"_{k}_{f}" for f in features for k in "ms"])

    return scale(train), scale(val)


def augment(patches: DataFrame, flips: bool = True, rotate: bool = False, seed: int = 0, ids: list[str] | None = None) -> DataFrame:
    """Patches plus horizontal and vertical flips, then quarter turns of image and label together.

    Needs flat arrays with ``channels, h, w``; patches are square when rotated.
    """
    out = patches.withColumn("flip", F.explode(F.array(*[F.lit(v) for v in (("id", "h", "v") if flips else ("id",))])))
    turns = F.lit(0)
    if rotate:
        turns = (F.conv(F.substring(hash_order(seed, *[F.col(i) for i in ids or []], F.col("flip")), 1, 8), 16, 10).cast("long") % 4).cast("int")
    out = out.withColumn("turns", turns)

    def permute(arr: str, chan: Column) -> Column:
        h, w, t, f = F.col("h"), F.col("w"), F.col("turns"), F.col("flip")

        def at(i: Column) -> Column:
            c, rest = F.floor(i / (h * w)), i % (h * w)
            y, x = F.floor(rest / w), rest % w
            ty = F.when(t == 1, x).when(t == 2, h - 1 - y).when(t == 3, h - 1 - x).otherwise(y)
            tx = F.when(t == 1, w - 1 - y).when(t == 2, w - 1 - x).when(t == 3, y).otherwise(x)
            fy = F.when(f == "v", h - 1 - ty).otherwise(ty)
            fx = F.when(f == "h", w - 1 - tx).otherwise(tx)
            return F.get(F.col(arr), (c * h * w + fy * w + fx).cast("int"))

        return F.transform(F.sequence(F.lit(0), (chan * h * w - 1).cast("int")), at)

    return out.withColumns({"image": permute("image", F.col("channels")), "label": permute("label", F.lit(1))})


def texture(pixels: DataFrame, patch: list[str]) -> DataFrame:
    """Mean squared gradient of each patch's centre channel."""
    center = pixels
    if "c" in pixels.columns:
        mid = pixels.groupBy(*patch).agg(F.floor((F.max("c") + 1) / 2).alias("_mid"))
        center = null_safe_join(pixels, mid, patch).filter(F.col("c") == F.col("_mid")).drop("_mid")
    else:
        center = pixels.withColumn("c", F.lit(0))
    feats = pixel_features(center, patch, 3)
    return feats.groupBy(*patch).agg(F.avg("grad2").alias("texture"))


# ---------------------------------------------------------------- label sets


def label_iou(a: DataFrame, b: DataFrame, by: list[str], pixel: list[str]) -> DataFrame:
    """Overlap of two label rasters; two empty ones have IoU 1."""
    left = a.select(*by, *pixel, (F.col("label") > 0.5).alias("_a"))
    right = b.select(*by, *pixel, (F.col("label") > 0.5).alias("_b"))
    j = left.join(right, [*by, *pixel], "full")
    x, y = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    agg = j.groupBy(*by).agg(F.count_if(x & y).alias("intersection"), F.count_if(x | y).alias("union_pixels"),
                             F.count_if(y & ~x).alias("new_not_ours"), F.count_if(x & ~y).alias("ours_not_new"))
    return agg.withColumn("iou", F.when(F.col("union_pixels") > 0, F.col("intersection") / F.col("union_pixels")).otherwise(1.0))


def relabel(patches: DataFrame, new_labels: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """Patches with labels cut from a new raster at their stored origins, and the overlap with the old ones.

    A patch that the new raster does not reach fails the job: no patch is dropped.
    """
    px = new_labels.select(*keys, "y", "x", F.lit(0).alias("c"), F.col("label").cast("double").alias("v"))
    fresh = extract_at(px, patches, keys, patch).withColumnRenamed("image", "new_label")
    j = null_safe_join(patches, fresh, [*keys, "y0", "x0"], "left")
    at = F.concat_ws("/", *[F.col(k).cast("string") for k in [*keys, "y0", "x0"]])
    missing = F.raise_error(F.concat(F.lit("no new label under patch "), at)).cast("array<double>")
    j = j.withColumn("new_label", F.when(F.col("new_label").isNull(), missing).otherwise(F.col("new_label")))
    both = F.zip_with("label", "new_label", lambda a, b: F.struct((a > 0.5).alias("a"), (b > 0.5).alias("b")))

    def n(cond) -> Column:
        return F.size(F.filter(both, cond))

    return j.withColumns({"intersection": n(lambda s: s["a"] & s["b"]), "union_pixels": n(lambda s: s["a"] | s["b"])})


def combine(sets: list[DataFrame], source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Union of patch sets, and one row per input with its samples, shape and provenance.

    Sets with a different patch shape raise when the union is read.
    """
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    shape = F.struct("channels", "h", "w")
    inputs = out.groupBy(source).agg(F.count(F.lit(1)).alias("samples"), F.min(shape).alias("_lo"), F.max(shape).alias("_hi"),
                                     F.sort_array(F.collect_set("segment")).alias("source_segments"))
    checked = F.when(F.col("_lo") == F.col("_hi"), F.col("samples")).otherwise(F.raise_error(F.lit("patch shape mismatch")).cast("long"))
    return out, inputs.select(source, checked.alias("samples"), "source_segments", F.col("_hi.h").alias("patch_size"))
