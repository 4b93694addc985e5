"""Connected components of thresholded maps (8-connectivity).

Each map is cut into fixed tiles. A tile is labelled by one task with vectorised union of
neighbouring pixels; its size is bounded by the tile edge, whatever the map. Tile components
that touch across a border become edges of a much smaller graph, which is closed by
min-label rounds with pointer jumping over checkpointed tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.functions.columns import grouped, null_safe_join
from evalgate.functions.ordering import salted_join
from evalgate.session import checkpointed, written

ROW = 2**31


def _label_tiles(tile_no: np.ndarray, y: np.ndarray, x: np.ndarray, tile: int) -> np.ndarray:
    """Smallest pixel id of each pixel's component, for several whole tiles at once.

    Pixels get a code on a padded local grid, so codes of different tiles never touch.
    """
    side = tile + 2
    code = tile_no * (side * side) + (y % tile + 1) * side + (x % tile + 1)
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    pairs = []
    for step in (1, side - 1, side, side + 1):
        at = np.searchsorted(sorted_code, sorted_code + step)
        at_ok = at < len(sorted_code)
        hit = np.flatnonzero(at_ok)[sorted_code[at[at_ok]] == sorted_code[at_ok] + step]
        pairs.append(np.stack([hit, at[hit]], axis=1))
    a, b = np.concatenate(pairs).T
    label = np.arange(len(sorted_code))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(code), dtype=np.int64)
    out[order] = (y[order].astype(np.int64) * ROW + x[order])[label]
    return out


def tile_labels(mask: DataFrame, by: list[str], tile: int) -> DataFrame:
    """Positive pixels with the label of their tile-local component.

    Tiles are kept together by the shuffle and read in order; a task holds the tiles of one
    Arrow batch plus the unfinished last one, never a map.
    """
    tiled = mask.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumns(
        {"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    types = dict(tiled.dtypes)
    cols = [*by, "y", "x", "_ty", "_tx"]
    keys = [*by, "_ty", "_tx"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", label long"

    def numbered(pdf: pd.DataFrame) -> np.ndarray:
        changed = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        return np.cumsum(changed)

    def labelled(pdf: pd.DataFrame, no: np.ndarray) -> pd.DataFrame:
        return pdf.assign(label=_label_tiles(no, pdf["y"].to_numpy(), pdf["x"].to_numpy(), tile))[[*cols, "label"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for frame in frames:
            pdf = pd.concat([*kept, frame], ignore_index=True) if kept else frame
            no = numbered(pdf)
            whole = no < no[-1]
            if whole.any():
                yield labelled(pdf[whole], no[whole])
            kept = [pdf[~whole]]
        if kept:
            yield labelled(kept[0], numbered(kept[0]))

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def border_edges(labels: DataFrame, by: list[str], tile: int) -> DataFrame:
    """Edges between tile components that touch across a tile border."""
    edge_px = labels.filter((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    out = edge_px.select(*by, "y", "x", "_ty", "_tx", F.col("label").alias("a"), F.inline(steps))
    out = out.select(*by, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "a", "_ty", "_tx")
    crossing = out.filter((F.floor(F.col("y") / tile) != F.col("_ty")) | (F.floor(F.col("x") / tile) != F.col("_tx")))
    there = edge_px.select(*by, "y", "x", F.col("label").alias("b"))
    return null_safe_join(crossing.drop("_ty", "_tx"), there, [*by, "y", "x"]).select(*by, "a", "b").distinct()


def close_labels(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root): smallest reachable node; rounds stop when no label changes.

    In a giant component most nodes soon share one root. Nodes look up the label of their label by that root, so its rows are
    dealt over salts; a node's own neighbours are few (the border of a tile).
    """
    both = written(edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = null_safe_join(both, roots.select(*by, F.col("node").alias("b"), F.col("root").alias("_r")), [*by, "b"])
        low = near.groupBy(*by, F.col("a").alias("node")).agg(F.min("_r").alias("_low"))
        hooked = null_safe_join(roots, low, [*by, "node"]).withColumn("_new", F.least("root", "_low"))
        jump = roots.select(*by, F.col("node").alias("_new"), F.col("root").alias("_jump"))
        stepped = salted_join(hooked, jump, [*by, "_new"], ["node"]).select(
            *by, "node", F.coalesce(F.least("_new", "_jump"), "_new").alias("root"), F.col("root").alias("_old"))
        stepped = written(stepped)
        if stepped.filter(F.col("root") != F.col("_old")).limit(1).count() == 0:
            return roots
        roots = stepped.drop("_old")


def component_sizes(scores: DataFrame, by: list[str], threshold: float = 0.5, tile: int = 512) -> DataFrame:
    """(by, root, size) of every component of ``prob >= threshold``."""
    scores, by = grouped(scores, by)
    labels = tile_labels(scores.filter(F.col("prob") >= threshold), by, tile)
    if not by:
        raise ValueError("grouping keys are required")
    labels = checkpointed(labels)
    local = labels.groupBy(*by, F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    edges = border_edges(labels, by, tile)
    roots = close_labels(edges, by)
    rooted = null_safe_join(local, roots, [*by, "node"], "left")
    return rooted.groupBy(*by, F.coalesce("root", "node").alias("root")).agg(F.sum("size").alias("size"))


def components(scores: DataFrame, by: list[str], threshold: float = 0.5, tile: int = 512, small: int = 4) -> DataFrame:
    """Count, largest fraction and small-component fraction per map, 0 where nothing is positive."""
    scores, by = grouped(scores, by)
    sizes = component_sizes(scores, by, threshold, tile)
    stats = sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("component_count"), (F.max("size") / F.sum("size")).alias("largest_component_fraction"),
        (F.sum(F.when(F.col("size") <= small, F.col("size")).otherwise(0)) / F.sum("size")).alias("small_component_fraction"))
    maps = scores.select(*by).distinct()
    return null_safe_join(maps, stats, by, "left").fillna(0, ["component_count", "largest_component_fraction", "small_component_fraction"])
