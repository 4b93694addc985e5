"""File connectors: rasters, JSON and CSV records, configurations, inventories and guarded sinks."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from evalgate.sources import versions

LOO_SCHEMA = ("label string, heldout_segment string, seed long, returncode int, run_id string, artifact_dir string, val_f1 double, val_f05 double, "
              "average_precision double, precision double, recall double, best_threshold double, val_positive_rate double, pred_positive_rate double, "
              "ap_prevalence_lift double, fixed_threshold_f1 double, fixed_threshold_status string, fixed_threshold_failure_reason string, "
              "threshold_selection string, selected_threshold_reason string, max_pred_positive_rate_ratio double, error string")
THRESHOLD_SCHEMA = "threshold double, precision double, recall double, f05 double, f1 double, pred_positive_rate double"


# ---------------------------------------------------------------- rasters


def _lines(files: DataFrame) -> DataFrame:
    """Decode ``.npy`` rasters into one row per raster line."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, role, content in zip(frame["root"], frame["role"], frame["content"]):
                arr = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                if arr.ndim != 2:
                    raise ValueError(f"{root}: {role} raster must be 2-D, got {arr.shape}")
                for start in range(0, arr.shape[0], 1024):
                    part = arr[start:start + 1024]
                    yield pd.DataFrame({"root": root, "role": role, "y": range(start, start + len(part)), "h": arr.shape[0], "w": arr.shape[1], "line": list(part)})

    return files.select("root", "role", "content").mapInPandas(decode, "root string, role string, y int, h int, w int, line array<float>")


def read_rasters(spark: SparkSession, root: str) -> DataFrame:
    """Middle layer, label and optional mask of each folder, line by line.

    Layers are ``layers/*.npy`` or ``surface_volume/*.npy``; the label is ``*inklabel*.npy`` and the
    mask ``mask.npy``. A shape mismatch fails the read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root)
    path = F.col("path")
    layer_dir = F.regexp_extract(path, r"/(surface_volume|layers)/[^/]+$", 1)
    role = F.when(layer_dir != "", "image").when(path.rlike(r"inklabel[^/]*\.npy$"), "label").when(path.endswith("/mask.npy"), "mask")
    folder = F.regexp_replace(F.regexp_replace(path, r"/[^/]+$", ""), r"/(surface_volume|layers)$", "")
    named = raw.select("path", folder.alias("root"), role.alias("role"), layer_dir.alias("dir")).filter("role IS NOT NULL")
    # surface_volume wins over layers, then the middle of the sorted layers; one label per folder
    by = W.partitionBy("root", "role")
    ranked = named.withColumn("_best", F.max("dir").over(by)).filter(F.col("dir") == F.col("_best"))
    order = F.row_number().over(by.orderBy("path")) - 1
    count = F.count(F.lit(1)).over(by)
    ranked = ranked.withColumns({"_i": order, "_n": count})
    chosen = ranked.filter(F.when(F.col("role") == "image", F.col("_i") == F.floor(F.col("_n") / 2)).otherwise(F.col("_i") == 0)).select("path", "root", "role")
    lines = _lines(raw.select("path", "content").join(chosen, "path"))

    def side(r: str, name: str) -> DataFrame:
        return lines.filter(F.col("role") == r).select("root", "y", F.col("line").alias(name), F.struct("h", "w").alias(f"_{name}"))

    j = side("image", "image").join(side("label", "label"), ["root", "y"], "full").join(side("mask", "mask"), ["root", "y"], "left")
    bad = F.col("_image").isNull() | F.col("_label").isNull() | (F.col("_image") != F.col("_label"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("image/label shape mismatch under "), F.col("root"))).cast("array<float>")).otherwise(F.col("image"))
    return j.select("root", "y", checked.alias("image"), F.transform("label", lambda v: (v > 0).cast("float")).alias("label"),
                    F.transform("mask", lambda v: (v > 0).cast("float")).alias("mask"))


# ---------------------------------------------------------------- records


def read_loo_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOO_SCHEMA).json(path)


def read_threshold_rows(spark: SparkSession, path: str) -> DataFrame:
    """Threshold CSV; a row that does not parse fails the read."""
    return spark.read.schema(THRESHOLD_SCHEMA).option("header", "true").option("mode", "FAILFAST").csv(path)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.summary)?\.jsonl?$", "")


def read_loo_summaries(spark: SparkSession, root: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries (a given limit keeps the newest) with a readiness flag, and the rows of their companion JSONL files."""
    raw = spark.read.text(f"{root}/*summary.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), F.try_parse_json("value").alias("doc"))
    good = raw.filter(F.try_variant_get("doc", "$.promotion_ready", "variant").isNotNull())
    kept = good if limit is None else good.orderBy(F.col("modified_at").desc(), F.col("path").desc()).limit(limit)
    kept = kept.withColumns({"stem": _stem(F.col("path")), "promotion_ready": F.coalesce(F.try_variant_get("doc", "$.promotion_ready", "boolean"), F.lit(False)),
                             "run_ids": F.try_variant_get("doc", "$.run_ids", "array<string>")})
    rows = spark.read.schema(LOO_SCHEMA).option("pathGlobFilter", "*.jsonl").json(root).withColumn("stem", _stem(F.col("_metadata.file_path")))
    return kept, kept.select("stem", "path").join(rows, "stem")


def read_full_tile_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Whole-map metrics below run folders with their verdict, ordered (segment, risk first, path)."""
    from evalgate.operators.quality import metrics_verdict

    raw = spark.read.text(f"{root}/*/full_tile*/metrics.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))

    def num(*keys: str) -> Column:
        return F.coalesce(*[F.try_variant_get("doc", f"$.{k}", "double") for k in keys])

    def text(*keys: str) -> Column:
        return F.coalesce(*[F.try_variant_get("doc", f"$.{k}", "string") for k in keys])

    rows = raw.filter(F.schema_of_variant("doc").startswith("OBJECT")).select(
        "path", F.regexp_replace("path", r"/full_tile[^/]*/metrics\.json$", "").alias("artifact_dir"),
        text("evaluation_region.segment_id", "promotion_checks.inference_segment_id").alias("segment_id"),
        F.try_variant_get("doc", "$.promotion_checks.eligible", "boolean").alias("checks_eligible"), text("evaluation_region.type").alias("region_type"),
        num("val_f1", "tile_f1").alias("val_f1"), num("average_precision").alias("average_precision"), num("best_threshold").alias("best_threshold"),
        num("pred_positive_rate").alias("pred_positive_rate"), num("val_positive_rate", "label_positive_rate").alias("val_positive_rate"),
        num("ap_prevalence_lift").alias("ap_prevalence_lift"), num("fixed_threshold_f1").alias("fixed_threshold_f1"),
        text("fixed_threshold_status").alias("fixed_threshold_status"), text("fixed_threshold_failure_reason").alias("fixed_threshold_failure_reason"),
        F.try_variant_get("doc", "$.threshold_risk_summary", "variant").isNotNull().alias("has_risk"), "doc")
    return metrics_verdict(rows).orderBy(F.coalesce("segment_id", F.lit("")), ~F.col("has_risk"), "path")


@F.pandas_udf(StringType())
def _config_json(text: pd.Series, is_yaml: pd.Series) -> pd.Series:
    import yaml

    def one(t: str, y: bool) -> str:
        try:
            return json.dumps({"ok": yaml.safe_load(t) if y else json.loads(t)}, default=str)
        except Exception as exc:
            return json.dumps({"error": str(exc)})

    return pd.Series([one(t, y) for t, y in zip(text, is_yaml)])


def read_configs(spark: SparkSession, root: str) -> DataFrame:
    """YAML and JSON configurations, newest first; unreadable ones stay as error rows."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml,json}")
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")
    doc = F.parse_json(_config_json("value", F.col("path").rlike(r"\.ya?ml$")))
    out = rows.select("path", "modified_at", doc.alias("d")).select(
        "path", "modified_at", F.try_variant_get("d", "$.ok", "variant").alias("doc"), F.try_variant_get("d", "$.error", "string").alias("error"))
    return out.orderBy(F.col("modified_at").desc(), "path")


# ---------------------------------------------------------------- inventories


def dataset_inventory(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Prepared-data sidecars, newest first; unparsable ones are kept with a mark."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*metadata.json")
    doc = F.try_parse_json("value")
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), doc.alias("doc"),
                      doc.isNull().alias("metadata_error"))
    out = rows.withColumns({"segment_id": F.try_variant_get("doc", "$.segment_id", "string"), "split": F.try_variant_get("doc", "$.split", "string"),
                            "samples": F.try_variant_get("doc", "$.samples", "long")})
    out = out.orderBy(F.col("modified_at").desc(), "path")
    return out if limit is None else out.limit(limit)


def artifact_inventory(spark: SparkSession, root: str, per_run: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files per run folder (the map first, then newest) and the totals of the tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    run = F.regexp_extract("path", rf"/{base}/([^/]+)/", 1)
    rows = files.withColumn("run_dir", run).filter("run_dir <> ''")
    first = F.col("path").endswith("/probability_map.npy")
    rank = F.row_number().over(W.partitionBy("run_dir").orderBy(first.desc(), F.col("modificationTime").desc(), "path"))
    listed = rows.withColumn("position", rank)
    listed = listed if per_run is None else listed.filter(F.col("position") <= per_run)
    totals = rows.agg(F.countDistinct("run_dir").alias("run_directory_count"), F.sum("length").alias("total_bytes"))
    return listed, totals


# ---------------------------------------------------------------- sinks


def write_outputs(spark: SparkSession, prob_map: DataFrame, metrics: DataFrame, threshold_rows: DataFrame, path: str, overwrite: bool = False) -> dict[str, str]:
    """Probability map, metrics and threshold rows as one set: all three appear, by one commit, or none.

    An earlier set is refused unless told otherwise, and stays the current one until the commit. Returns the paths of the parts.
    """
    if not overwrite and versions.last_commit(spark, path) is not None:
        raise FileExistsError(f"refusing to overwrite: {path}")
    ordered = threshold_rows.select(*[c.split()[0] for c in THRESHOLD_SCHEMA.split(", ")])
    parts = {
        "probability_map": (prob_map, lambda d, p: d.write.parquet(p)), "metrics": (metrics, lambda d, p: d.write.json(p)),
        "metrics_by_threshold": (ordered, lambda d, p: d.write.option("header", "true").csv(p)),
    }
    folder = versions.stage(parts, path)
    versions.commit(spark, path, folder, list(parts))
    return {name: f"{folder}/{name}" for name in parts}


def read_outputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three parts of the current set below a path."""
    folder = versions.current_folder(spark, path)
    return {"probability_map": spark.read.parquet(f"{folder}/probability_map"), "metrics": spark.read.json(f"{folder}/metrics"),
            "metrics_by_threshold": read_threshold_rows(spark, f"{folder}/metrics_by_threshold")}


def write_loo_rows(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)
