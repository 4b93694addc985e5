"""Segment catalogues: listing pages, merges, nested catalogues, manifests and fold maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Link patterns of the public segment listing.
VOLUME_LINK = r'href="(\d+)\.zarr/"'
LABEL_LINK = r'href="(\d+)_inklabels\.png"'


def catalog_from_html(pages: DataFrame, html: str = "html", volume: str = VOLUME_LINK, label: str = LABEL_LINK) -> DataFrame:
    """Ids linked both as a volume and as a label anywhere in the listing."""

    def ids(pattern: str) -> DataFrame:
        return pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("segment_id"))

    return ids(volume).intersect(ids(label))


def merge_catalogs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two catalogues; the second wins whole rows per id."""
    a = first.select(key, F.struct(*[c for c in first.columns if c != key]).alias("_a"))
    b = second.select(key, F.struct(*[c for c in second.columns if c != key]).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias("r")).select(key, "r.*")


def dataset_summary(catalog: DataFrame) -> DataFrame:
    """Flat view of ``scroll_id, energies map<energy, map<resolution, struct<segments map<id, url>>>>``."""
    e = catalog.select("scroll_id", F.explode("energies").alias("energy", "by_resolution"))
    r = e.select("scroll_id", "energy", F.explode("by_resolution").alias("resolution", "entry"))
    s = r.select("scroll_id", "energy", "resolution", F.explode_outer("entry.segments").alias("segment_id", "url"))
    total = s.agg(F.countDistinct("segment_id").alias("n")).select("n").scalar()

    def listed(c: str):
        return F.sort_array(F.collect_set(c)).alias({"energy": "energies", "resolution": "resolutions", "segment_id": "segments"}[c])

    out = s.groupBy("scroll_id").agg(listed("energy"), listed("resolution"), listed("segment_id"))
    return out.withColumn("mode", F.when(total > 1, "cross-segment-available").otherwise("spatial-same-segment"))


def labeled_segments(catalog: DataFrame) -> DataFrame:
    """One row per labelled segment with the derived label url."""
    e = catalog.select("scroll_id", F.explode("energies").alias("energy", "by_resolution"))
    r = e.select("scroll_id", "energy", F.explode("by_resolution").alias("resolution", "entry"))
    s = r.select("scroll_id", "energy", "resolution", F.explode("entry.segments").alias("segment_id", "zarr_url"))
    parent = F.regexp_replace(F.rtrim(F.col("zarr_url"), F.lit("/")), r"/[^/]*$", "")
    return s.withColumn("inklabels_url", F.concat(parent, F.lit("/"), F.col("segment_id"), F.lit("_inklabels.png")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries of a root list, or of ``segments`` / ``labeled_segments``."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    array = F.coalesce(F.try_variant_get("v", "$.segments", "variant"), F.try_variant_get("v", "$.labeled_segments", "variant"), F.col("v"))
    bad = ~F.schema_of_variant("a").startswith("ARRAY")
    checked = F.when(bad, F.raise_error(F.lit("manifest must be a list or contain segments/labeled_segments")).cast("variant")).otherwise(F.col("a"))
    rows = doc.select(array.alias("a")).select(checked.alias("a"))
    out = rows.lateralJoin(spark.tvf.variant_explode(F.col("a").outer()).toDF("pos", "key", "value"))
    return out.select("pos", F.try_variant_get("value", "$.segment_id", "string").alias("segment_id"), F.col("value").alias("entry"))


def read_fold_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, fold_id, train_ref, val_ref) rows of one or many fold maps."""
    schema = "map<string,struct<train_npz:string,val_npz:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("m"))
    return raw.select("path", F.explode("m").alias("fold_id", "f")).select("path", "fold_id", F.col("f.train_npz").alias("train_ref"), F.col("f.val_npz").alias("val_ref"))


def fold_map_listing(spark: SparkSession, path: str) -> DataFrame:
    schema = "map<string,struct<train_npz:string,val_npz:string>>"
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", schema)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.coalesce(F.size(m), F.lit(0)).alias("folds"), F.sort_array(F.map_keys(m)).alias("heldout_segments"))
