"""Connectors on small files written by the tests."""

import json
import os

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalgate.sources import catalogs as A
from evalgate.sources import files as S
from evalgate.sources import npz as N


def _npz(path, n=3, c=2, p=4, meta=None):
    rng = np.random.default_rng(1)
    images = rng.random((n, c, p, p), dtype=np.float32)
    labels = (rng.random((n, 1, p, p)) > 0.7).astype(np.float32)
    np.savez_compressed(path, images=images, labels=labels)
    if meta is not None:
        (path.parent / (path.stem + ".metadata.json")).write_text(json.dumps(meta))
    return images, labels


def test_patch_archives_round_trip(spark, tmp_path):
    images, labels = _npz(tmp_path / "train.npz", meta={"segment_id": "s1", "split": "train"})
    _npz(tmp_path / "extra.npz", n=2, meta={"segment_id": "s2", "split": "train"})
    df = N.read_patches(spark, str(tmp_path / "train.npz"), str(tmp_path / "extra.npz"))
    rows = {(r.segment_id, r.patch_id): r for r in df.collect()}
    assert len(rows) == 5
    np.testing.assert_allclose(rows[("s1", 1)].image, images[1].ravel(), rtol=1e-6)
    np.testing.assert_allclose(rows[("s1", 1)].label, labels[1].ravel())
    out = str(tmp_path / "table")
    N.write_patches(df, out)
    assert spark.read.parquet(out).filter("segment_id = 's1'").count() == 3
    with pytest.raises(PySparkException):
        N.write_patches(df, out)
    N.write_patches(df, out, overwrite=True)


def test_patch_archive_without_labels_fails(spark, tmp_path):
    np.savez(tmp_path / "bad.npz", images=np.zeros((1, 1, 2, 2), np.float32))
    with pytest.raises(PySparkException, match="missing keys"):
        N.read_patches(spark, str(tmp_path / "bad.npz")).collect()


def test_rasters_pick_middle_layer_and_check_shapes(spark, tmp_path):
    seg = tmp_path / "seg" / "layers"
    seg.mkdir(parents=True)
    for i in range(5):
        np.save(seg / f"{i:02d}.npy", np.full((3, 4), i, np.float32))
    np.save(tmp_path / "seg" / "inklabels.npy", np.eye(3, 4) * 255)
    rows = S.read_rasters(spark, str(tmp_path)).orderBy("y").collect()
    assert [r.y for r in rows] == [0, 1, 2]
    assert rows[0].image == [2.0] * 4 and rows[1].label == [0.0, 1.0, 0.0, 0.0] and rows[0].mask is None
    np.save(tmp_path / "seg" / "inklabels.npy", np.zeros((2, 4)))
    with pytest.raises(PySparkException, match="shape mismatch"):
        S.read_rasters(spark, str(tmp_path)).collect()


def test_manifest_forms(spark, tmp_path):
    for name, doc in {"a": [{"segment_id": "1"}, {"segment_id": "2"}], "b": {"segments": [{"segment_id": "3"}]}, "c": {"labeled_segments": [{"segment_id": "4"}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        got = [r.segment_id for r in A.read_manifest(spark, str(tmp_path / f"{name}.json")).orderBy("pos").collect()]
        assert got == {"a": ["1", "2"], "b": ["3"], "c": ["4"]}[name]
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(PySparkException):
        A.read_manifest(spark, str(tmp_path / "d.json")).collect()


def test_fold_maps(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"f2": {"train_npz": "a", "val_npz": "b"}, "f1": {"train_npz": "c", "val_npz": "d"}}))
    got = {r.fold_id: (r.train_ref, r.val_ref) for r in A.read_fold_map(spark, str(tmp_path)).collect()}
    assert got == {"f1": ("c", "d"), "f2": ("a", "b")}
    listing = A.fold_map_listing(spark, str(tmp_path)).first()
    assert listing.folds == 2 and listing.heldout_segments == ["f1", "f2"]


def test_listing_links(spark):
    html = 'x <a href="11.zarr/">v</a> <a href="12.zarr/">v</a> <a href="12_inklabels.png">l</a> <a href="13_inklabels.png">l</a>'
    df = spark.createDataFrame([(html,)], "html string")
    assert [r.segment_id for r in A.catalog_from_html(df).collect()] == ["12"]


def test_threshold_csv_fails_on_bad_row(spark, tmp_path):
    head = "threshold,precision,recall,f05,f1,pred_positive_rate\n"
    (tmp_path / "ok.csv").write_text(head + "0.5,0.1,0.2,0.3,0.4,0.5\n")
    assert S.read_threshold_rows(spark, str(tmp_path / "ok.csv")).first().f1 == 0.4
    (tmp_path / "bad.csv").write_text(head + "0.5,x,0.2,0.3,0.4,0.5\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        S.read_threshold_rows(spark, str(tmp_path / "bad.csv")).collect()


def test_loo_summaries_with_companions(spark, tmp_path):
    for i in range(10):
        p = tmp_path / f"r{i}.summary.json"
        p.write_text(json.dumps({"promotion_ready": i % 2 == 0, "run_ids": [f"run{i}"]}))
        os.utime(p, (1000 + i, 1000 + i))
    (tmp_path / "broken.summary.json").write_text("{")
    (tmp_path / "other.summary.json").write_text('{"x": 1}')
    (tmp_path / "r9.jsonl").write_text('{"heldout_segment": "a", "seed": 1, "returncode": 0, "val_f1": 0.5}\n')
    (tmp_path / "r0.jsonl").write_text('{"heldout_segment": "z"}\n')
    assert S.read_loo_summaries(spark, str(tmp_path))[0].count() == 10
    kept, rows = S.read_loo_summaries(spark, str(tmp_path), limit=8)
    got = [r.run_ids[0] for r in kept.orderBy(F.col("modified_at").desc()).collect()]
    assert got == [f"run{i}" for i in range(9, 1, -1)]
    assert [r.heldout_segment for r in rows.collect()] == ["a"]
    assert S.read_loo_rows(spark, str(tmp_path / "r9.jsonl")).first().val_f1 == 0.5


def test_full_tile_metrics(spark, tmp_path):
    def put(run, tile, doc):
        d = tmp_path / run / tile
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))

    put("r1", "full_tile_b", {"tile_f1": 0.5, "average_precision": 0.4, "val_positive_rate": 0.1, "pred_positive_rate": 0.15, "fixed_threshold_f1": 0.4,
                              "evaluation_region": {"segment_id": "s2", "type": "whole_segment"}, "promotion_checks": {"eligible": True}, "threshold_risk_summary": {"selected": {}}})
    put("r2", "full_tile", {"val_f1": 0.05, "evaluation_region": {"segment_id": "s1"}})
    put("r3", "full_tile", "{broken")
    rows = S.read_full_tile_metrics(spark, str(tmp_path)).collect()
    assert [r.segment_id for r in rows] == ["s1", "s2"]
    assert rows[1].val_f1 == 0.5 and rows[1].has_risk and rows[1].checks_eligible and rows[1].verdict == "pass"
    assert rows[0].verdict == "fail" and "weak_full_tile_f1" in rows[0].reasons


def test_configs_keep_errors(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("model:\n  name: x\n  depth: 2\n")
    (tmp_path / "b.json").write_text('{"model": {"name": "y"}}')
    (tmp_path / "c.yml").write_text("a: [1,")
    for i, n in enumerate(["a.yaml", "b.json", "c.yml"]):
        os.utime(tmp_path / n, (100 + i, 100 + i))
    rows = S.read_configs(spark, str(tmp_path)).select("path", "error", F.try_variant_get("doc", "$.model.name", "string").alias("name")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["c.yml", "b.json", "a.yaml"]
    assert rows[0].error and [r.name for r in rows[1:]] == ["y", "x"]


def test_inventories(spark, tmp_path):
    runs = tmp_path / "runs"
    for r in ("r1", "r2"):
        (runs / r).mkdir(parents=True)
        for i, n in enumerate(["metrics.json", "probability_map.npy", "z.txt"]):
            (runs / r / n).write_text("x" * (i + 1))
            os.utime(runs / r / n, (100 + i, 100 + i))
    listed, totals = S.artifact_inventory(spark, str(runs), per_run=2)
    names = [r.path.rsplit("/", 1)[1] for r in listed.filter("run_dir = 'r1'").orderBy("position").collect()]
    assert names == ["probability_map.npy", "z.txt"]
    t = totals.first()
    assert t.run_directory_count == 2 and t.total_bytes == 12
    (tmp_path / "p.metadata.json").write_text('{"segment_id": "s", "samples": 4}')
    (tmp_path / "q.metadata.json").write_text("{")
    inv = {r.path.rsplit("/", 1)[1]: r for r in S.dataset_inventory(spark, str(tmp_path)).collect()}
    assert inv["p.metadata.json"].samples == 4 and inv["q.metadata.json"].metadata_error


def test_outputs_are_all_or_nothing(spark, tmp_path):
    probs = spark.createDataFrame([(0, 0, 0.5)], "y int, x int, prob double")
    metrics = spark.createDataFrame([(0.5,)], "val_f1 double")
    rows = spark.createDataFrame([(0.5, 0.1, 0.2, 0.3, 0.4, 0.5)], S.THRESHOLD_SCHEMA)
    out = str(tmp_path / "out")
    paths = S.write_outputs(spark, probs, metrics, rows, out)
    assert S.read_threshold_rows(spark, paths["metrics_by_threshold"]).count() == 1
    assert S.read_outputs(spark, out)["probability_map"].count() == 1
    with pytest.raises(FileExistsError):
        S.write_outputs(spark, probs, metrics, rows, out)
    other = str(tmp_path / "other")
    with pytest.raises(PySparkException):
        S.write_outputs(spark, probs, metrics.select(F.raise_error(F.lit("boom")).alias("x")), rows, other)
    with pytest.raises(FileNotFoundError):
        S.read_outputs(spark, other)
