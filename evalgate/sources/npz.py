"""Patch archives: a Python data source reading one file per partition, and a guarded writer."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("path string, segment_id string, split string, patch_id int, channels int, h int, w int, label_channels int, "
          "image array<float>, label array<float>, metadata string")
_ARROW = pa.schema([
    ("path", pa.string()), ("segment_id", pa.string()), ("split", pa.string()), ("patch_id", pa.int32()), ("channels", pa.int32()),
    ("h", pa.int32()), ("w", pa.int32()), ("label_channels", pa.int32()), ("image", pa.list_(pa.float32())), ("label", pa.list_(pa.float32())),
    ("metadata", pa.string()),
])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    """A deflated archive member cannot be split, so a file is the unit of work; rows stream in batches."""

    def __init__(self, options: dict) -> None:
        self.pattern = options.get("path", "")
        self.batch = int(options.get("batch", "256"))

    def partitions(self) -> list[InputPartition]:
        found = self.pattern
        if os.path.isdir(found):
            found = os.path.join(found, "**", "*.npz")
        paths = sorted(glob.glob(found, recursive=True))
        if not paths:
            raise FileNotFoundError(f"no patch archives match {self.pattern}")
        return [_File(p) for p in paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.path
        sidecar = os.path.splitext(path)[0] + ".metadata.json"
        text, meta = None, {}
        if os.path.exists(sidecar):
            with open(sidecar, encoding="utf-8") as fh:
                text = fh.read()
            try:
                meta = json.loads(text)
            except ValueError:
                meta = {}
        with np.load(path) as data:
            missing = {"images", "labels"} - set(data.files)
            if missing:
                raise ValueError(f"{path}: missing keys {sorted(missing)}")
            images, labels = data["images"], data["labels"]
        if images.ndim != 4 or labels.ndim != 4:
            raise ValueError(f"{path}: expected 4-D arrays, got {images.shape} and {labels.shape}")
        n, c, h, w = images.shape
        for start in range(0, n, self.batch):
            part = range(start, min(start + self.batch, n))
            rows = [
                {"path": path, "segment_id": str(meta["segment_id"]) if meta.get("segment_id") is not None else None, "split": meta.get("split"),
                 "patch_id": i, "channels": c, "h": h, "w": w, "label_channels": int(labels.shape[1]),
                 "image": images[i].astype(np.float32).ravel(), "label": labels[i].astype(np.float32).ravel() if i < len(labels) else None, "metadata": text}
                for i in part
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class NpzDataSource(DataSource):
    """``spark.read.format("npz").load(path_or_glob)``."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_patches(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """Patches of one or more archives; extra training files are appended."""
    spark.dataSource.register(NpzDataSource)
    out = spark.read.format("npz").load(path)
    for p in extra:
        out = out.unionByName(spark.read.format("npz").load(p))
    return out


def write_patches(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Patch table partitioned by segment and split; an existing path is refused unless told otherwise."""
    df.write.partitionBy("segment_id", "split").mode("overwrite" if overwrite else "errorifexists").parquet(path)
