"""Versioned outputs: parts are written to a folder of their own, and one appended row makes them the current version.

``path/data/<id>/<part>`` holds the parts, ``path/commits`` a row per version. Nothing reads a part except through the last
commit, so a failure at any point leaves the version before it whole, and readers of that version keep their files. Folders of
old versions and of writes that failed stay until they are removed by whoever owns ``path``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMITS = "version long, folder string, parts string, covers long, committed_at timestamp"
Writer = Callable[[DataFrame, str], None]


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits below a path; none where nothing has been committed."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path.rstrip('/')}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def last_commit(spark: SparkSession, path: str) -> Row | None:
    return commits(spark, path).orderBy(F.col("version").desc(), F.col("folder").desc()).first()


def stage(parts: dict[str, tuple[DataFrame, Writer]], path: str) -> str:
    """Write the parts to a new folder that no reader knows yet."""
    folder = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    for name, (rows, writer) in parts.items():
        writer(rows, f"{folder}/{name}")
    return folder


def commit(spark: SparkSession, path: str, folder: str, parts: list[str], covers: int | None = None) -> int:
    """Make a staged folder the current version: one row in one file."""
    last = last_commit(spark, path)
    version = (last["version"] if last else 0) + 1
    row = spark.createDataFrame([(version, folder, ",".join(parts), covers)], "version long, folder string, parts string, covers long")
    row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")
    return version


def current_folder(spark: SparkSession, path: str) -> str:
    last = last_commit(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing committed below {path}")
    return last["folder"]
