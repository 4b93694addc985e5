"""Ledger tables read from parquet with JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgate.operators.rules import validate_runs


def read_runs(raw: DataFrame, limit: int | str | None = None) -> DataFrame:
    """Runs with decoded metrics; rows that break the metric contract are dropped.

    A limit keeps the newest valid runs; None, 0, ``all`` or ``none`` keep every run.
    """
    unlimited = limit is None or str(limit).lower() in {"0", "all", "none"}
    parsed = raw.withColumn("metrics", F.try_parse_json("metrics_json"))
    valid = validate_runs(parsed).filter("contract_error IS NULL")
    return valid if unlimited else valid.orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(int(limit))


def read_ledger(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One ledger table; files written before a column was added still read."""
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{table}")
