"""Texts of numbers and queries that print them, against C's printf and the check SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgate.functions.columns import fixed_text
from evalgate.plans.catalog import ORACLES, QUERIES

from .oracle import duck, normal


def test_text_is_that_of_printf(spark):
    rng = np.random.default_rng(1)
    ties = [k / 128 for k in range(-127, 128, 2)] + [k / 640 for k in range(1, 640, 2)]
    near = [float(np.nextafter(v, d)) for v in ties[:40] for d in (-1, 1)]
    decimals = [round(float(v), 7) for v in rng.random(500)] + [int(v) / 10**6 + 5e-7 for v in rng.integers(0, 10**7, 500)]
    values = [*ties, *near, *decimals, *rng.normal(size=500).tolist(), 0.0, -0.0, -1e-7, 5e-7, 1e-300, 0.9999995, 12345.6789125, 2.0**40, -3.5e9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", fixed_text(F.col("v")).alias("t")).collect()}
    assert got.pop(-1) is None
    assert {i: t for i, t in got.items() if t != f"{values[i]:.6f}"} == {}
    assert any(t != "%.6f" % (math.floor(abs(values[i]) * 1e6 + 0.5) / 1e6) for i, t in got.items() if values[i] > 0)


@pytest.mark.parametrize("name", ["c4_patches", "c12_augmented"])
def test_patches_with_ties_equal_their_sql(spark, tmp_path, name):
    """Embeddings whose seventh decimal is an exact 5."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(v) for v in rng.integers(-70, 70, 64) / 128]) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    part = next((tmp_path / "embeddings.parquet").glob("*.parquet"))
    con = duck(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{part}')")
    assert normal(QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(con.execute(ORACLES[name]).df())


def test_gates_and_warnings_print_like_their_sql(spark):
    """A tie, a value just below a tie and a missing one."""
    from evalgate.operators import compare as H

    cols = "label int, folds_failed long, positive_rate_alarm_count long, zero_precision_or_recall_count long, fixed_threshold_not_ok_count long, m double, mean_average_precision double, worst_fold_val_f1 double"
    rows = [(1, 0, 0, 0, 0, 57 / 128, 0.1234565, None)]
    s = spark.createDataFrame(rows, cols).withColumnRenamed("m", "median_over_seeds_median_val_f1")
    got = {r.ordinal: (r.passed, r.detail) for r in H.loo_gates(s, ["label"], 0.3, 0.35, 0.2, 2).collect()}
    assert got[3] == (True, "value=0.445312, floor=0.3") and got[4] == (False, "value=0.123456, floor=0.35") and got[5] == (False, "value=None, floor=0.2")
