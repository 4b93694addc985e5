"""Logistic-regression scorer trained by full-batch gradient descent, and leave-one-out evaluation.

One aggregate per epoch computes the gradients of all models. Where each row trains one model, the short model table is
broadcast once its rows are counted. Where each row trains all models but one (leave-one-out), all of them are one small
matrix: tasks send back a gradient per fold and feature, never a pixel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.functions.columns import bounded_join, null_safe_join
from evalgate.operators.metrics import EvalConfig, evaluate
from evalgate.session import checkpointed, written


@dataclass
class LogregConfig:
    features: list[str] = field(default_factory=lambda: ["v", "bias", "mean4", "residual"])
    bias: str = "bias"
    learning_rate: float = 0.2
    epochs: int = 4
    l2: float = 0.0
    pos_weight: float | str = 2.0


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _margin(features: list[str], prefix: str = "w_") -> Column:
    z = F.lit(0.0)
    for f in features:
        z = z + F.col(f) * F.col(f"{prefix}{f}")
    return z


def initial_model(train: DataFrame, by: list[str], cfg: LogregConfig) -> DataFrame:
    """Zero weights with the prior log-odds as intercept, and the resolved positive weight."""
    y = (F.col("label") > 0.5).cast("double")
    prior = F.least(F.greatest(F.avg(y), F.lit(1e-4)), F.lit(1.0 - 1e-4))
    pos = F.greatest(F.sum(y), F.lit(1.0))
    neg = F.greatest(F.count(F.lit(1)) - F.sum(y), F.lit(1.0))
    weight = F.least(F.sqrt(neg / pos), F.lit(10.0)) if cfg.pos_weight == "auto" else F.lit(float(cfg.pos_weight))
    zeros = [F.lit(0.0).alias(f"w_{f}") for f in cfg.features if f != cfg.bias]
    model = train.groupBy(*by).agg(prior.alias("_p"), weight.alias("pos_weight"), F.count(F.lit(1)).alias("n"))
    return model.select(*by, "pos_weight", "n", *zeros, F.ln(F.col("_p") / (1.0 - F.col("_p"))).alias(f"w_{cfg.bias}"), F.lit(None).cast("double").alias("train_loss"))


def train_logreg(train: DataFrame, by: list[str], cfg: LogregConfig | None = None) -> DataFrame:
    """Weights and last training loss per group after ``cfg.epochs`` steps.

    ``train`` should be checkpointed or written by the caller when its features are costly: each
    epoch reads it once. The model table is written every epoch, so a lost executor
    repeats one step and the plan does not grow.
    """
    cfg = cfg or LogregConfig()
    model = written(initial_model(train, by, cfg))
    for _ in range(cfg.epochs):
        rows = bounded_join(train, model.drop("train_loss"), by)
        y = (F.col("label") > 0.5).cast("double")
        p = sigmoid(_margin(cfg.features))
        sw = F.when(F.col("label") > 0.5, F.col("pos_weight")).otherwise(1.0)
        rows = rows.select(*by, *cfg.features, p.alias("_p"), y.alias("_y"), sw.alias("_sw"))
        loss = -F.avg(F.col("_sw") * (F.col("_y") * F.ln(F.col("_p") + 1e-7) + (1.0 - F.col("_y")) * F.ln(1.0 - F.col("_p") + 1e-7)))
        err = (F.col("_p") - F.col("_y")) * F.col("_sw")
        grads = rows.groupBy(*by).agg(loss.alias("train_loss"), *[F.sum(err * F.col(f)).alias(f"g_{f}") for f in cfg.features])
        step = null_safe_join(model.drop("train_loss"), grads, by)
        model = written(step.select(*by, "pos_weight", "n", *[
            (F.col(f"w_{f}") - cfg.learning_rate * (F.col(f"g_{f}") / F.greatest(F.col("n"), F.lit(1)) + cfg.l2 * F.col(f"w_{f}"))).alias(f"w_{f}")
            for f in cfg.features], "train_loss"))
    return model


def score_logreg(features: DataFrame, model: DataFrame, by: list[str], cfg: LogregConfig | None = None) -> DataFrame:
    """Probabilities of each row under its group's model."""
    cfg = cfg or LogregConfig()
    weights = [f"w_{f}" for f in cfg.features]
    scored = bounded_join(features, model.select(*by, *weights), by)
    return scored.withColumn("prob", sigmoid(_margin(cfg.features))).drop(*weights)


#: Folds whose models are trained in one pass over the rows; more folds take more passes.
FOLDS = 512


def train_leave_out(data: DataFrame, segment: str, cfg: LogregConfig | None = None, folds: int = FOLDS) -> DataFrame:
    """A model per segment, trained on the rows of all other segments: (heldout_segment, pos_weight, n, w_..., train_loss).

    Counts of a fold are the total less its own. An epoch is one pass: each task multiplies its rows with the matrix of models
    (folds x features), leaves out the rows of a fold's own segment and sums the gradients, so that a task sends one short row
    per fold. A segment without other rows has no model. Rows are read once per epoch, so checkpoint costly features before.
    """
    cfg = cfg or LogregConfig()
    spark = data.sparkSession
    positive = F.sum(F.when(F.col("label") > 0.5, 1.0).otherwise(0.0)).alias("positives")
    own = data.groupBy(F.col(segment).alias("heldout_segment")).agg(F.count(F.lit(1)).alias("rows"), positive)
    totals = own.agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives")).first()
    kind = own.schema["heldout_segment"].dataType.simpleString()
    schema = f"heldout_segment {kind}, pos_weight double, n long, {', '.join(f'w_{f} double' for f in cfg.features)}, train_loss double"
    parts = [spark.createDataFrame([], schema)]
    known = checkpointed(own.filter(F.col("rows") < (totals["rows"] or 0)))
    blocks = max(1, -(-known.count() // folds))
    block_of = F.pmod(F.xxhash64("heldout_segment"), F.lit(blocks))
    for block in range(blocks):
        mine = known.filter(block_of == block).collect()
        if mine:
            parts.append(spark.createDataFrame(_descend(data, segment, mine, totals, cfg), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _descend(data: DataFrame, segment: str, folds: list, totals, cfg: LogregConfig) -> list[tuple]:
    """Final rows of the models of one block of folds; only matrices of folds x features are held here."""
    names = [f["heldout_segment"] for f in folds]
    n = np.array([totals["rows"] - f["rows"] for f in folds], dtype=np.float64)
    positives = np.array([totals["positives"] - f["positives"] for f in folds])
    prior = np.clip(positives / n, 1e-4, 1.0 - 1e-4)
    weight = np.minimum(np.sqrt(np.maximum(n - positives, 1.0) / np.maximum(positives, 1.0)), 10.0) if cfg.pos_weight == "auto" else np.full(len(n), float(cfg.pos_weight))
    models = np.zeros((len(n), len(cfg.features)))
    models[:, cfg.features.index(cfg.bias)] = np.log(prior / (1.0 - prior))
    loss: list[float | None] = [None] * len(n)
    slim = data.select(segment, "label", *cfg.features)
    for _ in range(cfg.epochs):
        sums = _gradients(slim, {name: i for i, name in enumerate(names)}, models, weight).groupBy("fold").agg(
            F.sum("loss").alias("loss"), *[F.sum(F.col("gradient")[i]).alias(f"g{i}") for i in range(len(cfg.features))])
        gradient = np.zeros_like(models)
        for row in sums.collect():
            gradient[row["fold"]] = row[2:]
            loss[row["fold"]] = row["loss"] / n[row["fold"]]
        models = models - cfg.learning_rate * (gradient / n[:, None] + cfg.l2 * models)
    return [(name, float(p), int(k), *m, None if x is None else float(x)) for name, p, k, m, x in zip(names, weight, n, models.tolist(), loss, strict=True)]


def _gradients(rows: DataFrame, number: dict, models: np.ndarray, weight: np.ndarray) -> DataFrame:
    """A row per task and fold: (fold, loss, gradient), sums over the task's rows of other segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, loss = np.zeros_like(models), np.zeros(len(models))
        for batch in batches:
            own = np.array([number.get(s, -1) for s in batch.column(0).to_pylist()], dtype=np.int64)
            y = (np.nan_to_num(batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)) > 0.5).astype(np.float64)[:, None]
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1)
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ models.T, -30.0, 30.0)))
            share = np.where(y > 0.5, weight[None, :], 1.0)
            mine = np.flatnonzero(own >= 0)
            share[mine, own[mine]] = 0.0
            gradient += ((p - y) * share).T @ x
            loss -= (share * (y * np.log(p + 1e-7) + (1.0 - y) * np.log(1.0 - p + 1e-7))).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(loss), pa.array(gradient.tolist(), pa.list_(pa.float64()))], names=["fold", "loss", "gradient"])

    return rows.mapInArrow(run, "fold int, loss double, gradient array<double>")


def loo_evaluate(features: DataFrame, segment: str, seeds: list, order: list[str], cfg: LogregConfig | None = None,
                 eval_cfg: EvalConfig | None = None) -> DataFrame:
    """Train on every other segment, score the held-out one, and evaluate all folds and seeds together.

    The full-batch trainer has no random part, so the seeds of a fold share one model. Folds whose
    training side is empty come back as failed rows (``returncode`` 1).
    """
    cfg = cfg or LogregConfig()
    data = checkpointed(features)
    held = data.select(F.col(segment).alias("heldout_segment")).distinct()
    model = checkpointed(train_leave_out(data, segment, cfg))
    scored = score_logreg(data.withColumn("heldout_segment", F.col(segment)), model, ["heldout_segment"], cfg)
    metrics = evaluate(checkpointed(scored.select("heldout_segment", *order, "prob", "label")), ["heldout_segment"], order, eval_cfg)
    tasks = held.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    rows = null_safe_join(tasks, metrics.withColumn("_ok", F.lit(True)), ["heldout_segment"], "left")
    ok = F.col("_ok").isNotNull()
    return rows.withColumns({"returncode": F.when(ok, 0).otherwise(1), "error": F.when(~ok, "no training segments for fold")}).drop("_ok")
