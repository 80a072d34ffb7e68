"""Scoring pairs by a density ratio and learning a metric from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.functions import vectors as V
from lacuna.scratch import cut


def pair_logits(pairs: DataFrame, ratio) -> DataFrame:
    """epoch, batch_id, label, logit: each triple once as a positive and once as a negative pair.

    ``pairs`` holds h_x, h_pos, h_neg; ``ratio(h_x, h_u)`` is a column expression.
    """
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), ratio(F.col("h_x"), F.col("h_pos")).alias("logit")),
        F.struct(F.lit(0.0).alias("label"), ratio(F.col("h_x"), F.col("h_neg")).alias("logit")))
    return pairs.select("epoch", "batch_id", F.explode(both).alias("e")).select("epoch", "batch_id", "e.*")


def batch_losses(logits: DataFrame) -> DataFrame:
    """Mean binary cross-entropy per batch."""
    return logits.groupBy("epoch", "batch_id").agg(
        F.avg(V.binary_cross_entropy(F.col("logit"), F.col("label"))).alias("bce_loss"))


def epoch_losses(losses: DataFrame) -> DataFrame:
    """Mean of the batch losses per epoch."""
    return losses.groupBy("epoch").agg(F.avg("bce_loss").alias("bce_loss"))


@dataclass(frozen=True)
class LearnedMetric:
    """Density ratio <w * h_x, h_u> + a(h_x) + b(h_u) fitted to pairs."""

    weights: np.ndarray
    a: np.ndarray
    b: np.ndarray
    bias: float

    def scale(self, df: DataFrame, vector: str) -> DataFrame:
        """Vectors times the root of the non-negative product weights, so a dot product carries them."""
        root = V.literal_vector(np.sqrt(np.maximum(self.weights, 0.0)))
        return df.withColumn(vector, F.zip_with(F.col(vector).cast("array<double>"), root, lambda x, w: x * w))


def learn_metric(pairs: DataFrame, max_iter: int = 100, reg: float = 1e-3) -> LearnedMetric:
    """Logistic regression of positive against negative pairs on [h_x * h_u, h_x, h_u]."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def wide(c):
        return F.col(c).cast("array<double>")

    def features(u):
        return F.concat(F.zip_with(wide("h_x"), wide(u), lambda x, y: x * y), wide("h_x"), wide(u))

    rows = pairs.select(F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), features("h_pos").alias("x")),
        F.struct(F.lit(0.0).alias("label"), features("h_neg").alias("x")))).alias("e")).select(
            F.col("e.label").alias("label"), array_to_vector(F.col("e.x")).alias("features"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg, standardization=False).fit(rows)
    w = model.coefficients.toArray()
    d = len(w) // 3
    return LearnedMetric(w[:d], w[d:2 * d], w[2 * d:], model.intercept)


@dataclass(frozen=True)
class Step:
    """Gradient and loss of the density ratio at given weights: means over batches of the mean over a batch's pairs."""

    gradient: np.ndarray
    loss: float
    batches: float


def _batch_vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def gradient_step(triples: DataFrame, weights: np.ndarray) -> Step:
    """One pass over triples with ``share`` (1 / rows of the batch). Tasks add up their rows, Spark the tasks; one row comes back.

    A pair has the features [h_x * h_u, h_x, h_u, 1] and the logit of their product with ``weights``.
    """
    out = StructType.fromDDL("gradient array<double>, loss double, batches double")

    def run(batches):
        types = to_arrow_schema(out)
        gradient, loss, seen = np.zeros(len(weights)), 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, share = _batch_vectors(batch.column("h_x")), batch.column("share").to_numpy()
            seen += share.sum()
            for name, label in (("h_pos", 1.0), ("h_neg", 0.0)):
                u = _batch_vectors(batch.column(name))
                f = np.concatenate([x * u, x, u, np.ones((len(x), 1))], axis=1)
                z = f @ weights
                chance = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
                gradient += f.T @ ((chance - label) * share) / 2
                loss += float(((np.maximum(z, 0) - z * label + np.log1p(np.exp(-np.abs(z)))) * share).sum()) / 2
        yield pa.RecordBatch.from_arrays([pa.array([gradient.tolist()], types.field("gradient").type), pa.array([loss]), pa.array([seen])], schema=types)

    parts = triples.select("h_x", "h_pos", "h_neg", "share").mapInArrow(run, out)
    got = parts.agg(F.sum("loss").alias("loss"), F.sum("batches").alias("batches"), *[F.sum(F.get("gradient", F.lit(i))) for i in range(len(weights))]).first()
    many = got["batches"] or 1.0
    return Step(np.array([g or 0.0 for g in got[2:]]) / many, (got["loss"] or 0.0) / many, got["batches"] or 0.0)


def tune_metric(spark, triples_of: Callable[[int], DataFrame], dim: int, epochs: int = 5, steps: int = 4, rate: float = 0.1) -> tuple[LearnedMetric, DataFrame]:
    """(metric, losses): the density ratio fitted by gradient steps, starting from the plain dot product.

    ``triples_of(epoch)`` gives batch_id, h_x, h_pos, h_neg. The batches of an epoch are dealt into ``steps`` parts; a step moves the weights
    against the mean gradient of its part's batches, and the weights are carried from step to step and epoch to epoch. A step is one Spark
    job, so it takes many small batches at once. losses: epoch, bce_loss (the mean over batches, each at the weights its step
    began with). An epoch without triples has a NULL loss and moves nothing.
    """
    if min(epochs, steps) < 1:
        raise ValueError("epochs and steps must be at least 1")
    weights = np.concatenate([np.ones(dim), np.zeros(2 * dim + 1)])
    losses = []
    for epoch in range(epochs):
        share = 1 / F.count(F.lit(1)).over(W.partitionBy("batch_id"))  # rows of one mini-batch
        triples = cut(triples_of(epoch).select("batch_id", "h_x", "h_pos", "h_neg", share.alias("share")), "triples")
        total = batches = 0.0
        for step in range(steps):
            made = gradient_step(triples.where(F.pmod("batch_id", F.lit(steps)) == step), weights)
            weights = weights - rate * made.gradient
            total, batches = total + made.loss * made.batches, batches + made.batches
        losses.append((epoch, total / batches if batches else None))
    metric = LearnedMetric(weights[:dim], weights[dim:2 * dim], weights[2 * dim:3 * dim], float(weights[-1]))
    return metric, spark.createDataFrame(losses, "epoch int, bce_loss double")
