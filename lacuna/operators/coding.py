"""Category dimensions: sorted distinct values with 0-based codes, and coding both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from lacuna.functions.holes import q
from lacuna.operators.position import with_position
from lacuna.scratch import cut


def build_dimension(df: DataFrame, columns) -> DataFrame:
    """feature, value (text), code. Numbers sort as numbers, text as text."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = df.select(*[q(c).cast("string").alias(c) for c in columns])
    levels = (texts.unpivot([], [q(c) for c in columns], "feature", "value").where("value IS NOT NULL").distinct()
              .withColumn("number", F.when(F.col("feature").isin(numeric), F.col("value").try_cast("double"))))
    placed = with_position(cut(levels, "levels"), ["feature", "number", "value"], "pos", "dimension")
    starts = {r["feature"]: r["start"] for r in placed.groupBy("feature").agg(F.min("pos").alias("start")).collect()}  # one row per column
    start = F.lit(0)
    for feature, at in starts.items():
        start = F.when(F.col("feature") == feature, F.lit(at)).otherwise(start)
    return placed.select("feature", "value", (F.col("pos") - start).cast("int").alias("code"))


def encode(df: DataFrame, dimension: DataFrame, columns) -> DataFrame:
    """Values to codes; NULL and values outside the dimension become NULL.

    The dimension is a written table of known size: Spark broadcasts it while it is below the
    broadcast threshold and shuffles otherwise.
    """
    for c in columns:
        levels = dimension.where(F.col("feature") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code"))
        df = df.join(levels, q(c).cast("string") == F.col("__value"), "left").drop("__value")
        df = df.withColumn(c, F.col("__code")).drop("__code")
    return df


def decode(df: DataFrame, dimension: DataFrame, columns, types: dict | None = None) -> DataFrame:
    """Codes to values; an unknown code becomes NULL. ``types`` restores the original column types."""
    for c in columns:
        levels = dimension.where(F.col("feature") == c).select(
            F.col("code").alias("__code"), F.col("value").alias("__value"))
        df = df.join(levels, q(c).cast("int") == F.col("__code"), "left").drop("__code")
        value = F.col("__value").cast(types[c]) if types and c in types else F.col("__value")
        df = df.withColumn(c, value).drop("__value")
    return df


def level_counts(df: DataFrame, columns, approximate: bool = False) -> DataFrame:
    """Number of distinct values of each column; one row."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(q(c)).alias(c) for c in columns])
    return df.agg(*[F.count_distinct(q(c)).alias(c) for c in columns])
