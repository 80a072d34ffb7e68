"""Projection, cleaning, hole masks, and the wide and long forms of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions.holes import known, q
from lacuna.functions.text import MASK_TOKEN, cell_text
from lacuna.roles import Roles


def project(df: DataFrame, roles: Roles) -> DataFrame:
    """Key, continuous, then categorical columns."""
    return df.select(roles.key, *[q(f) for f in roles.features])


def named_like(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def all_but(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def drop_holes(df: DataFrame, columns=None) -> DataFrame:
    """Rows without any hole, NULL or NaN."""
    return df.dropna("any", subset=list(columns) if columns else None)


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """One row: the number of holes of every column, in one pass."""
    names = list(columns or df.columns)
    return df.agg(*[F.count_if(known(df, c).isNull()).alias(c) for c in names])


def assert_no_holes(df: DataFrame, columns=None) -> DataFrame:
    """``df`` itself, or an error that names the columns with holes."""
    found = null_counts(df, columns).first().asDict()
    bad = {c: n for c, n in found.items() if n}
    if bad:
        raise ValueError(f"missing values: {bad}")
    return df


def fill_token(df: DataFrame, features, token: str = MASK_TOKEN) -> DataFrame:
    """Features as text with the mask token in their holes."""
    return df.withColumns({f: cell_text(df, f, token) for f in features})


def missing_features(df: DataFrame, roles: Roles, out: str = "missing") -> DataFrame:
    """key + the names of the holes of each row, in role order."""
    names = F.array(*[F.when(known(df, f).isNull(), F.lit(f)) for f in roles.features])
    return df.select(roles.key, F.array_compact(names).alias(out))


def apply_mask(df: DataFrame, hidden: dict[str, Column]) -> DataFrame:
    """Punch a hole wherever the condition of a column holds."""
    return df.withColumns({f: F.when(F.coalesce(c, F.lit(False)), None).otherwise(q(f)) for f, c in hidden.items()})


def mask_table(df: DataFrame, roles: Roles, hidden: dict[str, Column]) -> DataFrame:
    """key + one boolean per feature, true where a cell is hidden."""
    return df.select(roles.key, *[
        F.coalesce(hidden[f], F.lit(False)).alias(f) if f in hidden else F.lit(False).alias(f)
        for f in roles.features])


def to_cells(df: DataFrame, roles: Roles, features=None) -> DataFrame:
    """Long form: key, feature, value (double), one row per cell, holes included."""
    names = list(features or roles.features)
    wide = df.select(roles.key, *[known(df, f).cast("double").alias(f) for f in names])
    return wide.unpivot([roles.key], [q(f) for f in names], "feature", "value")


def from_cells(cells: DataFrame, roles: Roles, features=None) -> DataFrame:
    """Back to one row per key."""
    names = list(features or roles.features)
    wide = cells.groupBy(roles.key).pivot("feature", names).agg(F.first("value", ignorenulls=True))
    return wide.select(roles.key, *[q(f) for f in names])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
