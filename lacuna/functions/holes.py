"""What counts as a hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col(f"`{name}`")


def known(df: DataFrame, name: str) -> Column:
    """A cell by its name; NaN in a column of floats is a hole like NULL."""
    kind = df.schema[name].dataType
    return F.nanvl(q(name), F.lit(None).cast(kind)) if isinstance(kind, (FloatType, DoubleType)) else q(name)


def nan_as_null(df: DataFrame, columns=None) -> DataFrame:
    """``df`` with NULL wherever a float column, of those named, holds NaN."""
    names = [c for c in columns or df.columns if isinstance(df.schema[c].dataType, (FloatType, DoubleType))]
    return df.withColumns({c: known(df, c) for c in names}) if names else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name
