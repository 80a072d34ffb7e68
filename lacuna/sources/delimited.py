"""Delimited text: with or without header, any separator, names and types given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def schema_of(columns: dict[str, str]) -> T.StructType:
    """A schema from name -> type name; names may hold spaces, dots and commas."""
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t), True) for n, t in columns.items()])


def read_delimited(spark: SparkSession, path: str, columns: dict[str, str], *, header: bool = False,
                   separator: str = ",", rename: dict[str, str] | None = None,
                   replace_header: bool = False) -> DataFrame:
    """Read with a declared schema, so no pass over the file infers one; malformed rows are errors.

    With a header, its names must be the declared ones in the same order; ``rename`` changes them afterwards.
    ``replace_header`` skips it unread, for files whose own names are to be replaced by position.
    """
    df = (spark.read.schema(schema_of(columns)).option("header", header).option("sep", separator)
          .option("enforceSchema", replace_header or not header).option("mode", "FAILFAST").csv(path))
    return df.withColumnsRenamed(rename) if rename else df
