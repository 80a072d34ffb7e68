"""Sinks and the caches of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.scratch import canonical, path_exists


def write_embeddings(df: DataFrame, key: str, vector: str, path: str) -> None:
    """key and vector as a parquet table."""
    df.select(key, vector).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cache_path(folder: str, settings: dict) -> str:
    """One place per combination of all the settings that shape the vectors."""
    return f"{folder.rstrip('/')}/embeddings-{hashlib.md5(canonical(settings).encode()).hexdigest()}"


def cached_embeddings(spark: SparkSession, folder: str, settings: dict, key: str, vector: str,
                      compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the vectors of these settings if they were written to the end, else compute and write them."""
    path = cache_path(folder, settings)
    if not path_exists(spark, path):
        write_embeddings(compute(), key, vector, path)
    return read_embeddings(spark, path)


def known_texts(spark: SparkSession, path: str) -> DataFrame:
    """digest, vec of the texts whose vectors are kept at ``path``. A text written twice, after a run that broke off, counts once."""
    empty = spark.createDataFrame([], "digest binary, vec array<float>")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return empty
    return spark.read.schema(empty.schema).parquet(path).dropDuplicates(["digest"])


def add_texts(vectors: DataFrame, path: str) -> None:
    """Append digest, vec of texts that were not known. Every file holds whole rows, so what a broken run left behind is of use."""
    vectors.select("digest", "vec").write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Named results, one row."""
    metrics.write.mode("overwrite").format(fmt).save(path)
