"""Tables written between stages, in the folder all executors share.

A written table cuts lineage and survives the loss of any executor.
"""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lacuna-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application alone writes to."""
    return f"{shared_folder(spark)}/lacuna/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables this application wrote between stages. DataFrames built on them end here."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Shuffle files are deleted when a query ends, not when the driver happens to collect its garbage, and what goes to a Python
#: worker at once is bounded in bytes.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_lock, _open = threading.Lock(), []


@contextmanager
def lean_writes(spark: SparkSession):
    """Writes inside run with ``LEAN``. The settings before the first of several threads are put back after the last."""
    with _lock:
        _open.append(_open[0] if _open else {k: spark.conf.get(k, None) for k in LEAN})
        for k, v in LEAN.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            before = _open.pop()
            for k, v in before.items() if not _open else ():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """Write ``df`` once and go on from the written table. ``lean``: see ``LEAN``."""
    return cut_parts([df], label, lean)


def cut_parts(parts: list[DataFrame], label: str, lean: bool = False) -> DataFrame:
    """Tables of one schema, written one after the other, as one table."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = new_path(spark, label)
    paths = [path] if len(parts) == 1 else [f"{path}/{i}" for i in range(len(parts))]
    for df, place in zip(parts, paths):
        with lean_writes(spark) if lean else nullcontext():
            df.write.parquet(place)
    return spark.read.schema(schema).parquet(*paths)


def cut_counted(df: DataFrame, label: str, *metrics, lean: bool = False) -> tuple[DataFrame, dict]:
    """As ``cut``; also the row count ``n`` and further aggregates, observed during the write."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *metrics), label, lean)
    return table, seen.get


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows that are worth a task of their own.
TASK_ROWS = 1 << 14


def spread(table: DataFrame, n: int | None = None, task_rows: int | None = None) -> DataFrame:
    """A table that is read from files, dealt out to all cores.

    Spark cuts files by their bytes, so millions of narrow rows may be one task. A small table, or one that is read by as many
    tasks as there are cores, stays as it is. ``n`` is its row count, where that is known; ``task_rows`` are worth a task.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    wanted = min(2 * cores, (table.count() if n is None else n) // (task_rows or TASK_ROWS))
    return table if wanted < 2 or table.rdd.getNumPartitions() >= min(wanted, cores) else table.repartition(wanted)


def cut_spread(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``cut``, with the row count; where one task would read many rows, the table is dealt out and written again."""
    table, seen = cut_counted(df, label)
    dealt = spread(table, seen["n"])
    return (table if dealt is table else cut(dealt, label)), seen["n"]


def small_table(spark: SparkSession, **columns) -> DataFrame:
    """A few rows known to the driver as a local relation: name = (values, arrow type)."""
    return spark.createDataFrame(pa.table({n: pa.array(list(v), t) for n, (v, t) in columns.items()}))


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished table lies at ``path``."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def canonical(settings: dict) -> str:
    return json.dumps(settings, sort_keys=True, default=str)
