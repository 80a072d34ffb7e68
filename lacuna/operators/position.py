"""Dense row positions without a global window, and what follows from them: ranks and batches."""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.functions.holes import q, unused
from lacuna.scratch import cut, new_path, small_table


def with_position(df: DataFrame, order_by, out: str = "pos", label: str = "ordered") -> DataFrame:
    """Add the 0-based rank of each row under ``order_by``.

    The table is range-sorted and written once. A position is the row's index in its file plus
    the rows in the files before it. Only one count per file reaches the driver.
    """
    spark = df.sparkSession
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    path = new_path(spark, label)
    df.orderBy(*order).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return _number(table, out)


def _natural(path: str):
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", path) if p]


def _number(table: DataFrame, out: str) -> DataFrame:
    file = F.col("_metadata.file_path")
    name, row, start = (unused(table, c) for c in ("__file", "__row", "__start"))
    tagged = table.select("*", file.alias(name), F.col("_metadata.row_index").alias(row))
    counts = table.select(file.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted(((r["file"], r["n"]) for r in counts), key=lambda s: _natural(s[0]))
    starts = [0, *accumulate(n for _, n in sizes)]
    # one row per written file, so as many as there were write tasks
    offsets = small_table(table.sparkSession, **{name: ([f for f, _ in sizes], pa.string()), start: (starts[:-1], pa.int64())})
    numbered = tagged.join(offsets, name)
    return numbered.select(*[q(c) for c in table.columns if c != out], (F.col(start) + F.col(row)).alias(out))


def with_batch(df: DataFrame, order_by, size: int, out: str = "batch_id") -> DataFrame:
    """Fixed consecutive mini-batches of ``size`` rows in key order."""
    position = unused(df, "__pos")
    placed = with_position(df, order_by, position, "batches")
    return placed.withColumn(out, F.floor(F.col(position) / size).cast("bigint")).drop(position)


def running_total(placed: DataFrame, position: str, amount: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Sum of ``amount`` over all smaller positions: windows over chunks of ``width`` rows, over chunks of chunks, then
    one number per ``width`` squared rows on the driver."""
    chunked = placed.withColumn("__chunk", F.floor(F.col(position) / width))
    before = W.unboundedPreceding, -1
    totals = chunked.groupBy("__chunk").agg(F.sum(amount).alias("__sum")).withColumn("__outer", F.floor(F.col("__chunk") / width))
    outer = sorted((r["__outer"], r["n"]) for r in totals.groupBy("__outer").agg(F.coalesce(F.sum("__sum"), F.lit(0)).alias("n")).collect())
    starts = [0, *accumulate(n for _, n in outer)]
    zero = F.lit(0)
    base = zero
    for (number, _), start in zip(outer[1:], starts[1:]):
        base = F.when(F.col("__outer") == number, F.lit(start)).otherwise(base)
    inner = F.coalesce(F.sum("__sum").over(W.partitionBy("__outer").orderBy("__chunk").rowsBetween(*before)), zero)
    totals = totals.select("__chunk", (inner + base).alias("__base"))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("__chunk").orderBy(position).rowsBetween(*before)), zero)
    return chunked.join(totals, "__chunk").withColumn(out, inside + F.col("__base")).drop("__chunk", "__base")


def value_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """value + its average rank, one row per distinct value; NULL has no rank."""
    return _ranks(df.where(q(value).isNotNull()).groupBy(q(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), value, out)


def _ranks(counts: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` and its rank, from ``v`` and how often it occurs, ``n``."""
    placed = with_position(counts, "v", "pos", "ranks")
    start = running_total(placed, "pos", "n", "before")
    return start.select(F.col("v").alias(value), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))


def average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Add the rank of ``value`` from 1, equal values sharing the mean of their ranks; a NULL value has rank NULL.

    Equal values are counted before the sort, so a value held by many rows is one row of it.
    """
    return df.join(value_ranks(df, value, out), value, "left")


def spearman(df: DataFrame, x: str, y: str, out: str = "spearman") -> DataFrame:
    """Rank correlation of the rows that have both values; one row.

    Rows are counted by pair of values first. Ranks are joined to the counted pairs, so a value held by
    many rows is no hot key.
    """
    pairs = cut(df.select(q(x).alias("x"), q(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
                .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    ranked = pairs
    for c in ("x", "y"):
        counts = pairs.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("n"))
        ranked = ranked.join(_ranks(counts, c, f"r{c}"), c)
    middle = (pairs.agg(F.sum("n")).first()[0] or 0) / 2 + 0.5  # the mean of all ranks
    dx, dy, n = F.col("rx") - F.lit(middle), F.col("ry") - F.lit(middle), F.col("n")
    spread = F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))
    return ranked.agg(F.when(spread > 0, F.sum(n * dx * dy) / spread).alias(out))


#: Bits of a key that one pass counts.
DIGIT = 18


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit numbers of the same order; zeros are equal, NaN is largest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def from_sort_key(key: int) -> float:
    bits = np.array([key ^ (1 << 63)], np.uint64).view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _keys(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return sort_keys(batch.column(i).drop_null().to_numpy())


def _begin(keys: np.ndarray, prefix: int, depth: int) -> np.ndarray:
    return keys[(keys >> np.uint64(64 - depth)) == np.uint64(prefix)] if depth else keys


def _count_digits(wide: DataFrame, wanted: dict[tuple[int, int, int], list[int]]) -> dict:
    """For (column, known bits, their number): per order k the digit that follows, the values before it, those that have it, and all.

    One scan for all columns and orders. A task adds up counts in arrays of fixed size; the counts of one prefix are summed and
    searched in one place, and one row for each order comes back.
    """
    counted = StructType.fromDDL("i int, prefix bigint, depth int, digits binary, counts binary")
    found = StructType.fromDDL("i int, prefix bigint, depth int, k bigint, digit bigint, below bigint, same bigint, n bigint")

    def count(batches):
        types, sums = to_arrow_schema(counted), {}
        for batch in batches:
            for i in {i for i, _, _ in wanted}:
                keys = _keys(batch, i)
                for at in (w for w in wanted if w[0] == i):
                    width = min(DIGIT, 64 - at[2])
                    part = _begin(keys, at[1], at[2])
                    digits = (part >> np.uint64(64 - at[2] - width)) & np.uint64((1 << width) - 1)
                    sums[at] = sums.get(at, 0) + np.bincount(digits.astype(np.int64), minlength=1 << width)
        for (i, prefix, depth), total in sums.items():
            some = np.flatnonzero(total)
            row = [i], [prefix], [depth], [some.astype(np.int32).tobytes()], [total[some].astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, types)], schema=types)

    def search(batches):
        types, sums = to_arrow_schema(found), {}
        for batch in batches:
            for i, prefix, depth, digits, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault((i, prefix, depth), np.zeros(1 << min(DIGIT, 64 - depth), np.int64))
                total[np.frombuffer(digits, np.int32)] += np.frombuffer(counts, np.int64)
        rows = []
        for at, total in sums.items():
            upto = np.cumsum(total)
            for k in wanted[at]:
                digit = int(np.searchsorted(upto, k)) if k <= upto[-1] else -1
                rows.append((*at, k, digit, int(upto[digit] - total[digit]), int(total[digit]), int(upto[-1])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    rows = wide.mapInArrow(count, counted).repartition("i", "prefix", "depth").mapInArrow(search, found).collect()
    return {(r["i"], r["prefix"], r["depth"], r["k"]): r for r in rows}


def order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, list[int]]], few: int = 4096) -> dict[str, list[float]]:
    """The k-th smallest values (k from 1) of each column, exactly, for a list of k per column. NaN is largest.

    Radix selection: a scan counts the leading bits of the values' sort keys, for all columns and orders together; the next one
    the bits that follow among the values that begin like the one sought. Where at most ``few`` such values are left, a last
    scan collects them. There are never more than five scans, whatever the values and their number.
    """
    names = list(wanted)
    wide = df.select(*[wanted[m][0].cast("double").alias(f"x{i}") for i, m in enumerate(names)])
    found: dict = {}
    # prefix, its bits, k among the values with it, their number
    open_ = {(i, j): (0, 0, k, None) for i, m in enumerate(names) for j, k in enumerate(wanted[m][1])}
    for (i, _), (_, _, k, _) in open_.items():
        if k < 1:
            raise ValueError(f"{names[i]}: order {k} is below 1")
    left: dict = {}
    while open_:
        asked: dict = {}
        for (i, _), (prefix, depth, k, _) in open_.items():
            asked.setdefault((i, prefix, depth), []).append(k)
        got = _count_digits(wide, asked)
        for at, (prefix, depth, k, _) in list(open_.items()):
            r = got.get((at[0], prefix, depth, k))
            if r is None or r["digit"] < 0:
                raise ValueError(f"{names[at[0]]}: order {k} outside 1..{r['n'] if r else 0}")
            width = min(DIGIT, 64 - depth)
            state = (prefix << width) | r["digit"], depth + width, k - r["below"], r["same"]
            if state[1] == 64:
                found[at] = from_sort_key(state[0])
                del open_[at]
            elif r["same"] <= few:
                left[at] = state
                del open_[at]
            else:
                open_[at] = state
    if left:
        parts = sorted({(i, prefix, depth) for (i, _), (prefix, depth, _, _) in left.items()})
        out = StructType.fromDDL("part int, value double")

        def pick(batches):
            types = to_arrow_schema(out)
            for batch in batches:
                for c, (i, prefix, depth) in enumerate(parts):
                    values = batch.column(i).drop_null().to_numpy()
                    values = values[(sort_keys(values) >> np.uint64(64 - depth)) == np.uint64(prefix)]
                    if len(values):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c, np.int32)), pa.array(values)], schema=types)

        values = wide.mapInArrow(pick, out).toPandas()  # ``few`` for each at most
        lists = [np.sort(values["value"].to_numpy()[values["part"].to_numpy() == c]) for c in range(len(parts))]
        for (i, j), (prefix, depth, k, _) in left.items():
            found[i, j] = float(lists[parts.index((i, prefix, depth))][k - 1] + 0.0)
    return {m: [found[i, j] for j in range(len(wanted[m][1]))] for i, m in enumerate(names)}
