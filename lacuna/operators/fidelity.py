"""How close an imputed table is to the truth: cell errors and distribution distance."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.functions.holes import known, nan_as_null, q
from lacuna.roles import Roles
from lacuna.scratch import small_table

# Fixed values of the error and frequency definitions
SMAPE_EPSILON = 1e-6
COUNT_EPSILON = 1e-8
EMPTY_BIN = 1e-11
MAX_BINS = 10
FEW_VALUES = 5


def _hidden(truth: DataFrame, imputed: DataFrame, mask: DataFrame, roles: Roles) -> DataFrame:
    """Truth (t_), fill (i_) and mask (m_) of every row of the mask; a key that is missing elsewhere leaves NULLs."""
    def side(df, tag, numbers):
        return df.select(roles.key, *[(known(df, f).cast("double") if numbers else q(f)).alias(f"{tag}_{f}") for f in roles.features])

    return side(mask, "m", False).join(side(truth, "t", True), roles.key, "left").join(side(imputed, "i", True), roles.key, "left")


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def unfilled_cells(imputed: DataFrame, mask: DataFrame, roles: Roles) -> DataFrame:
    """One row: number of hidden cells without a fill, per feature. A key without a row counts in each hidden cell."""
    joined = _hidden(imputed, imputed, mask, roles)
    return joined.agg(*[F.count_if(q(f"m_{f}") & q(f"i_{f}").isNull()).alias(f) for f in roles.features])


def cell_errors(truth: DataFrame, imputed: DataFrame, mask: DataFrame, roles: Roles) -> DataFrame:
    """One row: smape over hidden numbers, error rate over hidden categories, and their sum.

    Three tables of one row per key are joined on it; every measure comes from one pass. A hidden cell without
    truth or fill cannot be scored: its measure, and the sum, are NULL.
    """
    joined = _hidden(truth, imputed, mask, roles)

    def hidden(f):
        return F.coalesce(q(f"m_{f}"), F.lit(False))

    def gap(f):
        o, x = q(f"t_{f}"), q(f"i_{f}")
        return F.when(hidden(f), F.abs(o - x) / (F.abs(o) + F.abs(x) + F.lit(SMAPE_EPSILON))).otherwise(0.0)

    def measures(features, error):
        lost = [F.when(hidden(f) & (q(f"t_{f}").isNull() | q(f"i_{f}").isNull()), 1).otherwise(0) for f in features]
        return F.sum(_sum(map(error, features))), F.sum(_sum(F.when(hidden(f), 1).otherwise(0) for f in features)), F.sum(_sum(lost))

    number = measures(roles.continuous, gap)
    kind = measures(roles.categorical, lambda f: F.when(hidden(f) & ~q(f"t_{f}").eqNullSafe(q(f"i_{f}")), 1).otherwise(0))
    sums = joined.agg(*[c.alias(n) for c, n in zip([*number, *kind], ("g", "n", "lost_n", "w", "c", "lost_c"))])

    def ratio(a, b, lost):
        return F.when((F.col(b) > 0) & (F.col(lost) == 0), F.col(a) / F.col(b))

    return sums.select(ratio("g", "n", "lost_n").alias("smape"), ratio("w", "c", "lost_c").alias("error")).withColumn(
        "asmape", F.col("smape") + F.col("error"))


def value_range(truth: DataFrame, features) -> DataFrame:
    """feature, lo, hi, distinct (exact below MAX_BINS, otherwise at least MAX_BINS).

    Distinct values are estimated in the pass that finds the ranges. Only a feature whose estimate is
    small is counted exactly, so the values of a dense column are never shuffled.
    """
    names = list(features)
    spark, truth = truth.sparkSession, nan_as_null(truth, features)
    stats = truth.agg(*[g(q(f)).alias(f"{i}{tag}") for i, f in enumerate(names)
                        for tag, g in (("lo", F.min), ("hi", F.max), ("d", F.approx_count_distinct))]).first().asDict()
    few = [f for i, f in enumerate(names) if stats[f"{i}d"] <= 4 * MAX_BINS]
    exact = truth.agg(*[F.count_distinct(q(f)).alias(f) for f in few]).first().asDict() if few else {}
    return small_table(
        spark, feature=(names, pa.string()),
        lo=([None if stats[f"{i}lo"] is None else float(stats[f"{i}lo"]) for i in range(len(names))], pa.float64()),
        hi=([None if stats[f"{i}hi"] is None else float(stats[f"{i}hi"]) for i in range(len(names))], pa.float64()),
        n_distinct=([int(exact.get(f, MAX_BINS)) for f in names], pa.int32()))


@dataclass(frozen=True)
class Bins:
    """How the values of a feature are counted: in equal-width bins, the last one closed and values outside left out, or one by one."""

    feature: str
    lo: float = 0.0
    hi: float = 0.0
    bins: int = 0  # 0: value by value


def bins_of(ranges: DataFrame) -> list[Bins]:
    """Bins of the truth's ranges; features of few values are counted by value."""
    return [Bins(r["feature"], r["lo"], r["hi"], min(MAX_BINS, r["n_distinct"]) if r["n_distinct"] >= FEW_VALUES else 0) for r in ranges.collect()]  # one per feature


#: Different values that a task adds up before it passes their counts on.
VALUES_HELD = 1 << 16


def tallied(df: DataFrame, plan: list[Bins]) -> DataFrame:
    """feature (its number in ``plan``), bin, n: counts of all features, in one scan.

    A task adds up a vector of counts per histogram, and a table of counts for features counted by value.
    """
    out = StructType.fromDDL("feature int, bin double, n bigint")
    wide = df.select(*[known(df, b.feature).cast("double").alias(f"x{i}") for i, b in enumerate(plan)])

    def run(batches):
        types, sums = to_arrow_schema(out), [np.zeros(b.bins, np.int64) if b.bins else Counter() for b in plan]

        def passed_on(i):
            held = sums[i]
            values, counts = (np.flatnonzero(held), held[np.flatnonzero(held)]) if plan[i].bins else (list(held), list(held.values()))
            if not plan[i].bins:
                sums[i] = Counter()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values, pa.float64()), pa.array(counts, pa.int64())], schema=types)

        for batch in batches:
            for i, b in enumerate(plan):
                x = batch.column(i).drop_null().to_numpy()
                if b.bins:
                    x = x[(x >= b.lo) & (x <= b.hi)]
                    at = np.minimum(np.floor((x - b.lo) / (b.hi - b.lo) * b.bins), b.bins - 1).astype(np.int64)
                    sums[i] += np.bincount(at, minlength=b.bins)
                else:
                    values, counts = np.unique(x + 0.0, return_counts=True)
                    sums[i].update(dict(zip(values.tolist(), counts.tolist())))
                    if len(sums[i]) > VALUES_HELD:
                        yield passed_on(i)
        for i in range(len(plan)):
            yield passed_on(i)

    return wide.mapInArrow(run, out).groupBy("feature", "bin").agg(F.sum("n").alias("n"))


def _both(truth: DataFrame, imputed: DataFrame, plan: list[Bins]) -> DataFrame:
    """feature, bin, few, np (truth), nq (imputed), tp, tq (their sums over the feature). Every bin of a histogram exists, also when empty."""
    spark = truth.sparkSession
    zero, bins = F.lit(0).cast("bigint"), [(i, float(x)) for i, b in enumerate(plan) for x in range(b.bins)]
    grid = small_table(spark, feature=([i for i, _ in bins], pa.int32()), bin=([x for _, x in bins], pa.float64()))  # MAX_BINS per feature at most
    sides = [tallied(truth, plan).select("feature", "bin", F.col("n").alias("np"), zero.alias("nq")),
             tallied(imputed, plan).select("feature", "bin", zero.alias("np"), F.col("n").alias("nq")),
             grid.select("feature", "bin", zero.alias("np"), zero.alias("nq"))]
    counts = reduce(DataFrame.unionByName, sides).groupBy("feature", "bin").agg(F.sum("np").alias("np"), F.sum("nq").alias("nq"))
    whole = W.partitionBy("feature")  # at most MAX_BINS bins, or the values of a feature
    names = F.array(*[F.lit(b.feature) for b in plan])
    few = F.element_at(F.array(*[F.lit(b.bins == 0) for b in plan]), F.col("feature") + 1)
    return counts.select(F.element_at(names, F.col("feature") + 1).alias("feature"), "bin", few.alias("few"), "np", "nq",
                         F.sum("np").over(whole).alias("tp"), F.sum("nq").over(whole).alias("tq"))


def _share(n: str, t: str, smooth: bool = True) -> Column:
    count = F.col(n).cast("double")
    value = F.when(F.col(t) == 0, F.lit(0.0)).when(F.col("few"), count / F.col(t)).otherwise(count / (F.col(t) + F.lit(COUNT_EPSILON)))
    return F.when(value == 0, F.lit(EMPTY_BIN)).otherwise(value) if smooth else value


def frequencies(truth: DataFrame, imputed: DataFrame, features, smooth: bool = True) -> DataFrame:
    """feature, bin, p (truth), q (imputed), bins taken from the truth.

    Counted values are shares of the rows; histogram bins are shares of the counted values. An empty
    bin of either side counts as EMPTY_BIN when ``smooth``.
    """
    rows = _both(truth, imputed, bins_of(value_range(truth, features)))
    return rows.select("feature", "bin", _share("np", "tp", smooth).alias("p"), _share("nq", "tq", smooth).alias("q"))


def _entropies(truth: DataFrame, imputed: DataFrame, continuous, categorical) -> DataFrame:
    """feature, kl: for numbers the relative entropy of imputed to truth, both scaled to sum to one; for categories that over the
    values both tables have, not scaled, so it may be negative. One scan of each table counts all features."""
    plan = (bins_of(value_range(truth, continuous)) if continuous else []) + [Bins(f) for f in categorical]
    whole = W.partitionBy("feature")
    number = F.col("feature").isin(*continuous) if continuous else F.lit(False)
    rows = _both(truth, imputed, plan).select("*", _share("np", "tp").alias("p"), _share("nq", "tq").alias("q"))
    p, q_ = F.col("p") / F.sum("p").over(whole), F.col("q") / F.sum("q").over(whole)
    scaled = rows.select("*", (q_ * F.log(q_ / p)).alias("term"))
    a, b = F.col("np") / F.col("tp"), F.col("nq") / F.col("tq")
    term = F.when(number, F.col("term")).when((F.col("np") > 0) & (F.col("nq") > 0), b * F.log(b / a))
    found = scaled.groupBy("feature").agg(F.sum(term).alias("kl"))
    names = small_table(truth.sparkSession, feature=([b.feature for b in plan], pa.string()))
    return names.join(found, "feature", "left").select("feature", F.coalesce("kl", F.lit(0.0)).alias("kl"))


def kl_continuous(truth: DataFrame, imputed: DataFrame, features) -> DataFrame:
    """feature, kl: relative entropy of imputed to truth over the truth's bins."""
    return _entropies(truth, imputed, list(features), [])


def kl_categorical(truth: DataFrame, imputed: DataFrame, features) -> DataFrame:
    """feature, kl over the values both tables have; 0 where they have none in common."""
    return _entropies(truth, imputed, [], list(features))


def kl_by_feature(truth: DataFrame, imputed: DataFrame, roles: Roles) -> DataFrame:
    return _entropies(truth, imputed, list(roles.continuous), list(roles.categorical))


def kl_mean(truth: DataFrame, imputed: DataFrame, roles: Roles) -> DataFrame:
    """One row: mean over the columns."""
    return kl_by_feature(truth, imputed, roles).agg(F.avg("kl").alias("kl"))
