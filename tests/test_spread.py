"""Narrow rows of a small file are dealt out to all cores, and the heavy work happens after that."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna import Roles
from lacuna import scratch
from lacuna.operators import pairs, utility

ROLES = Roles("id", ("x", "y"), ("c",), (), "c")


def _one_file(spark, n):
    made = spark.range(n).select("id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("c"))
    return scratch.cut(made.coalesce(1), "one-file")


def test_a_small_file_of_many_rows_is_read_by_many_tasks(spark):
    n = 4 * scratch.TASK_ROWS
    table = _one_file(spark, n)
    assert table.rdd.getNumPartitions() == 1
    dealt, seen = scratch.cut_spread(table, "dealt")
    assert seen == n and dealt.rdd.getNumPartitions() >= 4
    assert scratch.spread(table).rdd.getNumPartitions() == 4
    assert dealt.agg(F.sum("id"), F.count_distinct("id")).first()[:] == (n * (n - 1) // 2, n)
    few = _one_file(spark, 100)
    assert scratch.spread(few) is few


def test_forest_is_fitted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 64)
    seen = []
    made = utility.estimators

    def watched(n, seed, **limits):
        found = made(n, seed, **limits)

        class Fit:
            def fit(self, rows):
                seen.append((n, rows.rdd.getNumPartitions()))
                return found["tree"].fit(rows)
        return {**found, "tree": Fit()}

    monkeypatch.setattr(utility, "estimators", watched)
    scores = utility.model_scores(_one_file(spark, 1000), _one_file(spark, 50), ROLES, models=("tree",))
    assert seen[0][0] == 1000 and seen[0][1] > 4 and 0 <= scores.f1["tree"] <= 1


def test_texts_are_made_after_the_sort(spark):
    """Neither the sample for the sort nor the sort itself sees a text."""
    sorted_columns = []
    inner = pairs.with_batch

    def watched(df, *args, **more):
        sorted_columns.append(df.columns)
        return inner(df, *args, **more)

    pairs.with_batch = watched
    try:
        made = pairs.positives(_one_file(spark, 40), ROLES, batch_size=16)
    finally:
        pairs.with_batch = inner
    assert sorted_columns == [["id", "x", "y", "c"]]
    rows = made.orderBy("id").collect()
    assert made.columns == ["batch_id", "id", "anchor", "positive"] and [r["batch_id"] for r in rows] == [i // 16 for i in range(40)]
    assert rows[20]["anchor"] == "x is 7, y is 6, c is 0"
