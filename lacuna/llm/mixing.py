"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lacuna.operators.position import with_position
from lacuna.llm.texts import with_place
from lacuna.scratch import cut, cut_counted

#: Stretches of the ordered rows that are summed apart, so that a source or a key with a third of all rows
#: is summed by a third of as many tasks and not by one.
STRETCHES = 4096

#: What orders the rows of a source: the keyed digest, and for rows of one key their size, all they hold, and their place.
ORDER = ("order", "size", "tie", "file", "place")


def source_targets(sizes: DataFrame, weights: list[int], max_epochs: int = 3) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight`` and ``target``.

    Sources in code-point order, null last, take the weights in turn. Their targets share the total of
    all sizes by weight. A target stops at ``max_epochs`` times its source; the excess is shared
    among the others by weight, again and again, until none is above. Every round is one sum over
    the table of sources at a higher water level, so nothing but that level reaches the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    placed = with_position(totals, [F.col("source").asc_nulls_last()], "__pos", "sources")
    turn = F.array(*[F.lit(w) for w in weights])
    table = cut(placed.select("source", "source_size", F.get(turn, (F.col("__pos") % len(weights)).cast("int")).alias("weight")), "weights")
    cap = F.col("source_size") * max_epochs
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        seen = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("caps"),
                         F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if seen["n"] == held or not seen["free"]:
            break
        held, level = seen["n"], (total - (seen["caps"] or 0)) / seen["free"]
    target = F.when(over, cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
    return table.select("source", "source_size", "weight", target.alias("target"))


def seeded_order(df: DataFrame, key: str, seed: int) -> Column:
    """A keyed digest that orders rows at random, alike in every run; rows without key by all they hold."""
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), known))


def source_plan(base: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``whole`` (repetitions of all its rows) and ``limit`` (rows
    whose ORDER is not above it are taken once more; null: none). ``base`` has ``source`` and the columns of ORDER.

    The running total is made in two steps: sums per stretch of the sorted rows, then a window inside each stretch.
    """
    base, seen = cut_counted(base, "mix")
    targets = source_targets(base.select("source", "size"), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0)).cast("int")
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    targets = cut(targets.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") < max_epochs, rest).otherwise(F.lit(-1.0))).drop("weight"), "targets")
    sorted_rows = with_position(base, [F.col("source").asc_nulls_last(), *ORDER], "pos", "orders")
    sorted_rows = sorted_rows.withColumn("stretch", F.floor(F.col("pos") / (seen["n"] // STRETCHES + 1)))
    parts = sorted_rows.groupBy("source", "stretch").agg(F.sum("size").alias("part"))
    before = W.unboundedPreceding, -1
    parts = parts.select(F.col("source").alias("s"), F.col("stretch").alias("p"), F.coalesce(
        F.sum("part").over(W.partitionBy("source").orderBy("stretch").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.sum("size").over(W.partitionBy("source", "stretch").orderBy("pos").rowsBetween(*before))
    middle = F.col("base") + F.col("inside") + F.col("size") / F.lit(2.0)
    placed = (sorted_rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
              .join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("p"))).select("source", *ORDER, middle.alias("middle")))
    rests = targets.select(F.col("source").alias("s"), "rest")
    taken = placed.join(rests, F.col("source").eqNullSafe(F.col("s"))).where("middle <= rest").groupBy("s").agg(F.max(F.struct(*ORDER)).alias("limit"))
    plan = targets.join(taken, F.col("source").eqNullSafe(F.col("s")), "left")
    return cut(plan.select("source", "source_size", "target", "whole", "limit"), "plan")


def mix(df: DataFrame, key: str, size: Column, source: str, weights: list[int], max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """All rows and columns of ``df`` with a struct ``mix``: ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    A source repeats all its rows floor(target / size) times. The rest of its target is filled by rows
    in keyed random order: a row is taken once more if the middle of its stretch of the running total
    lies within the rest, so the source misses its target by half of one row's size at most. In the end
    that is one limit per source, so rows are decided where they lie and no text is shuffled.
    Null sources are one source, the last. Rows of size 0 are repeated by the same rule and count nothing.
    Rows of one key follow each other by size, then by all they hold, and equal ones by their place in the input, so every row
    is decided alone; an empty table gives no rows. A column named ``mix`` is replaced.
    """
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    order = seeded_order(df, key, seed)
    placed = with_place(df, "mix-rows")
    ordered = [order.alias("order"), size.cast("bigint").alias("size"), tie.alias("tie"), F.col("__file").alias("file"), F.col("__place").alias("place")]
    plan = source_plan(placed.select(F.col(source).cast("string").alias("source"), *ordered), weights, max_epochs).select(F.struct("*").alias("__plan"))
    rows = placed.select("*", F.struct(*ordered).alias("__order"), size.cast("bigint").alias("__size")).drop("mix", "__file", "__place")
    joined = rows.join(plan, F.col(source).cast("string").eqNullSafe(F.col("__plan.source")))
    copies = F.col("__plan.whole") + F.when(F.col("__order") <= F.col("__plan.limit"), 1).otherwise(0)
    told = F.struct(F.col("__plan.source").alias("source"), F.col("__size").alias("size"), F.col("__plan.source_size").alias("source_size"),
                    F.col("__plan.target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))
    return joined.withColumn("mix", told).drop("__plan", "__size", "__order")
