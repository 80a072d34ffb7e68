"""Shards along a Hilbert curve through several metadata dimensions, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.operators.position import with_position
from lacuna.scratch import cut

#: Bits per dimension. 2**8 cells each; with the few dimensions of a table the index fits a bigint.
BITS = 8


def magnitude(value: Column, bits: int = BITS) -> Column:
    """A number's cell: its power of two and the next three binary digits. Null and negative give 0."""
    n = F.greatest(F.coalesce(value.cast("bigint"), F.lit(0)), F.lit(0)) + 1
    power = F.length(F.bin(n)) - 1
    digits = F.call_function("shiftright", F.shiftleft(n, 3), power).bitwiseAND(F.lit(7))
    return F.least(power * 8 + digits, F.lit((1 << bits) - 1)).cast("int")


def with_rank_cell(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """Add the cell of a value among the sorted distinct values; null has the cell of the smallest.

    The distinct values are counted and ranked as a table, so their number may grow with the data.
    """
    values = df.select(F.col(column).alias("__value")).where("__value IS NOT NULL").distinct()
    ranked = with_position(values, "__value", "__rank", "hilbert-values")
    n = ranked.count()
    cells = ranked.select("__value", F.floor(F.col("__rank") * (1 << bits) / max(n, 1 << bits)).cast("int").alias("__cell"))
    joined = df.join(cells, df[column] == cells["__value"], "left")
    return joined.select(*df.columns, F.coalesce("__cell", F.lit(0)).alias(out))


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position along the Hilbert curve of a point given by its cells (Skilling's transform).

    Three passes over (bit, dimension) pairs as array folds: undo the rotations, Gray-code, interleave.
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the index must fit a bigint: fewer dimensions or bits")

    def steps(lowest: int) -> Column:
        pairs = [(1 << b, i) for b in range(bits - 1, lowest - 1, -1) for i in range(n)]
        return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in pairs])

    def unrotate(point: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        x0, xi = point[0], F.get(point, i)
        low = q - 1
        inverted = xi.bitwiseAND(q) != 0
        swap = x0.bitwiseXOR(xi).bitwiseAND(low)
        first = F.when(inverted, x0.bitwiseXOR(low)).otherwise(x0.bitwiseXOR(swap))
        other = F.when(inverted, xi).otherwise(xi.bitwiseXOR(swap))
        return F.transform(point, lambda x, j: F.when(j == 0, first).when(j == i, other).otherwise(x))

    point = F.aggregate(steps(1), F.array(*[c.cast("int") for c in cells]), unrotate)
    seed = F.array_repeat(F.lit(0), 0)
    gray = F.aggregate(point, seed, lambda done, x: F.array_append(
        done, F.when(F.size(done) == 0, x).otherwise(x.bitwiseXOR(F.element_at(F.concat(F.array(F.lit(0)), done), -1)))))
    # each dimension is flipped below every bit that is set in the last one
    lasts = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def flipped(coded: Column) -> Column:
        last = F.element_at(coded, -1)
        t = F.aggregate(lasts, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(coded, lambda x: x.bitwiseXOR(t))

    # one-element arrays name an intermediate result, so that it is computed once
    final = F.flatten(F.transform(F.array(gray), flipped))
    woven = F.transform(F.array(final), lambda p: F.aggregate(
        steps(0), F.lit(0).cast("bigint"),
        lambda h, s: h * 2 + F.when(F.get(p, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0)))
    return F.element_at(woven, 1)


def with_hilbert(df: DataFrame, ranked: list[str], sized: list[str], out: str = "hilbert") -> DataFrame:
    """Add the curve index over ranked (any orderable type) and sized (non-negative numbers) columns."""
    names = [f"__cell{i}" for i in range(len(ranked))]
    table = reduce(lambda t, p: with_rank_cell(t, *p), zip(ranked, names), df)
    cells = [*map(F.col, names), *[magnitude(F.col(s)) for s in sized]]
    return table.withColumn(out, hilbert_index(cells)).drop(*names)


def hilbert_shards(df: DataFrame, shards: int, ranked: list[str], sized: list[str], ties: list[str]) -> DataFrame:
    """All rows and columns of ``df`` with ``hilbert``, ``shard`` (0 to shards - 1) and ``slot`` (from 0).

    Rows are sorted by curve index, then by ``ties``, and cut into runs whose row counts differ by one at
    most. Each run covers a compact region of every dimension, so the smallest and largest values in
    its file exclude most files for a filter on any of them. Nulls share the first cell of their
    dimension; equal rows are interchangeable; an empty table gives no rows; columns of the three
    added names are replaced.
    """
    df = df.drop("hilbert", "shard", "slot")
    table = with_hilbert(df, ranked, sized)
    placed = with_position(table, ["hilbert", *ties], "__pos", "hilbert")
    n = max(placed.count(), 1)
    start = f"(shard * {n} + {shards - 1}) div {shards}"
    return (placed.withColumn("shard", F.expr(f"int(__pos * {shards} div {n})"))
            .withColumn("slot", F.expr(f"__pos - {start}")).drop("__pos"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder and one sorted file per shard. The text is shuffled here once, by shard."""
    shards = sharded.agg(F.max("shard")).first()[0]
    (sharded.repartitionByRange((shards or 0) + 1, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def measured(df: DataFrame, key: str, text: str, *metadata: str) -> DataFrame:
    """Key, metadata, UTF-8 size plus 8 and unsigned CRC of every text: all that ordering needs, read once."""
    return cut(df.select(F.col(key), *metadata, (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
                         F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")), "measured")
