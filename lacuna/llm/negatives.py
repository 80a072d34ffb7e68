"""Hard negatives by exact integer products, several candidates to a number.

Kronecker packing: the components of several candidates, made non-negative by a bias, stand in separate fields of one wide
integer. One product with an anchor's component serves all of them, and the sum over components holds each candidate's
product in its own field, since a field is as wide as the largest possible sum. Unpacking masks the fields
and takes the bias off again. Numbers up to 2^53 are held as doubles, which are exact there, so a block of
anchors is one matrix product; products that need wider fields are held as Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.operators.tiles import closest
from lacuna.scratch import cut, cut_counted

#: Bits that a double holds exactly.
EXACT_BITS = 53

#: Candidates that a task holds, packed. Anchors stream past them.
SHARD_ROWS = 1 << 15

#: Candidates of the smallest shard that is worth a task of its own.
LEAST_ROWS = 1 << 10

#: Scores that are looked at together.
TILE = 1 << 20

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def labelled_vectors(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """``key``, ``label``, ``vector``: floor(scale * x) of every component. Rows without key, label or vector and vectors
    that hold null, NaN or infinity are left out; equal rows count once."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (df.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(key).cast("bigint").alias("key"), label.cast("bigint").alias("label"),
                    F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("bigint")).alias("vector"))
            .distinct())


class Packed:
    """Candidates in packed numbers. ``products`` gives the exact inner products of a block of anchors with all of them."""

    def __init__(self, matrix: np.ndarray):
        self.n, self.width = matrix.shape
        self.least = matrix.min(axis=0, initial=0)
        # one number holds ``fields`` candidates; the width of a field depends on the anchors, so packing waits for them
        self.most = [int(m) - int(l) for m, l in zip(matrix.max(axis=0, initial=0), self.least)]
        self.matrix, self.bits, self.packed, self.biased = matrix, 0, None, None

    def _pack(self, bits: int) -> None:
        """Fields of at least ``bits`` bits."""
        fields = EXACT_BITS // bits
        if fields:
            bits, kind = EXACT_BITS // fields, np.float64
        else:
            bits, fields, kind = 2 * bits, 8, object
        rows = -(-self.n // fields)
        biased = np.zeros((rows * fields, self.width), np.int64 if kind is np.float64 else object)
        biased[: self.n] = self.matrix.astype(biased.dtype) - self.least.astype(biased.dtype)
        parts = biased.reshape(fields, rows, self.width)  # candidate i has field i // rows of number i % rows
        wide = parts[0]
        for f in range(1, fields):
            wide = wide + (parts[f] << (f * bits) if kind is np.float64 else parts[f] * (1 << (f * bits)))
        self.biased = biased[: self.n].astype(np.float64) if kind is np.float64 else None
        self.packed, self.bits, self.fields, self.rows, self.kind = np.ascontiguousarray(wide.astype(kind).T), bits, fields, rows, kind

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, one row per anchor; of 64 bits, or an error if one needs more."""
        shift = anchors.min(axis=0, initial=0)
        up = anchors.astype(object) - shift.astype(object)
        largest = int((up @ np.array(self.most, object)).max(initial=0)) if self.width else 0
        if self.packed is None or largest >> self.bits:
            self._pack(max(1, largest.bit_length()))
        sums = up.astype(self.kind) @ self.packed
        if self.kind is np.float64:
            sums = sums.astype(np.int64)
        mask, out = (1 << self.bits) - 1, np.empty((len(anchors), self.fields * self.rows), sums.dtype)
        for f in range(self.fields):
            out[:, f * self.rows : (f + 1) * self.rows] = (sums >> (f * self.bits)) & mask
        out = out[:, : self.n]
        # a.c = (a - s).(c - l) + a.l + s.(c - l)
        low, s = self.least.astype(object), shift.astype(object)
        offset = anchors.astype(object) @ low if self.width else np.zeros(len(anchors), object)
        rest = sum(abs(int(x)) * m for x, m in zip(shift, self.most))
        if self.kind is np.float64 and rest + max(map(abs, offset), default=0) < 1 << EXACT_BITS:
            return out + offset.astype(np.int64)[:, None] + (self.biased @ shift.astype(np.float64)).astype(np.int64)[None, :]
        out = out.astype(object) + offset[:, None] + ((self.matrix.astype(object) - low) @ s)[None, :]
        return out.astype(np.int64)  # an OverflowError names products beyond 64 bits


class Shard:
    """Candidates of one task by label and key, so that rows of one label are neighbours and ties go to the smaller key."""

    def __init__(self, keys, labels, vectors):
        keys, labels = np.array(keys, np.int64), np.array(labels, np.int64)
        order = np.lexsort((keys, labels))
        self.keys, self.labels = keys[order], labels[order]
        self.width = max((len(v) for v in vectors), default=0)
        matrix = np.zeros((len(keys), self.width), np.int64)
        for i, at in enumerate(order):
            matrix[i, : len(vectors[at])] = vectors[at]
        self.packed = Packed(matrix)
        self.by_key = np.argsort(self.keys, kind="stable")

    def scores(self, vectors) -> np.ndarray:
        anchors = np.zeros((len(vectors), self.width), np.int64)
        for i, v in enumerate(vectors):
            anchors[i, : min(len(v), self.width)] = v[: self.width]
        return self.packed.products(anchors)

    def same_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _best(scores: np.ndarray, keys: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of every row, ``keys`` ascending; a few more where scores tie."""
    # negated scores as distances; what is not allowed is farthest
    d = np.where(allowed, -scores.astype(np.float64), np.inf)
    if len(scores) and np.abs(scores).max(initial=0) >= 1 << EXACT_BITS:  # doubles would make ties of their own
        rows, columns = [], []
        for i in range(len(scores)):
            at = np.flatnonzero(allowed[i])
            at = at[np.lexsort((keys[at], -(scores[i, at].astype(object))))][:k]
            rows.append(np.full(len(at), i))
            columns.append(at)
        return np.concatenate(rows), np.concatenate(columns)
    i, j = closest(d, keys, k)
    held = allowed[i, j]
    return i[held], j[held]


def _bounds(positive: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores s with least * positive <= 100 * s <= most * positive."""
    return -((-least * positive) // 100), (most * positive) // 100


ANCHOR = "anchor bigint, row bigint, label bigint, vector array<bigint>, positives array<struct<key:bigint,score:bigint>>"


def _visit(find, out: StructType):
    """Runs over tasks' rows: a shard's candidates first, then its anchors in tiles."""

    def run(batches):
        types, number, shard, held, waiting = to_arrow_schema(out), None, None, ([], [], []), []

        def tiles():
            for i in range(0, len(waiting), step := max(1, TILE // max(1, len(shard.keys)))):
                found = find(shard, waiting[i : i + step])
                if found is not None and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, types)], schema=types)
            waiting.clear()

        for batch in batches:
            vectors = batch.column(5)
            values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            where, kind, key, row, label = (batch.column(i).to_pylist() for i in range(5))
            positives = batch.column(6).to_pylist()
            for i in range(batch.num_rows):
                vector = np.array(values[offsets[i] : offsets[i + 1]], np.int64)
                if where[i] != number:
                    if waiting:
                        yield from tiles()
                    number, shard, held = where[i], None, ([], [], [])
                if kind[i] == 0:
                    for part, value in zip(held, (key[i], label[i], vector)):
                        part.append(value)
                else:
                    if shard is None:
                        shard, held = Shard(*held), ([], [], [])
                    waiting.append((key[i], row[i], label[i], vector, positives[i]))
                    if len(waiting) >= 1024:
                        yield from tiles()
        if waiting:
            yield from tiles()

    return run


def _find_positives(k: int):
    def find(shard: Shard, anchors):
        scores, parts = shard.scores([a[3] for a in anchors]), []
        for label in sorted({a[2] for a in anchors}):
            mine, own = np.array([i for i, a in enumerate(anchors) if a[2] == label]), shard.same_label(label)
            keys = shard.keys[own]
            allowed = keys[None, :] != np.array([anchors[i][0] for i in mine])[:, None]
            i, j = _best(scores[mine][:, own], keys, allowed, k)
            parts += [(anchors[a][1], int(keys[c]), int(scores[a, own.start + c])) for a, c in zip(mine[i].tolist(), j.tolist())]
        return list(zip(*parts)) if parts else None

    return find


def _find_negatives(k: int, least: int, most: int):
    def find(shard: Shard, anchors):
        scores, parts = shard.scores([a[3] for a in anchors])[:, shard.by_key], []
        keys, labels = shard.keys[shard.by_key], shard.labels[shard.by_key]
        # a row of the tile for each anchor and positive score
        asked = [(i, s) for i, a in enumerate(anchors) for s in dict.fromkeys(p["score"] for p in a[4])]
        for at in range(0, len(asked), len(anchors)):
            some = asked[at : at + len(anchors)]
            rows = np.array([i for i, _ in some])
            low, high = np.array([[min(max(b, LOWEST), HIGHEST) for b in _bounds(p, least, most)] for _, p in some], np.int64).T
            s = scores[rows]
            label = np.array([anchors[i][2] for i in rows])
            allowed = (s >= low[:, None]) & (s <= high[:, None]) & (labels[None, :] != label[:, None]) & (keys[None, :] != np.array([anchors[i][0] for i in rows])[:, None])
            i, j = _best(s, keys, allowed, k)
            parts += [(anchors[rows[x]][1], some[x][1], int(keys[c]), int(s[x, c])) for x, c in zip(i.tolist(), j.tolist())]
        return list(zip(*parts)) if parts else None

    return find


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has ``key``, ``label`` and ``vector`` (integers) as ``labelled_vectors`` makes them; ``anchors`` marks the
    anchor rows. Positives of an anchor are its best ``positives`` other rows of its label by inner product; its hard negatives for
    a positive are the best ``negatives`` rows of other labels whose score is ``least`` to ``most`` percent of the positive's. Ties
    go to the smaller key. Fewer are all returned; a positive of negative score has none. Rows of one key never
    meet; a key with several different rows is an anchor, or a candidate, with each of them. Vectors of unequal length are multiplied over
    their common part. An empty table gives no rows; other columns are not read.

    Candidates lie in shards that a task can hold; anchors, each with one row in a shard, visit all of them, first for positives and
    then, with these, for negatives. What a shard returns is bounded by its anchors, and a window merges it.
    """
    if min(positives, negatives) < 1:
        raise ValueError("positives and negatives must be at least 1")
    table, seen = cut_counted(vectors, "vectors")
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-seen["n"] // SHARD_ROWS), min(2 * cores, seen["n"] // LEAST_ROWS))
    identity = F.xxhash64("key", "label", "vector")
    none = F.lit(None).cast("array<struct<key:bigint,score:bigint>>")
    rows = table.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "key", F.lit(0).cast("bigint").alias("row"),
                        "label", "vector", none.alias("positives"))
    asked = table.where(anchors).select("key", identity.alias("row"), "label", "vector")

    def visit(queries: DataFrame, find, schema: str) -> DataFrame:
        out = StructType.fromDDL(schema)
        each = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1)).select(*rows.columns)
        return rows.unionByName(each).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_visit(find, out), out)

    found = visit(asked.withColumn("positives", none), _find_positives(positives), "row bigint, key bigint, score bigint")
    order = W.partitionBy("row").orderBy(F.desc("score"), "key")
    best = cut(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives), "positives")
    lists = best.groupBy("row").agg(F.collect_list(F.struct("key", "score")).alias("positives"))  # of the stated number
    scored = visit(asked.join(lists, "row"), _find_negatives(negatives, least, most), "row bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = W.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    kept = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    # positives of equal score have the same negatives
    named = best.select("row", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    return (kept.join(named, ["row", "positive_score"]).join(asked.select("row", F.col("key").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
