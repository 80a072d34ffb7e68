"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.scratch import cut

#: Candidate vectors of one shard. A task holds the postings of one shard at a time.
SHARD_ROWS = 8192

#: Terms whose postings are traversed between two looks at who is still competitive.
STEP = 4


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``key`` and floor(scale * x) of every component; vectors that are null or hold null, NaN or infinity, and rows without key, are left out."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(key).cast("bigint").alias("key"), F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("bigint")).alias("vector"))
            .distinct())


class Postings:
    """The vectors of one shard as a list of (row, weight) per term, with the score bounds of each term.

    A term is a dimension; its list holds the rows whose component is not 0. A list of more than half
    of the rows is kept as the whole column, where the other rows hold 0.
    """

    def __init__(self, keys: np.ndarray, matrix: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.matrix = keys[order], matrix[order]
        columns = np.ascontiguousarray(self.matrix.T)
        found = [np.flatnonzero(c) for c in columns]
        self.rows = [slice(None) if 2 * len(r) > len(keys) else r for r in found]
        self.weights = [c[r] for c, r in zip(columns, self.rows)]
        self.repeats = len(keys) - len(np.unique(keys))
        # a row outside the list contributes 0
        self.most = np.maximum(columns.max(axis=1, initial=0), 0)
        self.least = np.minimum(columns.min(axis=1, initial=0), 0)

    def search(self, key: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of this shard (more if keys repeat): largest score, then smallest key."""
        n, k = len(self.keys), k + self.repeats
        if n == 0:
            return self.keys, np.empty(0, np.int64)
        query = query[: self.matrix.shape[1]]
        width = len(query)
        bound = np.maximum(query * self.most[:width], query * self.least[:width])
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what terms from here on can add at most
        own = slice(*np.searchsorted(self.keys, [key, key + 1]))
        # any k rows give a first threshold: those that lead the term with the highest bound
        first = self._leaders(terms[0] if width else 0, query, 4 * k + own.stop - own.start)
        first = first[(first < own.start) | (first >= own.stop)]
        scores = self.matrix[first][:, :width] @ query
        threshold = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None
        # rows without any essential term cannot reach the threshold
        essential = width if threshold is None else int(np.searchsorted(-rest, -threshold, side="right"))
        essential = min(essential, width)
        partial, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        for t in terms[:essential]:
            partial[self.rows[t]] += query[t] * self.weights[t]
            seen[self.rows[t]] = True
        if threshold is None or rest[essential] >= threshold:
            seen[:] = True
        seen[own] = False
        alive = np.flatnonzero(seen)
        at = essential
        while True:
            if threshold is not None:
                alive = alive[partial[alive] + rest[at] >= threshold]
            if at == width:
                break
            # the other terms are probed while a row is competitive
            probe = terms[at : at + STEP]
            partial[alive] += self.matrix[np.ix_(alive, probe)] @ query[probe]
            at += len(probe)
        score = partial[alive]
        best = np.lexsort((self.keys[alive], -score))[:k]
        return self.keys[alive[best]], score[best]

    def _leaders(self, term: int, query: np.ndarray, count: int) -> np.ndarray:
        if not len(query):
            return np.arange(min(count, len(self.keys)))
        rows, gain = np.arange(len(self.keys))[self.rows[term]], self.weights[term] * query[term]
        if len(rows) <= count:
            return np.arange(min(count, len(self.keys)))
        return rows[np.argpartition(-gain, count)[:count]]


def top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of the k best other rows for each query row.

    ``vectors`` has ``key`` and ``vector`` (integers); ``queries`` marks the query rows. Candidates are dealt by
    hash into shards of about SHARD_ROWS rows; every query visits every shard, where MaxScore
    splits its terms by score bounds, and a window merges the k best of each shard. Ties go to the
    smaller key. Fewer than k candidates are all returned; vectors of unequal length are
    multiplied over their common part; a key never meets itself; an empty table gives no rows.
    """
    table = cut(vectors, "vectors")
    shards = max(1, -(-table.count() // SHARD_ROWS))
    # a key and its repeats share a shard, whatever their number of vectors
    rows = table.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "key", "vector")
    asked = (table.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "key", "vector"))
    dealt = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    out = StructType.fromDDL("query_id bigint, vec_id bigint, score bigint")

    def run(batches):
        types = to_arrow_schema(out)
        shard, keys, vectors, postings = None, [], [], None
        for batch in batches:
            result = ([], [], [])
            flat = batch.column(3)
            values, offsets = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            where, kind, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(batch.num_rows):
                vector = values[offsets[i] : offsets[i + 1]]
                if where[i] != shard:
                    shard, keys, vectors, postings = where[i], [], [], None
                if kind[i] == 0:
                    keys.append(key[i])
                    vectors.append(np.array(vector))
                    continue
                if postings is None:
                    width = max((len(v) for v in vectors), default=0)
                    matrix = np.zeros((len(vectors), width), np.int64)
                    for r, v in enumerate(vectors):
                        matrix[r, : len(v)] = v
                    postings, vectors = Postings(np.array(keys, np.int64), matrix), []
                ids, scores = postings.search(int(key[i]), vector, k)
                result[0].append(np.full(len(ids), key[i]))
                result[1].append(ids)
                result[2].append(scores)
            if result[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r), pa.int64()) for r in result], schema=types)

    best = dealt.mapInArrow(run, out)
    # a query key with several vectors, or a candidate key with several, counts with its best score
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
