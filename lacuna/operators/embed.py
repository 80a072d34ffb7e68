"""Row vectors: the built-in hashing encoder, user encoders in batches, and the projection of a metric."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StructField, StructType

from lacuna.functions.text import MAX_TOKENS, truncate_tokens, value_text
from lacuna.functions.holes import known, q
from lacuna.operators.position import order_statistics
from lacuna.roles import Roles
from lacuna.scratch import cut, cut_counted, drop_table, spread
from lacuna.sources.tables import add_texts, known_texts


def _layout(dim: int):
    """Signed counts per bucket from coded cells, one Arrow batch at a time."""
    @F.arrow_udf("array<float>")
    def layout(codes: pa.Array) -> pa.Array:
        n = len(codes)
        flat = codes.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), len(flat) // max(n, 1))
        kept = flat >= 0
        at, sign = rows[kept] * dim + flat[kept] // 2, flat[kept] % 2 * 2.0 - 1.0
        dense = np.bincount(at, weights=sign, minlength=n * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(dense))

    return layout


@dataclass(frozen=True)
class HashEncoder:
    """Signed feature hashing of the observed cells of a row.

    A cell becomes the token ``name=value``, numbers by their bin; the digest of the token gives a
    bucket and a sign. Holes add nothing, so a vector has integer entries and a row without any
    observed cell is the zero vector.
    """

    dim: int = 64
    bins: int = 10
    binning: str = "width"

    def fit(self, df: DataFrame, roles: Roles) -> dict[str, list[float]]:
        """Inner bin edges of every continuous column. Width: one aggregate; quantile: a few passes."""
        if self.binning not in ("width", "quantile"):
            raise ValueError("binning is width or quantile")
        names = roles.continuous
        if not names:
            return {}
        stats = df.agg(*[g(known(df, f)).alias(f"{i}{tag}") for i, f in enumerate(names)
                         for tag, g in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first().asDict()
        seen = [(f, stats[f"{i}n"], stats[f"{i}lo"], stats[f"{i}hi"]) for i, f in enumerate(names) if stats[f"{i}n"]]
        if self.binning == "width":
            return {f: [float(lo), float(hi)] for f, _, lo, hi in seen}
        return order_statistics(df, {
            f: (known(df, f), [max(1, n * b // self.bins) for b in range(1, self.bins)]) for f, n, *_ in seen})

    def bin_of(self, value: Column, edges: list[float]) -> Column:
        x = value.cast("double")
        if self.binning == "quantile":
            above = [F.when(x > F.lit(e), 1).otherwise(0) for e in edges]
            return sum(above[1:], above[0]).cast("int")
        lo, hi = edges
        if lo == hi:
            return F.lit(0)
        return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * self.bins), F.lit(self.bins - 1)).cast("int")

    def place(self, token: str) -> tuple[int, float]:
        """Bucket and sign of a token known to the driver."""
        h = hashlib.md5(token.encode()).hexdigest()
        return int(h[:8], 16) % self.dim, 1.0 if h[8] < "8" else -1.0

    def add(self, df: DataFrame, roles: Roles, edges: dict, out: str) -> DataFrame:
        """``df`` with the vector column.

        A cell becomes one whole number, 2 * bucket + (sign is +), or -1 in a hole. The tokens of a
        number are its bins, so these are literals of the plan; a category is hashed once per row.
        The dense vectors are then laid out from whole Arrow batches.
        """
        codes, hashed = [], {}
        for i, f in enumerate(roles.features):
            if f not in roles.continuous:
                hashed[f"__h{i}"] = F.md5(F.concat(F.lit(f + "="), value_text(df, f)))
                h = F.col(f"__h{i}")
                bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % self.dim).cast("int")
                codes.append(bucket * 2 + F.when(F.substring(h, 9, 1) < "8", 1).otherwise(0))
            elif f in edges:
                places = F.array(*[F.lit(2 * b + (x > 0)) for b, x in (self.place(f"{f}={n}") for n in range(self.bins))])
                codes.append(F.when(known(df, f).isNotNull(), F.element_at(places, self.bin_of(q(f), edges[f]) + 1)))
        columns = [q(c) for c in df.columns if c != out]
        coded = F.array(*[F.coalesce(c, F.lit(-1)) for c in codes]) if codes else F.array(F.lit(-1))
        return df.withColumns(hashed).select(*columns, _layout(self.dim)(coded).alias(out))

    def settings(self) -> dict:
        return {"encoder": "hash", "dim": self.dim, "bins": self.bins, "binning": self.binning}


#: Texts that are worth a task.
TASK_TEXTS = 1 << 10


def _numbered(rows: DataFrame, number: str, chosen: DataFrame) -> DataFrame:
    """The rows whose number is among the ``chosen``. Only one bit for every row is sent to all tasks, and no row is moved."""
    bits = chosen.groupBy(F.bitmap_bucket_number(number).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__bits"))
    held = rows.withColumns({"__bucket": F.bitmap_bucket_number(number), "__bit": F.bitmap_bit_position(number)}).join(F.broadcast(bits), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    taken = held.withColumn("__byte", byte).where("shiftright(__byte, cast(__bit % 8 as int)) % 2 = 1")
    return taken.drop("__bucket", "__bits", "__bit", "__byte")


def hash_vectors(df: DataFrame, roles: Roles, encoder: HashEncoder = HashEncoder(), out: str = "vec") -> DataFrame:
    """The table with one vector per row."""
    return encoder.add(df, roles, encoder.fit(df, roles), out)


def embed_text(df: DataFrame, text: str, make_encoder, batch_size: int = 16, out: str = "vec",
               distinct: bool = True, limit: int | None = MAX_TOKENS, kept: str | None = None) -> DataFrame:
    """Vectors of a text column from a user's encoder, in mini-batches; the text column itself is left out.

    ``make_encoder()`` runs once per Python worker and returns a function of an array of texts that
    gives an (n, D) matrix. It sees the first ``limit`` tokens (None: whole texts). With ``distinct`` every text is
    encoded once: digests and row numbers choose one row per text, only chosen texts are encoded, where they lie, and
    vectors are joined to rows without their texts, which are then deleted. ``kept`` names a folder that holds the vectors of one encoder by the digest of
    the text it sees: only texts that are not in it are encoded, and then added, whatever run they come from.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    shown = F.col(text) if limit is None else truncate_tokens(F.col(text), limit)
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    if kept is not None:
        digest = F.unhex(F.sha2(F.col("__text").cast("binary"), 256))
        rows = cut(df.withColumn("__text", shown).drop(text).withColumns({"__id": digest, "__row": F.monotonically_increasing_id()}), "texts")
        new = rows.select("__id").where("__id IS NOT NULL").distinct().join(known_texts(df.sparkSession, kept), F.col("__id") == F.col("digest"), "left_anti")
        chosen = rows.join(new, "__id", "left_semi").groupBy("__id").agg(F.min("__row").alias("__row")).select("__row")
        once = rows.select("__row", "__id", "__text").join(chosen, "__row", "left_semi")
        add_texts(once.select(F.col("__id").alias("digest"), encode(F.col("__text")).alias("vec")), kept)
        known = known_texts(df.sparkSession, kept).select(F.col("digest").alias("__id"), F.col("vec").alias(out))
        return rows.drop("__text", "__row").join(known, "__id", "left").drop("__id")
    if not distinct:
        return df.withColumn(out, encode(shown)).drop(text)
    numbered = df.withColumn("__text", shown).drop(text).withColumns({"__id": F.md5("__text"), "__row": F.monotonically_increasing_id()})
    rows, seen = cut_counted(numbered, "texts", lean=True)
    chosen = rows.where("__id IS NOT NULL").groupBy("__id").agg(F.min("__row").alias("__row")).select("__row")
    texts = spread(rows.select("__row", "__id", "__text"), seen["n"], TASK_TEXTS)
    once = _numbered(texts, "__row", chosen).select("__id", encode(F.col("__text")).alias(out))
    found = cut(rows.drop("__text", "__row").join(once, "__id", "left").drop("__id"), "vectors", lean=True)
    drop_table(rows)
    return found


#: Token places, padding included, that an encoder sees at once, and rows whose texts are sorted by length together.
TOKEN_BUDGET, LENGTH_WINDOW = 1 << 14, 4096


def batches_by_length(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Row numbers in batches of like lengths: rows times longest length stays within ``budget``; a longer text is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    found, start = [], 0
    for i in range(1, len(order) + 1):
        # the next text would be the longest of the batch
        if i == len(order) or (i - start + 1) * max(1, int(lengths[order[i]])) > budget:
            found.append(order[start:i])
            start = i
    return found


def embed_tokens(df: DataFrame, text: str, make_tokenizer, make_model, limit: int | None = MAX_TOKENS, budget: int = TOKEN_BUDGET,
                 window: int = LENGTH_WINDOW, pad: int = 0, out: str = "vec") -> DataFrame:
    """Vectors of a text column from a user's tokenizer and encoder; the text column itself is left out.

    ``make_tokenizer()`` and ``make_model()`` run once per task. The tokenizer gives a list of token ids for each text of a list, of
    which the first ``limit`` are kept (None: all). The model gets a matrix of ids, filled up with ``pad``, and a matrix that is 1 where
    a token is, and returns a vector per row. Texts of ``window`` rows are put into batches of like length, each of at most ``budget`` places, so
    little is padding. A null or empty text has no tokens.
    """
    kept = [c for c in df.columns if c not in (text, out)]
    schema = StructType([*(df.schema[c] for c in kept), StructField(out, ArrayType(FloatType()))])

    def run(batches):
        tokenize, model, types = make_tokenizer(), make_model(), to_arrow_schema(schema)

        def encoded(rows: pa.Table) -> pa.Table:
            ids = [np.asarray(t[:limit], np.int64) for t in tokenize([t or "" for t in rows.column(len(kept)).to_pylist()])]
            lengths, vectors = np.array([len(t) for t in ids]), [None] * len(ids)
            for part in batches_by_length(lengths, budget):
                places = np.full((len(part), max(1, lengths[part].max())), pad, np.int64)
                mask = np.zeros(places.shape, np.int64)
                for r, i in enumerate(part):
                    places[r, : lengths[i]], mask[r, : lengths[i]] = ids[i], 1
                for i, vector in zip(part, np.asarray(model(places, mask), np.float32)):
                    vectors[i] = vector
            columns = [rows.column(c) for c in range(len(kept))]
            return pa.Table.from_arrays([*columns, pa.array(vectors, types.field(out).type)], schema=types)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, window):
                held.append(batch.slice(at, window))
                size += held[-1].num_rows
                if size >= window:
                    yield from encoded(pa.Table.from_batches(held)).to_batches()
                    held, size = [], 0
        if size:
            yield from encoded(pa.Table.from_batches(held)).to_batches()

    return df.select(*map(q, kept), q(text).cast("string").alias("__text")).mapInArrow(run, schema)


def hashed_fields(dim: int = 64):
    """A text encoder without weights: signed counts of the fields of a row's text, hashed into ``dim`` entries."""
    def make():
        def encode(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").split(", "):  # fields
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            return out
        return encode

    return make


MAX_COVARIANCE_DIM = 4096


GRAM = StructType([StructField("n", LongType()), StructField("mean", BinaryType()), StructField("scatter", BinaryType())])


def _merge_grams(parts):
    """(rows, mean, sum of outer products around it) of several such triples, without cancellation."""
    n, mean, scatter = 0, None, None
    for m, other, s in parts:
        if not m:
            continue
        if not n:
            n, mean, scatter = m, other.copy(), s.copy()
            continue
        gap = other - mean
        scatter += s + np.outer(gap, gap) * (n * m / (n + m))
        mean += gap * (m / (n + m))
        n += m
    return n, mean, scatter


def _gram_row(n, mean, scatter, types):
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([n], [mean.tobytes()], [scatter.tobytes()]), types)], schema=types)


#: Tasks that merge the matrices of all others before one merges theirs.
MERGERS = 16


def covariance(df: DataFrame, vector: str) -> np.ndarray:
    """Sample covariance of a vector column: one pass, every task adds up its rows around their mean, tasks' matrices are merged
    in two levels, and one D x D matrix comes to the driver. At least two rows are needed."""
    types = to_arrow_schema(GRAM)

    def add_up(batches):
        def grams():
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    if x.shape[1] > MAX_COVARIANCE_DIM:
                        raise ValueError(f"vectors of length {x.shape[1]}: a covariance matrix is limited to {MAX_COVARIANCE_DIM}")
                    mean = x.mean(axis=0)
                    yield len(x), mean, (x - mean).T @ (x - mean)

        n, mean, scatter = _merge_grams(grams())
        if n:
            yield _gram_row(n, mean, scatter, types)

    def merge(batches):
        def grams():
            for batch in batches:
                for n, mean, scatter in zip(*(c.to_pylist() for c in batch.columns)):
                    mean = np.frombuffer(mean)
                    yield n, mean, np.frombuffer(scatter).reshape(len(mean), -1)

        n, mean, scatter = _merge_grams(grams())
        if n:
            yield _gram_row(n, mean, scatter, types)

    parts = df.select(q(vector)).mapInArrow(add_up, GRAM).repartition(MERGERS).mapInArrow(merge, GRAM).coalesce(1).mapInArrow(merge, GRAM)
    got = parts.first()
    if got is None or got["n"] < 2:
        raise ValueError("a covariance needs two rows")
    dim = len(got["mean"]) // 8
    return np.frombuffer(got["scatter"]).reshape(dim, dim) / (got["n"] - 1)


def whitening(cov: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """L with L L' = (cov + ridge I)^-1: Euclidean distance after x L is the Mahalanobis distance."""
    return np.linalg.cholesky(np.linalg.inv(cov + ridge * np.eye(len(cov))))


def project(df: DataFrame, vector: str, matrix: np.ndarray) -> DataFrame:
    """Replace each vector x by x times ``matrix``, whole Arrow batches at a time."""
    @F.arrow_udf("array<double>")
    def times(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(matrix)))
        y = x @ matrix
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * matrix.shape[1], pa.int32()), pa.array(y.ravel()))

    return df.withColumn(vector, times(q(vector)))


def in_metric_space(df: DataFrame, vector: str, metric: str) -> tuple[DataFrame, str]:
    """Vectors and the distance to use on them. Mahalanobis becomes Euclidean after whitening."""
    if metric != "mahalanobis":
        return df, metric
    return project(df, vector, whitening(covariance(df, vector))), "euclidean"
