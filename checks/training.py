"""Embedding, pooling, pair scoring and the learned metric."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from checks.registry import PART, check, table
from lacuna.functions import vectors as V
from lacuna.functions.randomness import normal_weights
from lacuna.operators import ampute as A
from lacuna.operators import learn, pairs
from lacuna.operators.embed import covariance, embed_text, embed_tokens, project, whitening
from lacuna.scratch import cut, spread

LETTERS = "aeio"


def letter_counter():
    """A stand-in for a user's encoder: how often each of a few letters occurs."""
    import numpy as np

    def encode(texts):
        return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)

    return encode


@check("embed_documents", "SELECT doc_id, " + ", ".join(
    f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS n_{c}" for c in LETTERS) + " FROM documents")
def embed_documents(spark, folder):
    made = embed_text(table(spark, folder, "documents").select("doc_id", "text"), "text", letter_counter, limit=None)
    return made.select("doc_id", *[F.element_at("vec", i + 1).cast("double").alias(f"n_{c}") for i, c in enumerate(LETTERS)])


# eight token vectors of eight entries are cut from every embedding
def _token_vectors():
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))


_ENTRIES = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@check("pool_first_token", f"WITH {_ENTRIES} SELECT vec_id, p::INTEGER AS i, round(x, 6) AS x FROM e WHERE p < 8")
def pool_first_token(spark, folder):
    pooled = table(spark, folder, "embeddings").select("vec_id", F.posexplode(V.first_token(_token_vectors())).alias("i", "x"))
    return pooled.select("vec_id", F.col("i").cast("int").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@check("pool_mean_tokens", f"WITH {_ENTRIES} SELECT vec_id, (p % 8)::INTEGER AS i, round(avg(x), 6) AS x FROM e GROUP BY 1, 2")
def pool_mean_tokens(spark, folder):
    pooled = table(spark, folder, "embeddings").select("vec_id", F.posexplode(V.mean_tokens(_token_vectors())).alias("i", "x"))
    return pooled.select("vec_id", F.col("i").cast("int").alias("i"), F.round("x", 6).alias("x"))


@check("pool_mean_without_padding", f"WITH {_ENTRIES} SELECT vec_id, (p % 8)::INTEGER AS i, round(avg(x), 6) AS x FROM e WHERE p < 40 GROUP BY 1, 2")
def pool_mean_without_padding(spark, folder):
    attention = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < 5).cast("int"))
    pooled = table(spark, folder, "embeddings").select(
        "vec_id", F.posexplode(V.mean_tokens(_token_vectors(), attention)).alias("i", "x"))
    return pooled.select("vec_id", F.col("i").cast("int").alias("i"), F.round("x", 6).alias("x"))


@check("narrow_vectors", "SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS i, round((unnest(embedding)::DOUBLE * 3)::FLOAT::DOUBLE, 6) AS x FROM embeddings")
def narrow_vectors(spark, folder):
    wide = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(V.narrow(wide)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("int").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


WEIGHTS = normal_weights(2, 64, 1)
BIAS = (0.25, -0.5)


def _ratio(hx, hu):
    return V.density_ratio_logit(hx, hu, WEIGHTS[0], BIAS[0], WEIGHTS[1], BIAS[1])


def _triples(spark, folder):
    """Each vector with the next two by id; the label names the epoch."""
    e = table(spark, folder, "embeddings")

    def ahead(n, name):
        return e.select((F.col("vec_id") - n).alias("vec_id"), F.col("embedding").alias(name))

    base = e.select("vec_id", (F.col("label") % 2).alias("epoch"), F.floor(F.col("vec_id") / 16).alias("batch_id"),
                    F.col("embedding").alias("h_x"))
    return base.join(ahead(1, "h_pos"), "vec_id").join(ahead(2, "h_neg"), "vec_id")


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _logit(x: str, u: str) -> str:
    return f"{_dot(x, u)} + {_dot(x, str(WEIGHTS[0]))} + {BIAS[0]} + {_dot(u, str(WEIGHTS[1]))} + ({BIAS[1]})"


TRIPLES = ("WITH t AS (SELECT a.vec_id, (a.label % 2)::INTEGER AS epoch, a.vec_id // 16 AS batch_id, a.embedding AS x, p.embedding AS u, n.embedding AS w "
           "FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2)")
LOGITS = (f"{TRIPLES}, z AS (SELECT epoch, batch_id, 1.0::DOUBLE AS y, {_logit('x', 'u')} AS z FROM t UNION ALL "
          f"SELECT epoch, batch_id, 0.0, {_logit('x', 'w')} FROM t), "
          "l AS (SELECT epoch, batch_id, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS loss FROM z GROUP BY 1, 2)")


@check("density_ratio", f"{TRIPLES} SELECT vec_id, round({_logit('x', 'u')}, 6) AS logit FROM t")
def density_ratio(spark, folder):
    return _triples(spark, folder).select("vec_id", F.round(_ratio(F.col("h_x"), F.col("h_pos")), 6).alias("logit"))


@check("batch_losses", f"{LOGITS} SELECT epoch, batch_id, round(loss, 6) AS bce_loss FROM l")
def batch_losses(spark, folder):
    losses = learn.batch_losses(learn.pair_logits(_triples(spark, folder), _ratio))
    return losses.select("epoch", "batch_id", F.round("bce_loss", 6).alias("bce_loss"))


@check("epoch_losses", f"{LOGITS} SELECT epoch, round(avg(loss), 6) AS bce_loss FROM l GROUP BY 1")
def epoch_losses(spark, folder):
    losses = learn.epoch_losses(learn.batch_losses(learn.pair_logits(_triples(spark, folder), _ratio)))
    return losses.select("epoch", F.round("bce_loss", 6).alias("bce_loss"))


# two gradient steps of one epoch: even batches, then odd ones
_START = "list_transform(range(0, 193), lambda i: CASE WHEN i < 64 THEN 1.0::DOUBLE ELSE 0.0 END)"


def _step_sql(n: int, before: str) -> str:
    return (f"s{n} AS MATERIALIZED (SELECT share, y, f, list_dot_product(f, {before}) AS z FROM p WHERE batch_id % 2 = {n}), "
            f"b{n} AS (SELECT sum(share) AS many, sum(share * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) AS loss FROM s{n}), "
            f"g{n} AS (SELECT i, sum(share * (1 / (1 + exp(-z)) - y) * x) / (SELECT many FROM b{n}) AS g FROM "
            f"(SELECT share, y, z, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM s{n}) GROUP BY i), "
            f"w{n} AS MATERIALIZED (SELECT list({before}[i] - 0.1 * g ORDER BY i) AS w FROM g{n})")


_EPOCH = (f"{TRIPLES}, h AS (SELECT batch_id, 0.5 / count(*) OVER (PARTITION BY batch_id) AS share, x::DOUBLE[] AS x, u::DOUBLE[] AS u, w::DOUBLE[] AS w FROM t), "
          "p AS MATERIALIZED (SELECT batch_id, share, y, list_concat(list_transform(list_zip(x, v), lambda e: e[1] * e[2]), x, v, [1.0::DOUBLE]) AS f "
          "FROM (SELECT batch_id, share, 1.0::DOUBLE AS y, x, u AS v FROM h UNION ALL SELECT batch_id, share, 0.0, x, w FROM h)), "
          f"{_step_sql(0, _START)}, {_step_sql(1, '(SELECT w FROM w0)')} "
          "SELECT 'loss' AS name, 0 AS i, round((b0.loss + b1.loss) / (b0.many + b1.many), 6) AS value FROM b0, b1 "
          "UNION ALL SELECT 'weight', generate_subscripts(w, 1)::INTEGER - 1, round(unnest(w), 6) FROM w1")


@check("epoch_tuning", _EPOCH)
def epoch_tuning(spark, folder):
    metric, losses = learn.tune_metric(spark, lambda epoch: _triples(spark, folder), 64, epochs=1, steps=2)
    weights = [*metric.weights, *metric.a, *metric.b, metric.bias]
    rows = [("loss", 0, round(losses.first()["bce_loss"], 6))] + [("weight", i, round(float(w), 6)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "name string, i int, value double")


def _pair_vectors(spark, folder):
    """Triples of texts of the holed parts, as vectors of the bag of their fields."""
    holed = A.apply_mask(spread(table(spark, folder, "part")), A.mcar(PART, 0.3, 0))
    made = pairs.contrastive_pairs(holed, PART)
    dim = 16

    def bag(text):
        kept = F.filter(F.split(text, ", "), lambda x: ~x.endswith("[MASK]"))
        at = F.transform(kept, lambda x: (F.pmod(F.xxhash64(x), F.lit(dim))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda b: b == i)).cast("double"))

    return cut(made.select(bag(F.col("anchor")).alias("h_x"), bag(F.col("positive")).alias("h_pos"),
                           bag(F.col("negative")).alias("h_neg")), "pair-vectors")


@check("learned_metric")
def learned_metric(spark, folder):
    rows = _pair_vectors(spark, folder)
    model = learn.learn_metric(rows)
    return model.scale(rows, "h_x").select(F.posexplode("h_x").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"))


@check("covariance", "WITH e AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) "
       "SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def covariance_matrix(spark, folder):
    got = covariance(table(spark, folder, "embeddings"), "embedding")
    rows = [(i, j, round(float(v), 6)) for i, r in enumerate(got) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, cov double")


# the rows in the new space have the unit matrix as covariance, but for the ridge
@check("covariance_whitening", "WITH d AS (SELECT unnest(range(0, max(len(embedding)))) AS i FROM embeddings) "
       "SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS cov FROM d a, d b")
def covariance_whitening(spark, folder):
    """Vectors are projected row by row, and Spark takes the covariance of what comes out."""
    df = table(spark, folder, "embeddings")
    new = project(df, "embedding", whitening(covariance(df, "embedding"), ridge=0.0))
    pairs = new.select("embedding", F.posexplode("embedding").alias("i", "x")).select("i", "x", F.posexplode("embedding").alias("j", "y"))
    found = pairs.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))
    return found.select("i", "j", (F.round("cov", 6) + F.lit(0.0)).alias("cov"))


# a stand-in for an encoder's tokenizer: pieces of four letters; and for the encoder: shares of its token ids
LIMIT, KINDS = 128, 8


def pieces():
    def tokenize(texts):
        cut_up = ([p for w in re.findall(r"[^\x20\x09-\x0D]+", t) for p in re.findall(".{1,4}", w, re.DOTALL)] for t in texts)
        return [[int(hashlib.md5(p.encode()).hexdigest()[:7], 16) % 1000 for p in found[:LIMIT]] for found in cut_up]

    return tokenize


def shares():
    def encode(ids, mask):
        counts = np.stack([((ids % KINDS == i) * mask).sum(axis=1) for i in range(KINDS)], axis=1)
        return counts / np.maximum(mask.sum(axis=1, keepdims=True), 1)

    return encode


@check("embed_tokens", "WITH t AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: regexp_extract_all(w, '.{1,4}', 0, 's')))"
       f"[1:{LIMIT}] AS p FROM documents), k AS (SELECT doc_id, list_transform(p, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT % 1000 % {KINDS}) AS k FROM t) "
       f"SELECT doc_id, i::INTEGER AS i, round(coalesce(len(list_filter(k, lambda x: x = i)) / len(k), 0), 6) AS share FROM k, range(0, {KINDS}) r(i)")
def embed_tokens_query(spark, folder):
    """Whole texts are cut by the tokenizer's own tokens."""
    found = embed_tokens(table(spark, folder, "documents").select("doc_id", "text"), "text", pieces, shares, limit=LIMIT)
    return found.select("doc_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("share"))

