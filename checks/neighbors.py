"""Distances, per-cell nearest donors and imputation."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from checks.registry import CUSTOMER, LINE_SQL, LINEITEM, PART, check, code_sql, coded, coded_sql, holed_sql, lineitem, long_sql, table
from lacuna import Roles
from lacuna.operators import ampute as A
from lacuna.operators.cells import null_counts
from lacuna.operators.embed import embed_text, hash_vectors, in_metric_space
from lacuna.operators.impute import impute, nearest_donors
from lacuna.operators.neighbors import nearest_rows

K = 5

# ---------------------------------------------------------------- rows

_LONG = "e AS MATERIALIZED (SELECT vec_id AS k, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_CENTER = "c AS MATERIALIZED (SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS x FROM e)"


def _rows_sql(distance: str, source: str = "e") -> str:
    return (f"WITH {_LONG}, {_CENTER}, p AS (SELECT a.k AS q, b.k AS d, round({distance}, 12) AS dist "
            f"FROM {source} a JOIN {source} b ON a.i = b.i AND a.k <> b.k GROUP BY 1, 2) "
            "SELECT q AS row_id, d AS donor_id, round(dist, 6) AS dist, "
            "(row_number() OVER (PARTITION BY q ORDER BY dist, d))::INTEGER AS rank FROM p "
            f"QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, d) <= {K}")


_COSINE = "1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))"


def _rows(spark, folder, metric):
    df, metric = in_metric_space(table(spark, folder, "embeddings"), "embedding", metric)
    found = nearest_rows(df, "vec_id", "embedding", K, metric)
    return found.select("row_id", "donor_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


@check("neighbors_cosine", _rows_sql(_COSINE))
def neighbors_cosine(spark, folder):
    return _rows(spark, folder, "cosine")


@check("neighbors_manhattan", _rows_sql("sum(abs(a.x - b.x))"))
def neighbors_manhattan(spark, folder):
    return _rows(spark, folder, "manhattan")


@check("neighbors_chebyshev", _rows_sql("max(abs(a.x - b.x))"))
def neighbors_chebyshev(spark, folder):
    return _rows(spark, folder, "chebyshev")


@check("neighbors_correlation", _rows_sql(_COSINE, "c"))
def neighbors_correlation(spark, folder):
    return _rows(spark, folder, "correlation")


# the inverse of the covariance by elimination, one row of [matrix | unit] after the other
_INVERSE = ("cv AS MATERIALIZED (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END AS c FROM e a JOIN e b ON a.k = b.k GROUP BY 1, 2), "
            "rw AS (SELECT i, list_concat(list(c ORDER BY j), list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY j)) AS r FROM cv GROUP BY i), "
            "g(k, m) AS (SELECT 0, list(r ORDER BY i) FROM rw UNION ALL SELECT k + 1, list_transform(m, lambda row, n: CASE WHEN n = k + 1 "
            "THEN list_transform(row, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(row, lambda x, c: x - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM g WHERE k < len(m)), "
            "inv AS MATERIALIZED (SELECT list_transform(m, lambda row: row[len(m) + 1:]) AS p FROM g WHERE k = len(m)), "
            "v AS MATERIALIZED (SELECT vec_id AS k, embedding::DOUBLE[] AS x, list_transform(p, lambda row: list_dot_product(row, embedding::DOUBLE[])) AS y FROM embeddings, inv), "
            "n AS MATERIALIZED (SELECT *, list_dot_product(x, y) AS s FROM v), "
            "p AS (SELECT a.k AS q, b.k AS d, round(sqrt(greatest(a.s + b.s - 2 * list_dot_product(a.x, b.y), 0)), 9) AS dist FROM n a JOIN n b ON a.k <> b.k) ")


@check("neighbors_mahalanobis", f"WITH RECURSIVE {_LONG}, {_INVERSE} SELECT q AS row_id, d AS donor_id, round(dist, 6) AS dist, "
       f"(row_number() OVER (PARTITION BY q ORDER BY dist, d))::INTEGER AS rank FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, d) <= {K}")
def neighbors_mahalanobis(spark, folder):
    return _rows(spark, folder, "mahalanobis")


_CONSTANT = ("WITH r AS (SELECT vec_id AS k, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: embedding[1]) ELSE embedding END AS v FROM embeddings), "
             "e AS MATERIALIZED (SELECT k, generate_subscripts(v, 1) AS i, unnest(v)::DOUBLE AS x FROM r), "
             "c AS MATERIALIZED (SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS x FROM e), "
             "flat AS (SELECT k FROM e GROUP BY k HAVING min(x) = max(x)), "
             f"p AS (SELECT a.k AS q, b.k AS d, CASE WHEN a.k IN (FROM flat) OR b.k IN (FROM flat) THEN 1e9 ELSE round({_COSINE}, 12) END AS dist "
             "FROM c a JOIN c b ON a.i = b.i AND a.k <> b.k GROUP BY 1, 2) "
             "SELECT q AS row_id, d AS donor_id, (row_number() OVER (PARTITION BY q ORDER BY dist, d))::INTEGER AS rank FROM p "
             f"QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, d) <= {K}")


@check("neighbors_constant_vectors", _CONSTANT)
def neighbors_constant_vectors(spark, folder):
    flat = F.transform("embedding", lambda x: F.col("embedding")[0])
    df = table(spark, folder, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, flat).otherwise(F.col("embedding")))
    found = nearest_rows(df, "vec_id", "embedding", K, "correlation", n_pivots=12, block_rows=64)
    return found.select("row_id", "donor_id", F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- cells

def _tokens(roles: Roles, source: str) -> str:
    """CTE tok: (k, f, t), the token of every observed cell."""
    parts = []
    for f in roles.features:
        if f in roles.continuous:
            lo, hi = f"(SELECT min({f}) FROM {source})", f"(SELECT max({f}) FROM {source})"
            value = f"least(floor(({f} - {lo})::DOUBLE / ({hi} - {lo}) * 10), 9)::INTEGER"
        else:
            value = f
        parts.append(f"SELECT {roles.key} AS k, '{f}=' || ({value})::VARCHAR AS t FROM {source} WHERE {f} IS NOT NULL")
    return "tok AS (" + " UNION ALL ".join(parts) + ")"


_COSINE_CELLS = ("sum(a.x * c.x)", "sum(x * x)", "CASE WHEN coalesce(p.dot, 0) = 0 THEN 1.0 ELSE round(1 - p.dot / sqrt(a.n * c.n), 12) END")
# |x - y| summed over all entries: the norms, corrected where both vectors have an entry
_MANHATTAN_CELLS = ("sum(abs(a.x - c.x) - abs(a.x) - abs(c.x))", "sum(abs(x))", "coalesce(a.n, 0) + coalesce(c.n, 0) + coalesce(p.dot, 0)")


def cells_ctes(roles: Roles, source: str, setup: str, dim: int = 64, k: int = K, metric=_COSINE_CELLS, order: str = "dist, d", tokens: str | None = None) -> str:
    """CTE top: (k, f, d, v, dist, r), brute force over all pairs of rows."""
    return (f"{setup}, {coded_sql(source, roles)}, {tokens or _tokens(roles, source)}, "
            f"sp AS MATERIALIZED (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b, "
            "sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM tok GROUP BY 1, 2), "
            f"n2 AS MATERIALIZED (SELECT k, {metric[1]} AS n FROM sp GROUP BY 1), "
            f"dots AS MATERIALIZED (SELECT a.k AS q, c.k AS d, {metric[0]} AS dot FROM sp a JOIN sp c ON a.b = c.b AND a.k <> c.k GROUP BY 1, 2), "
            + long_sql("coded", roles, lambda f: f"{f}::DOUBLE", "cells")
            + f", cand AS (SELECT h.k, h.f, o.k AS d, o.v, {metric[2]} AS dist "
            "FROM cells h JOIN cells o ON o.f = h.f AND o.v IS NOT NULL AND h.v IS NULL "
            "LEFT JOIN dots p ON p.q = h.k AND p.d = o.k LEFT JOIN n2 a ON a.k = h.k LEFT JOIN n2 c ON c.k = o.k), "
            f"top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY {order}) AS r FROM cand "
            f"QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY {order}) <= {k})")


def imputed_sql(roles: Roles, source: str, setup: str, types: dict[str, str], dim: int = 64, metric=_COSINE_CELLS, **more) -> str:
    """The imputed table, decoded."""
    columns, joins = [f"s.{roles.key}"], []
    for f in roles.features:
        if f in roles.continuous:
            value = "trunc(avg(v))" if f in roles.integer else "avg(v)"
            joins.append(f"LEFT JOIN (SELECT k, {value} AS v FROM top WHERE f = '{f}' GROUP BY k) f_{f} ON f_{f}.k = s.{roles.key}")
            columns.append(f"round(coalesce(s.{f}::DOUBLE, f_{f}.v), 6) AS {f}")
        else:
            joins.append(f"LEFT JOIN (SELECT k, v FROM (SELECT k, v, count(*) AS n FROM top WHERE f = '{f}' GROUP BY k, v) "
                         f"QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1) f_{f} ON f_{f}.k = s.{roles.key}")
            joins.append(f"LEFT JOIN {code_sql(f, source)} t_{f} ON t_{f}.c = f_{f}.v")
            columns.append(f"coalesce(s.{f}, t_{f}.v)::{types.get(f, 'VARCHAR')} AS {f}")
    return f"{cells_ctes(roles, source, setup, dim, K, metric, **more)} SELECT {', '.join(columns)} FROM {source} s {' '.join(joins)}"


def _rounded(df, roles: Roles):
    return df.select(roles.key, *[(F.round(f, 6) if f in roles.continuous else F.col(f)).alias(f) for f in roles.features])


def _holed(spark, folder, name, roles):
    return A.apply_mask(table(spark, folder, name), A.mcar(roles, 0.3, 0))


_PART = "WITH " + holed_sql("part", PART)


@check("nearest_donors_per_cell", cells_ctes(PART, "holed", _PART)
       + " SELECT k AS p_partkey, f AS feature, r::INTEGER AS rank, d AS donor_id, round(v, 6) AS value, round(dist, 6) AS dist FROM top")
def nearest_donors_per_cell(spark, folder):
    holed = _holed(spark, folder, "part", PART)
    vectors = hash_vectors(holed, PART)
    found = nearest_donors(coded(vectors, PART).join(vectors.select("p_partkey", "vec"), "p_partkey"), PART)
    return found.select("p_partkey", "feature", F.col("rank").cast("int").alias("rank"), "donor_id",
                        F.round("value", 6).alias("value"), F.round("dist", 6).alias("dist"))


@check("impute_part", imputed_sql(PART, "holed", _PART, {}))
def impute_part(spark, folder):
    return _rounded(impute(_holed(spark, folder, "part", PART), PART), PART)


_CUSTOMER = "WITH " + holed_sql("customer", CUSTOMER)


@check("impute_customer", imputed_sql(CUSTOMER, "holed", _CUSTOMER, {"c_nationkey": "INTEGER"}))
def impute_customer(spark, folder):
    return _rounded(impute(_holed(spark, folder, "customer", CUSTOMER), CUSTOMER), CUSTOMER)


# labels exist for some documents only: these holes are real. Rows lie near each other by the words of their texts
LABELLED = Roles("doc_id", ("n_chars",), ("lang", "source", "quality", "toxic"), ("n_chars",), "quality")
_LABELLED = ("WITH joined AS (SELECT d.doc_id, d.text, d.n_chars, d.lang, d.source, l.quality, l.toxic "
             "FROM documents d LEFT JOIN labels l USING (doc_id))")
_WORDS = "tok AS (SELECT doc_id AS k, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS t FROM joined)"


def hashed_words(dim: int = 64):
    """An encoder of whole texts: signed counts of their words, by digest."""
    def make():
        known: dict[str, tuple[int, int]] = {}

        def entry(word):
            h = hashlib.md5(word.encode()).hexdigest()
            return int(h[:8], 16) % dim, 1 if h[8] < "8" else -1

        def encode(texts):
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for word, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", text or "")).items():
                    if word not in known:
                        if len(known) > 1 << 16:
                            known.clear()
                        known[word] = entry(word)
                    at, sign = known[word]
                    out[i, at] += sign * n
            return out

        return encode

    return make


@check("impute_labels", imputed_sql(LABELLED, "joined", _LABELLED, {"quality": "INTEGER", "toxic": "INTEGER"}, tokens=_WORDS))
def impute_labels(spark, folder):
    """Quality and toxicity of unlabelled documents from labelled ones with like texts."""
    vectors = embed_text(table(spark, folder, "documents"), "text", hashed_words(), batch_size=512, limit=None)
    joined = vectors.join(table(spark, folder, "labels"), "doc_id", "left")  # vectors travel, not texts
    return _rounded(impute(joined, LABELLED, vector="vec"), LABELLED)


_NO_DONOR = _PART + ", gone AS (SELECT p_partkey, p_retailprice, NULL::INTEGER AS p_size, p_brand, p_type FROM holed)"


@check("impute_without_donor", _NO_DONOR + " SELECT 0::BIGINT AS p_retailprice, count(*) AS p_size, 0::BIGINT AS p_brand, 0::BIGINT AS p_type FROM gone")
def impute_without_donor(spark, folder):
    holed = _holed(spark, folder, "part", PART).withColumn("p_size", F.lit(None).cast("int"))
    return null_counts(impute(holed, PART), PART.features)


@check("impute_manhattan", imputed_sql(PART, "holed", _PART, {}, metric=_MANHATTAN_CELLS))
def impute_manhattan(spark, folder):
    return _rounded(impute(_holed(spark, folder, "part", PART), PART, metric="manhattan"), PART)


_OTHER_KEY = _PART + ", other AS (SELECT {key} AS p_partkey, p_retailprice, p_size, p_brand, p_type FROM holed)"


def _impute_keyed(spark, folder, key):
    return _rounded(impute(_holed(spark, folder, "part", PART).withColumn("p_partkey", key), PART), PART)


@check("impute_int_key", imputed_sql(PART, "other", _OTHER_KEY.format(key="p_partkey::INTEGER"), {}))
def impute_int_key(spark, folder):
    return _impute_keyed(spark, folder, F.col("p_partkey").cast("int"))


@check("impute_string_key", imputed_sql(PART, "other", _OTHER_KEY.format(key="'part ' || lpad(p_partkey::VARCHAR, 9, '0')"), {}))
def impute_string_key(spark, folder):
    return _impute_keyed(spark, folder, F.concat(F.lit("part "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))


# two rows of each key, and many without one
_PAIRED = "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 'part ' || lpad((p_partkey // 2)::VARCHAR, 9, '0') END"


@check("impute_repeated_string_key", f"SELECT {_PAIRED} AS p_partkey, p_retailprice, p_size, p_brand, p_type FROM ("
       + imputed_sql(PART, "holed", _PART, {}, order="dist, CASE WHEN d % 97 = 0 THEN -1 ELSE d // 2 END, v") + ")")
def impute_repeated_string_key(spark, folder):
    key = F.concat(F.lit("part "), F.lpad(F.expr("p_partkey div 2").cast("string"), 9, "0"))
    return _impute_keyed(spark, folder, F.when(F.col("p_partkey") % 97 != 0, key))


@check("impute_nan", imputed_sql(PART, "holed", _PART, {}))
def impute_nan(spark, folder):
    """Holes of a column of doubles that arrive as NaN."""
    holed = _holed(spark, folder, "part", PART).withColumn("p_retailprice", F.coalesce("p_retailprice", F.lit(float("nan"))))
    return _rounded(impute(holed, PART), PART)


_FEW_TAXES = "CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END"


@check("null_counts_nan", f"WITH {LINE_SQL}, n AS (SELECT * REPLACE ({_FEW_TAXES} AS l_tax) FROM lines) SELECT "
       + ", ".join(f"count(*) - count({f}) AS {f}" for f in LINEITEM.features) + " FROM n")
def null_counts_nan(spark, folder):
    df = lineitem(spark, folder).withColumn("l_tax", F.when(F.col("l_tax") > 0.06, float("nan")).otherwise(F.col("l_tax")))
    return null_counts(df, LINEITEM.features)


LINES_SQL = imputed_sql(LINEITEM, "holed", f"WITH {LINE_SQL}, " + holed_sql("lines", LINEITEM), {})


# the SQL looks at all pairs of rows, so it runs in a test on the smallest table alone
@check("impute_lineitem")
def impute_lineitem(spark, folder):
    holed = A.apply_mask(lineitem(spark, folder), A.mcar(LINEITEM, 0.3, 0))
    return _rounded(impute(holed, LINEITEM), LINEITEM)

