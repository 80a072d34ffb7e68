"""Row texts, parsing, and contrastive triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import PART, check, holed_sql, long_sql, table, text_sql, u_sql
from checks.tables import CDF_SQL
from lacuna.functions import text as T
from lacuna.operators import ampute as A
from lacuna.operators import pairs as P
from lacuna.scratch import spread

HOLED = "WITH " + holed_sql("part", PART)


def _holed(spark, folder):
    return A.apply_mask(spread(table(spark, folder, "part")), A.mcar(PART, 0.3, 0))


def _cell(f: str) -> str:
    return f"coalesce({text_sql(f, f in PART.continuous)}, '[MASK]')"


CELLS = HOLED + ", " + long_sql("holed", PART, _cell, "cells") + ", n AS (SELECT *, " \
    "CASE f WHEN 'p_retailprice' THEN 1 WHEN 'p_size' THEN 2 WHEN 'p_brand' THEN 3 ELSE 4 END AS i FROM cells)"

SENTENCE = "replace(f, ',', '') || ' is ' || replace(trim(v), ',', '')"


@check("encode_sentence", f"{CELLS} SELECT k AS p_partkey, string_agg({SENTENCE}, ', ' ORDER BY i) AS text FROM n GROUP BY k")
def encode_sentence(spark, folder):
    return T.encode_rows(_holed(spark, folder), PART, "tab2text")


@check("encode_json", CELLS + " SELECT k AS p_partkey, '{' || string_agg('\"' || f || '\":\"' || v || '\"', ',' ORDER BY i) || '}' AS text FROM n GROUP BY k")
def encode_json(spark, folder):
    return T.encode_rows(_holed(spark, folder), PART, "tab2json")


@check("encode_values", f"{CELLS} SELECT k AS p_partkey, string_agg(v, ', ' ORDER BY i) AS text FROM n GROUP BY k")
def encode_values(spark, folder):
    return T.encode_rows(_holed(spark, folder), PART, "tab2num")


@check("encode_permuted", f"{CELLS} SELECT k AS p_partkey, string_agg({SENTENCE}, ', ' "
       "ORDER BY md5(concat_ws('|', k, f, 'permute', 5))) AS text FROM n GROUP BY k")
def encode_permuted(spark, folder):
    return T.encode_rows(_holed(spark, folder), PART, "tab2text", permute_seed=5)


@check("encode_unknown_token", f"{CELLS} SELECT k AS p_partkey, string_agg(replace(v, '[MASK]', '[UNK]'), ', ' ORDER BY i) AS text FROM n GROUP BY k")
def encode_unknown_token(spark, folder):
    return T.encode_rows(_holed(spark, folder), PART, "tab2num", token=T.UNKNOWN_TOKEN)


@check("parse_sentence", f"{CELLS} SELECT k AS p_partkey, f AS name, v AS value, round(try_cast(v AS DOUBLE), 6) AS number FROM n")
def parse_sentence(spark, folder):
    texts = T.encode_rows(_holed(spark, folder), PART)
    return texts.select("p_partkey", F.explode(T.parse_sentence(F.col("text"))).alias("name", "value")).withColumn(
        "number", F.round(F.col("value").try_cast("double"), 6))


@check("format_parsed", f"{CELLS} SELECT k AS p_partkey, string_agg(f || ' is ' || v, ', ' ORDER BY i) AS text FROM n GROUP BY k")
def format_parsed(spark, folder):
    texts = T.encode_rows(_holed(spark, folder), PART)
    return texts.select("p_partkey", T.format_map(T.parse_sentence(F.col("text"))).alias("text"))


@check("truncate_tokens", "WITH t AS (SELECT doc_id, list_slice(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\r\\f\\v]+'), 1, 512) AS w FROM documents) "
       "SELECT doc_id, len(w)::INTEGER AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM t")
def truncate_tokens(spark, folder):
    cut = T.truncate_tokens(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.size(F.split(cut, " ")).alias("n_tokens"), F.md5(cut).alias("digest"))


# ---------------------------------------------------------------- triples

COUNTS = (f"{CDF_SQL}, seen AS (SELECT k, count(*) FILTER (WHERE v <> '[MASK]') AS o FROM n GROUP BY k), "
          "take AS (SELECT k, least(o, 1 + (SELECT count(*) FROM cdf WHERE cdf.o = seen.o AND p < "
          + u_sql("seen.k", "'remask-count'", 0) + ")) AS c FROM seen)")
RANKED = ("ranked AS (SELECT *, CASE WHEN v <> '[MASK]' THEN row_number() OVER (PARTITION BY k, v = '[MASK]' "
          "ORDER BY md5(concat_ws('|', k, f, 'remask', 0))) END AS r FROM n)")


def _triples(write: str, separator: str, fixed: int | None = None, wrap: str = "{}") -> str:
    limit = str(fixed) if fixed else "c"
    hidden = f"CASE WHEN r <= {limit} THEN '[MASK]' ELSE v END"
    anchor = wrap.format(f"string_agg({write.format(v='v')}, '{separator}' ORDER BY i)")
    positive = wrap.format(f"string_agg({write.format(v=hidden)}, '{separator}' ORDER BY i)")
    return (f"{CELLS}, {COUNTS}, {RANKED}, texts AS (SELECT k, {anchor} AS anchor, {positive} AS positive "
            "FROM ranked JOIN take USING (k) GROUP BY k), "
            "b AS (SELECT (row_number() OVER (ORDER BY k) - 1) // 16 AS batch_id, k, anchor, positive, "
            "md5(concat_ws('|', k, 'negative', 0)) AS m FROM texts)")


FIELD = "f || ' is ' || {v}"
TRIPLES = (", l AS (SELECT batch_id, list(k ORDER BY k) AS ks, list(anchor ORDER BY k) AS an, list(positive ORDER BY k) AS po, "
           "list(positive ORDER BY m, positive) AS mi FROM b GROUP BY 1 HAVING count(DISTINCT positive) > 1), "
           "ne AS (SELECT *, CASE WHEN mi <> po THEN mi ELSE list_concat(po[2:], po[1:1]) END AS ng FROM l) "
           "SELECT batch_id, unnest(ks) AS p_partkey, unnest(an) AS anchor, unnest(po) AS positive, unnest(ng) AS negative FROM ne")


@check("row_batches", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS batch_id, o_orderkey FROM orders")
def row_batches(spark, folder):
    return P.with_batch(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 16)


@check("positive_samples", _triples(FIELD, ", ") + " SELECT batch_id, k AS p_partkey, anchor, positive FROM b")
def positive_samples(spark, folder):
    return P.positives(_holed(spark, folder), PART)


@check("positive_samples_values", _triples("{v}", ", ", 3) + " SELECT batch_id, k AS p_partkey, anchor, positive FROM b")
def positive_samples_values(spark, folder):
    return P.positives(_holed(spark, folder), PART, "tab2num")


@check("usable_batches", _triples("{v}", ", ", 3) + " SELECT batch_id, count(*) AS n_rows, count(DISTINCT positive) AS n_distinct "
       "FROM b GROUP BY 1 HAVING count(DISTINCT positive) > 1")
def usable_batches(spark, folder):
    return P.usable_batches(P.positives(_holed(spark, folder), PART, "tab2num"))


@check("contrastive_pairs_sentence", _triples(FIELD, ", ") + TRIPLES)
def contrastive_pairs_sentence(spark, folder):
    return P.contrastive_pairs(_holed(spark, folder), PART)


@check("contrastive_pairs_json", _triples("'\"' || f || '\":\"' || {v} || '\"'", ",", None, "'{{' || {} || '}}'") + TRIPLES)
def contrastive_pairs_json(spark, folder):
    return P.contrastive_pairs(_holed(spark, folder), PART, "tab2json")


@check("contrastive_pairs_values", _triples("{v}", ", ", 3) + TRIPLES)
def contrastive_pairs_values(spark, folder):
    return P.contrastive_pairs(_holed(spark, folder), PART, "tab2num")
