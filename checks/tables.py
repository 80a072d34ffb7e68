"""Sources, sinks, cleaning, cells, coding, splits and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    LINE_SQL, LINEITEM, ORDERS, PART, check, code_sql, coded, coded_sql, holed_sql, lineitem, table, text_sql, u_sql,
)
from lacuna.functions.randomness import cell_uniform, pick_names, truncated_poisson, uniform
from lacuna.operators import ampute as A
from lacuna.operators import cells as C
from lacuna.operators import coding, fidelity, position, split
from lacuna.operators.embed import hash_vectors
from lacuna.scratch import new_path
from lacuna.sources import catalog, tables
from lacuna.sources.arff import read_arff
from lacuna.sources.delimited import read_delimited

PART_COLUMNS = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
                "p_size": "int", "p_retailprice": "double"}
PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _holed(spark, folder):
    return A.apply_mask(table(spark, folder, "part"), A.mcar(PART, 0.3, 0))


HOLED = "WITH " + holed_sql("part", PART)


def _written(spark, folder, **options):
    path = new_path(spark, "csv")
    table(spark, folder, "part").select(*PART_COLUMNS).write.options(**options).csv(path)
    return path


@check("scan_csv_no_header", PART_SQL)
def scan_csv_no_header(spark, folder):
    return read_delimited(spark, _written(spark, folder), PART_COLUMNS)


@check("scan_csv_header_renamed", "SELECT p_partkey AS id, p_name, p_brand AS brand, p_type, p_size, p_retailprice FROM part")
def scan_csv_header_renamed(spark, folder):
    return read_delimited(spark, _written(spark, folder, header=True), PART_COLUMNS, header=True,
                          rename={"p_partkey": "id", "p_brand": "brand"})


@check("scan_csv_semicolon", PART_SQL)
def scan_csv_semicolon(spark, folder):
    return read_delimited(spark, _written(spark, folder, header=True, sep=";"), PART_COLUMNS, header=True, separator=";")


@check("scan_arff", "SELECT p_partkey::DOUBLE AS p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size::DOUBLE END AS p_size, "
       "p_retailprice, p_brand, p_type FROM part")
def scan_arff(spark, folder):
    size = F.when(F.col("p_size") > 40, F.lit("?")).otherwise(F.col("p_size").cast("string"))
    return _arff(spark, folder, F.concat_ws(",", "p_partkey", size, "p_retailprice", "p_brand", "p_type"))


def _arff(spark, folder, row):
    """Rows of part as data lines behind a header that declares text as string."""
    head = ["% parts", "@relation part", "", "@attribute p_partkey integer", "@ATTRIBUTE p_size NUMERIC",
            "@attribute 'p_retailprice' real", "@attribute p_brand string", "@attribute p_type string", "@data"]
    path = new_path(spark, "arff")
    spark.createDataFrame([(v,) for v in head], "value string").coalesce(1).write.text(path)
    table(spark, folder, "part").select(row.alias("value")).write.mode("append").text(path)
    return read_arff(spark, path)


@check("scan_arff_quoted", "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice, '@' || p_brand || ', it''s' AS p_brand, "
       "CASE WHEN p_size > 40 THEN '?' ELSE '%' || p_type END AS p_type FROM part")
def scan_arff_quoted(spark, folder):
    """Values that look like keywords, comments and missing cells, in either kind of quotes."""
    brand = F.concat(F.lit('"@'), "p_brand", F.lit(", it's\""))
    kind = F.when(F.col("p_size") > 40, F.lit("'?'")).otherwise(F.concat(F.lit("'%"), "p_type", F.lit("'")))
    return _arff(spark, folder, F.concat_ws(" , ", "p_partkey", "p_size", "p_retailprice", brand, kind))


@check("catalog_table", "SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer")
def catalog_table(spark, folder):
    return catalog.load(spark, "customer", folder)[0]


_BINS = ("WITH r AS (SELECT min(p_retailprice) AS lo1, max(p_retailprice) AS hi1, min(p_size) AS lo2, max(p_size) AS hi2 FROM part), "
         "t AS (SELECT p_partkey AS k, 'p_retailprice=' || least(floor((p_retailprice - lo1) / (hi1 - lo1) * 10), 9)::INTEGER AS t FROM part, r "
         "UNION ALL SELECT p_partkey, 'p_size=' || least(floor((p_size - lo2)::DOUBLE / (hi2 - lo2) * 10), 9)::INTEGER FROM part, r "
         "UNION ALL SELECT p_partkey, 'p_brand=' || p_brand FROM part UNION ALL SELECT p_partkey, 'p_type=' || p_type FROM part), "
         "v AS (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END) AS x "
         "FROM t GROUP BY 1, 2) "
         "SELECT k AS p_partkey, i::INTEGER AS i, x::DOUBLE AS x FROM v WHERE x <> 0")


def _nonzero(df):
    return (df.select("p_partkey", F.posexplode("vec").alias("i", "x")).where("x <> 0")
            .select("p_partkey", F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x")))


@check("hash_vectors", _BINS)
def hash_vector_entries(spark, folder):
    return _nonzero(hash_vectors(table(spark, folder, "part"), PART))


@check("embedding_sink", _BINS)
def embedding_sink(spark, folder):
    path = new_path(spark, "sink")
    tables.write_embeddings(hash_vectors(table(spark, folder, "part"), PART), "p_partkey", "vec", path)
    return _nonzero(tables.read_embeddings(spark, path))


@check("embedding_cache", _BINS)
def embedding_cache(spark, folder):
    home = new_path(spark, "cache")
    settings = {"encoder": "hash", "table": "part", "dim": 64, "seed": 0}
    for _ in range(2):
        found = tables.cached_embeddings(spark, home, settings, "p_partkey", "vec",
                                         lambda: hash_vectors(table(spark, folder, "part"), PART))
    return _nonzero(found)


@check("metric_sink", "SELECT count(*) AS n_rows, round(avg(o_totalprice), 6) AS mean_price FROM orders")
def metric_sink(spark, folder):
    path = new_path(spark, "metrics")
    row = table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    tables.write_metrics(row, path)
    return spark.read.schema("n_rows bigint, mean_price double").json(path)


@check("project_roles", "SELECT p_partkey, p_retailprice, p_size, p_brand, p_type FROM part")
def project_roles(spark, folder):
    return C.project(table(spark, folder, "part"), PART)


@check("drop_column", "SELECT * EXCLUDE (p_name) FROM part")
def drop_column(spark, folder):
    return table(spark, folder, "part").drop("p_name")


@check("drop_rows_with_holes", HOLED + " SELECT * FROM holed WHERE p_retailprice IS NOT NULL AND p_size IS NOT NULL "
       "AND p_brand IS NOT NULL AND p_type IS NOT NULL")
def drop_rows_with_holes(spark, folder):
    return C.drop_holes(C.project(_holed(spark, folder), PART))


@check("null_counts", HOLED + " SELECT count(*) - count(p_retailprice) AS p_retailprice, count(*) - count(p_size) AS p_size, "
       "count(*) - count(p_brand) AS p_brand, count(*) - count(p_type) AS p_type FROM holed")
def null_counts(spark, folder):
    return C.null_counts(_holed(spark, folder), PART.features)


@check("no_holes_asserted", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def no_holes_asserted(spark, folder):
    return C.assert_no_holes(table(spark, folder, "lineitem").select(*LINEITEM.features))


@check("columns_by_prefix", "SELECT l_linenumber, l_linestatus FROM lineitem")
def columns_by_prefix(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.select(*C.named_like(df, "l_line"))


@check("columns_by_complement", "SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders")
def columns_by_complement(spark, folder):
    df = table(spark, folder, "orders")
    return df.select(*C.all_but(df, "o_orderdate", "o_custkey"))


def _token_sql(f):
    return f"coalesce({text_sql(f, f in PART.continuous)}, '[MASK]') AS {f}"


@check("fill_mask_token", HOLED + f" SELECT p_partkey, {', '.join(map(_token_sql, PART.features))} FROM holed")
def fill_mask_token(spark, folder):
    return C.fill_token(C.project(_holed(spark, folder), PART), PART.features)


@check("missing_features", HOLED + " SELECT p_partkey, concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in PART.features) + ") AS missing FROM holed")
def missing_features(spark, folder):
    found = C.missing_features(_holed(spark, folder), PART)
    return found.select("p_partkey", F.concat_ws(",", "missing").alias("missing"))


@check("apply_mask", HOLED + " SELECT * FROM holed")
def apply_mask(spark, folder):
    return C.project(_holed(spark, folder), PART)


@check("cells_long", f"WITH {LINE_SQL} SELECT l_key, 'l_quantity' AS feature, l_quantity AS value FROM lines UNION ALL "
       "SELECT l_key, 'l_discount', l_discount FROM lines")
def cells_long(spark, folder):
    return C.to_cells(lineitem(spark, folder), LINEITEM, ["l_quantity", "l_discount"])


@check("cells_wide", HOLED + " SELECT p_partkey, p_retailprice, p_size::DOUBLE AS p_size FROM holed")
def cells_wide(spark, folder):
    names = ["p_retailprice", "p_size"]
    return C.from_cells(C.to_cells(_holed(spark, folder), PART, names), PART, names)


@check("row_positions", f"WITH {LINE_SQL} SELECT l_key, row_number() OVER (ORDER BY l_key) - 1 AS pos FROM lines")
def row_positions(spark, folder):
    return position.with_position(lineitem(spark, folder).select("l_key"), "l_key")


@check("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, folder):
    return C.row_count(table(spark, folder, "lineitem"))


_DIMENSION = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, v::VARCHAR AS value, c AS code FROM {code_sql(f, 'customer')}" for f in ("c_mktsegment", "c_nationkey"))


@check("category_dimension", _DIMENSION)
def category_dimension(spark, folder):
    return coding.build_dimension(table(spark, folder, "customer"), ["c_mktsegment", "c_nationkey"])


@check("category_encode", "WITH " + coded_sql("orders", ORDERS) + " SELECT * FROM coded")
def category_encode(spark, folder):
    return coded(table(spark, folder, "orders"), ORDERS)


@check("category_decode", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def category_decode(spark, folder):
    orders = table(spark, folder, "orders")
    dimension = coding.build_dimension(orders, ["o_orderstatus"])
    codes = coding.encode(orders, dimension, ["o_orderstatus"])
    codes = codes.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 300000, 99).otherwise(F.col("o_orderstatus")))
    return coding.decode(codes, dimension, ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@check("category_counts", "SELECT count(DISTINCT o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderpriority) AS o_orderpriority FROM orders")
def category_counts(spark, folder):
    return coding.level_counts(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@check("split_train_test", "SELECT o_orderkey, row_number() OVER (ORDER BY " + u_sql("o_orderkey", "'split'", 0)
       + ", o_orderkey) <= ceil(0.2 * (SELECT count(*) FROM orders)) AS is_test FROM orders")
def split_train_test(spark, folder):
    train, test = split.train_test_split(table(spark, folder, "orders").select("o_orderkey"), ORDERS, 0.2, 0)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@check("cell_uniforms", f"WITH {LINE_SQL} SELECT l_key, {u_sql('l_key', repr('l_tax'), repr('demo'), 7)} AS u FROM lines")
def cell_uniforms(spark, folder):
    return lineitem(spark, folder).select("l_key", cell_uniform(F.col("l_key"), "l_tax", "demo", 7).alias("u"))


@check("sampled_features", "WITH names AS (SELECT unnest(" + str(list(PART.features)) + ") AS f), "
       "chosen AS (SELECT f FROM names ORDER BY md5(f || '|demo|3') LIMIT 2), "
       "cells AS (SELECT p_partkey, 'p_retailprice' AS feature, p_retailprice::VARCHAR AS value FROM part "
       "UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part "
       "UNION ALL SELECT p_partkey, 'p_type', p_type FROM part) SELECT p_partkey, feature FROM cells JOIN chosen ON f = feature")
def sampled_features(spark, folder):
    chosen = pick_names(PART.features, 2, "demo", 3)
    df = table(spark, folder, "part").select("p_partkey", *[F.col(f).cast("string").alias(f) for f in chosen])
    return df.unpivot("p_partkey", chosen, "feature", "value").select("p_partkey", "feature")


CDF_SQL = ("cdf AS (SELECT o, k, (SELECT sum(pow(o / 2.0, i) / gamma(i + 1)) FROM range(1, 40) AS s(i) WHERE i <= k) "
           "* exp(-o / 2.0) / (1 - exp(-o / 2.0)) AS p FROM range(1, 5) AS a(o), range(1, 5) AS b(k))")


@check("poisson_counts", HOLED + f", {CDF_SQL}, seen AS (SELECT p_partkey, (p_retailprice IS NOT NULL)::INT + (p_size IS NOT NULL)::INT "
       "+ (p_brand IS NOT NULL)::INT + (p_type IS NOT NULL)::INT AS o FROM holed) "
       "SELECT p_partkey, least(o, 1 + (SELECT count(*) FROM cdf WHERE cdf.o = seen.o AND p < "
       + u_sql("p_partkey", "'count'", 0) + "))::INTEGER AS drawn FROM seen")
def poisson_counts(spark, folder):
    seen = sum((F.col(f).isNotNull().cast("int") for f in PART.features), F.lit(0))
    return _holed(spark, folder).select(
        "p_partkey", truncated_poisson(uniform(F.col("p_partkey"), "count", 0), seen, 4).alias("drawn"))


@check("order_statistics", "SELECT (SELECT l_extendedprice FROM lineitem ORDER BY 1 LIMIT 1 OFFSET (SELECT (0.25 * count(*))::INT - 1 FROM lineitem)) "
       "AS price, (SELECT l_quantity FROM lineitem ORDER BY 1 LIMIT 1 OFFSET (SELECT (0.75 * count(*))::INT - 1 FROM lineitem)) AS quantity")
def order_statistics(spark, folder):
    df = table(spark, folder, "lineitem")
    n = df.count()
    got = position.order_statistics(df, {"price": (F.col("l_extendedprice"), [int(0.25 * n)]),
                                         "quantity": (F.col("l_quantity"), [int(0.75 * n)])})
    return df.agg(F.lit(got["price"][0]).alias("price"), F.lit(got["quantity"][0]).alias("quantity"))


# a third of the values infinite, some not numbers
_ODD = "CASE WHEN l_linenumber = 1 THEN '-inf' WHEN l_linenumber = 2 THEN 'inf' WHEN l_linenumber = 3 AND l_quantity > 45 THEN 'nan' ELSE l_extendedprice::VARCHAR END::DOUBLE"


@check("order_statistics_infinite", f"WITH o AS (SELECT {_ODD} AS v, row_number() OVER (ORDER BY {_ODD}) AS k, count(*) OVER () AS n FROM lineitem) "
       "SELECT k::INTEGER AS k, CASE WHEN isnan(v) THEN 'NaN' WHEN isinf(v) THEN CASE WHEN v < 0 THEN '-Infinity' ELSE 'Infinity' END ELSE round(v, 2)::DECIMAL(18,2)::VARCHAR END AS v FROM o WHERE k IN "
       "(1, floor(n * 0.1)::INT, floor(n * 0.3)::INT, floor(n * 0.4)::INT, floor(n * 0.5)::INT, floor(n * 0.7)::INT, floor(n * 0.9)::INT, n)")
def order_statistics_infinite(spark, folder):
    odd = F.expr("double(CASE WHEN l_linenumber = 1 THEN '-Infinity' WHEN l_linenumber = 2 THEN 'Infinity' "
                 "WHEN l_linenumber = 3 AND l_quantity > 45 THEN 'NaN' ELSE string(l_extendedprice) END)")
    df = table(spark, folder, "lineitem").select(odd.alias("v"))
    n = df.count()
    ks = [1, *[int(n * t / 10) for t in (1, 3, 4, 5, 7, 9)], n]
    values = position.order_statistics(df, {"v": (F.col("v"), ks)})["v"]
    text = [str(v).replace("inf", "Infinity").replace("nan", "NaN") if v - v != 0 else f"{v:.2f}" for v in values]
    return df.limit(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.array(*map(F.lit, text)).alias("v"))).alias("r")).select("r.k", "r.v")


@check("value_ranges", "SELECT 'l_quantity' AS feature, min(l_quantity) AS lo, max(l_quantity) AS hi, least(10, count(DISTINCT l_quantity))::INTEGER AS n FROM lineitem "
       "UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), least(10, count(DISTINCT l_tax)) FROM lineitem")
def value_ranges(spark, folder):
    found = fidelity.value_range(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"])
    return found.select("feature", "lo", "hi", F.least(F.lit(10), "n_distinct").alias("n"))
