"""Fidelity and utility of imputed tables, and whole runs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.registry import LINE_SQL, LINEITEM, ORDERS, PART, check, coded, coded_sql, lineitem, table, u_sql
from lacuna.operators import ampute as A
from lacuna.operators import cells as C
from lacuna.operators import fidelity, position, split, utility
from lacuna.plans.experiment import experiment
from lacuna.scratch import cut, new_path

# A stand-in for an imputed table: hidden prices are 10 % too low, hidden codes one too high.
_CODED = coded_sql("orders", ORDERS)


def _u(f):
    return u_sql("o_orderkey", repr(f), "'mcar'", 0)


GUESSED = (f"WITH {_CODED}, guessed AS MATERIALIZED (SELECT o_orderkey, "
           f"CASE WHEN {_u('o_totalprice')} < 0.3 THEN o_totalprice * 0.9 ELSE o_totalprice END AS o_totalprice, "
           f"CASE WHEN {_u('o_orderstatus')} < 0.3 THEN (o_orderstatus + 1) % 3 ELSE o_orderstatus END AS o_orderstatus, "
           f"CASE WHEN {_u('o_orderpriority')} < 0.3 THEN (o_orderpriority + 1) % 5 ELSE o_orderpriority END AS o_orderpriority FROM coded)")


def _guessed(spark, folder):
    truth = coded(table(spark, folder, "orders"), ORDERS)
    hidden = A.mcar(ORDERS, 0.3, 0)
    wrong = {"o_totalprice": F.col("o_totalprice") * 0.9, "o_orderstatus": (F.col("o_orderstatus") + 1) % 3,
             "o_orderpriority": (F.col("o_orderpriority") + 1) % 5}
    guess = truth.withColumns({f: F.when(hidden[f], wrong[f]).otherwise(F.col(f)) for f in ORDERS.features})
    return truth, guess, C.mask_table(truth, ORDERS, hidden)


_ERRORS = (GUESSED + ", joined AS (SELECT t.*, g.o_totalprice AS gp, g.o_orderstatus AS gs, g.o_orderpriority AS gq FROM coded t JOIN guessed g USING (o_orderkey)), "
           f"m AS (SELECT (SELECT avg(abs(o_totalprice - gp) / (abs(o_totalprice) + abs(gp) + 1e-6)) FROM joined WHERE {_u('o_totalprice')} < 0.3) AS smape, "
           f"((SELECT count(*) FROM joined WHERE {_u('o_orderstatus')} < 0.3 AND gs <> o_orderstatus) + (SELECT count(*) FROM joined WHERE {_u('o_orderpriority')} < 0.3 AND gq <> o_orderpriority))::DOUBLE / "
           f"((SELECT count(*) FROM joined WHERE {_u('o_orderstatus')} < 0.3) + (SELECT count(*) FROM joined WHERE {_u('o_orderpriority')} < 0.3)) AS error) "
           "SELECT round(smape, 6) AS smape, round(error, 6) AS error, round(smape + error, 6) AS asmape FROM m")


@check("cell_errors", _ERRORS)
def cell_errors(spark, folder):
    truth, guess, mask = _guessed(spark, folder)
    got = fidelity.cell_errors(truth, guess, mask, ORDERS)
    return got.select(*[F.round(c, 6).alias(c) for c in ("smape", "error", "asmape")])


# every 50th row has no price in the guess, every 70th row is gone: prices and sum cannot be scored
@check("cell_errors_unfilled", _ERRORS.replace("SELECT round(smape, 6) AS smape, round(error, 6) AS error, round(smape + error, 6) AS asmape FROM m",
                                               "SELECT NULL::DOUBLE AS smape, round(error, 6) AS error, NULL::DOUBLE AS asmape FROM m"))
def cell_errors_unfilled(spark, folder):
    truth, guess, mask = _guessed(spark, folder)
    lost = guess.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")))
    return fidelity.cell_errors(truth, lost, mask, ORDERS).select(*[F.round(c, 6).alias(c) for c in ("smape", "error", "asmape")])


@check("unfilled_cells", GUESSED + ", lost AS (SELECT * FROM coded WHERE o_orderkey % 70 = 0 OR o_orderkey % 50 = 0) "
       f"SELECT count(*) FILTER ({_u('o_totalprice')} < 0.3) AS o_totalprice, count(*) FILTER (o_orderkey % 70 = 0 AND {_u('o_orderstatus')} < 0.3) AS o_orderstatus, "
       f"count(*) FILTER (o_orderkey % 70 = 0 AND {_u('o_orderpriority')} < 0.3) AS o_orderpriority FROM lost")
def unfilled_cells(spark, folder):
    _, guess, mask = _guessed(spark, folder)
    lost = guess.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice"))).where("o_orderkey % 70 <> 0")
    return fidelity.unfilled_cells(lost, mask, ORDERS)


# ---------------------------------------------------------------- distributions

_LINES = f"{LINE_SQL}, {coded_sql('lines', LINEITEM)}"
# truth: lines as they are; the other table: cheaper, with returned flags turned
CHANGED = ("changed AS MATERIALIZED (SELECT l_key, l_quantity, l_extendedprice * 0.8 AS l_extendedprice, l_discount, "
           "CASE WHEN l_tax > 0.06 THEN 0.06 ELSE l_tax END AS l_tax, l_returnflag, least(l_linestatus, 0) AS l_linestatus FROM coded)")


def _changed(spark, folder):
    truth = coded(lineitem(spark, folder), LINEITEM)
    other = truth.withColumns({
        "l_extendedprice": F.col("l_extendedprice") * 0.8, "l_tax": F.least(F.col("l_tax"), F.lit(0.06)),
        "l_linestatus": F.least(F.col("l_linestatus"), F.lit(0))})
    return truth, other


def _continuous(names) -> str:
    """CTE fr: (f, b, p, q), smoothed shares of the histogram bins."""
    cells = {s: " UNION ALL ".join(f"SELECT '{f}' AS f, {f}::DOUBLE AS v FROM {s} WHERE {f} IS NOT NULL" for f in names) for s in ("coded", "changed")}
    return (f"tc AS ({cells['coded']}), ic AS ({cells['changed']}), "
            "rg AS (SELECT f, min(v) AS lo, max(v) AS hi, least(10, count(DISTINCT v)) AS nb, count(DISTINCT v) < 5 AS few FROM tc GROUP BY f), "
            "tb AS (SELECT f, CASE WHEN few THEN v ELSE least(floor((v - lo) / (hi - lo) * nb), nb - 1) END AS b, count(*) AS n FROM tc JOIN rg USING (f) GROUP BY 1, 2), "
            "ib AS (SELECT f, CASE WHEN few THEN v ELSE least(floor((v - lo) / (hi - lo) * nb), nb - 1) END AS b, count(*) AS n FROM ic JOIN rg USING (f) "
            "WHERE few OR (v >= lo AND v <= hi) GROUP BY 1, 2), "
            "ab AS (SELECT f, b FROM tb UNION SELECT f, b FROM ib UNION SELECT f, unnest(range(0, nb))::DOUBLE FROM rg WHERE NOT few), "
            "sh AS (SELECT ab.f, ab.b, coalesce(tb.n, 0) / ((SELECT sum(n) FROM tb t2 WHERE t2.f = ab.f) + CASE WHEN few THEN 0 ELSE 1e-8 END) AS p, "
            "coalesce(ib.n, 0) / ((SELECT sum(n) FROM ib i2 WHERE i2.f = ab.f) + CASE WHEN few THEN 0 ELSE 1e-8 END) AS q "
            "FROM ab JOIN rg USING (f) LEFT JOIN tb ON tb.f = ab.f AND tb.b = ab.b LEFT JOIN ib ON ib.f = ab.f AND ib.b = ab.b), "
            "fr AS (SELECT f, b, CASE WHEN p = 0 THEN 1e-11 ELSE p END AS p, CASE WHEN q = 0 THEN 1e-11 ELSE q END AS q FROM sh)")


_KL_CONT = ("kc AS (SELECT f, sum(q / sq * ln((q / sq) / (p / sp))) AS kl FROM (SELECT *, sum(p) OVER (PARTITION BY f) AS sp, "
            "sum(q) OVER (PARTITION BY f) AS sq FROM fr) GROUP BY f)")
_KL_CAT = "kd AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS f, coalesce(sum(b.q * ln(b.q / a.p)), 0) AS kl FROM (SELECT {f} AS v, count(*) / (SELECT count(*) FROM coded)::DOUBLE AS p FROM coded GROUP BY 1) a "
    f"JOIN (SELECT {f} AS v, count(*) / (SELECT count(*) FROM changed)::DOUBLE AS q FROM changed GROUP BY 1) b USING (v)"
    for f in LINEITEM.categorical) + ")"


@check("histogram_shares", f"WITH {_LINES}, {CHANGED}, {_continuous(['l_quantity', 'l_extendedprice', 'l_tax'])} "
       "SELECT f AS feature, b::DOUBLE AS bin, round(p, 9) AS p, round(q, 9) AS q FROM fr")
def histogram_shares(spark, folder):
    got = fidelity.frequencies(*_changed(spark, folder), ["l_quantity", "l_extendedprice", "l_tax"])
    return got.select("feature", "bin", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@check("value_shares", f"WITH {_LINES}, {CHANGED}, {_continuous(['l_returnflag', 'l_linestatus'])} "
       "SELECT f AS feature, b::DOUBLE AS bin, round(p, 9) AS p, round(q, 9) AS q FROM fr")
def value_shares(spark, folder):
    got = fidelity.frequencies(*_changed(spark, folder), ["l_returnflag", "l_linestatus"])
    return got.select("feature", "bin", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@check("kl_continuous", f"WITH {_LINES}, {CHANGED}, {_continuous(LINEITEM.continuous)}, {_KL_CONT} SELECT f AS feature, round(kl, 6) AS kl FROM kc")
def kl_continuous(spark, folder):
    got = fidelity.kl_continuous(*_changed(spark, folder), LINEITEM.continuous)
    return got.select("feature", F.round("kl", 6).alias("kl"))


@check("kl_categorical", f"WITH {_LINES}, {CHANGED}, {_KL_CAT} SELECT f AS feature, round(kl, 6) AS kl FROM kd")
def kl_categorical(spark, folder):
    got = fidelity.kl_categorical(*_changed(spark, folder), LINEITEM.categorical)
    return got.select("feature", F.round("kl", 6).alias("kl"))


@check("kl_mean", f"WITH {_LINES}, {CHANGED}, {_continuous(LINEITEM.continuous)}, {_KL_CONT}, {_KL_CAT} "
       "SELECT round(avg(kl), 6) AS kl FROM (SELECT kl FROM kc UNION ALL SELECT kl FROM kd)")
def kl_mean(spark, folder):
    return fidelity.kl_mean(*_changed(spark, folder), LINEITEM).select(F.round("kl", 6).alias("kl"))


# expensive lines have lost their price, some of them by NaN and some by NULL
_KNOWN = "CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END AS l_extendedprice"
_LOST = f"{LINE_SQL}, whole AS (SELECT * REPLACE ({_KNOWN}) FROM lines), {coded_sql('whole', LINEITEM)}"


@check("kl_nan", f"WITH {_LOST}, {CHANGED}, {_continuous(LINEITEM.continuous)}, {_KL_CONT}, {_KL_CAT} "
       "SELECT round(avg(kl), 6) AS kl FROM (SELECT kl FROM kc UNION ALL SELECT kl FROM kd)")
def kl_nan(spark, folder):
    gone = F.when(F.col("l_quantity") > 48, None).when(F.col("l_quantity") > 45, float("nan"))
    truth, other = (df.withColumn("l_extendedprice", gone.otherwise(F.col("l_extendedprice"))) for df in _changed(spark, folder))
    return fidelity.kl_mean(truth, other, LINEITEM).select(F.round("kl", 6).alias("kl"))


@check("cell_errors_nan", _ERRORS.replace("SELECT round(smape, 6) AS smape, round(error, 6) AS error, round(smape + error, 6) AS asmape FROM m",
                                          f"SELECT NULL::DOUBLE AS smape, round(error, 6) AS error, NULL::DOUBLE AS asmape, (SELECT count(*) FROM coded WHERE o_orderkey % 50 = 0 AND {_u('o_totalprice')} < 0.3) AS unfilled FROM m"))
def cell_errors_nan(spark, folder):
    """A fill that is NaN is no fill."""
    truth, guess, mask = _guessed(spark, folder)
    lost = guess.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, float("nan")).otherwise(F.col("o_totalprice")))
    unfilled = fidelity.unfilled_cells(lost, mask, ORDERS).first()["o_totalprice"]
    return fidelity.cell_errors(truth, lost, mask, ORDERS).select(*[F.round(c, 6).alias(c) for c in ("smape", "error", "asmape")],
                                                                  F.lit(unfilled).cast("bigint").alias("unfilled"))


# ---------------------------------------------------------------- utility

@check("standardize", f"WITH {LINE_SQL} SELECT l_key, " + ", ".join(
    f"round(({f} - (SELECT avg({f}) FROM lines)) / (SELECT stddev_samp({f}) FROM lines), 6) AS {f}" for f in LINEITEM.continuous) + " FROM lines")
def standardize(spark, folder):
    df = lineitem(spark, folder).select("l_key", *LINEITEM.continuous)
    scaled = utility.standardize(df, utility.scale_stats(df, LINEITEM))
    return scaled.select("l_key", *[F.round(f, 6).alias(f) for f in LINEITEM.continuous])


_SPLIT = (f"WITH {coded_sql('part', PART)}, ranked AS (SELECT *, row_number() OVER (ORDER BY {u_sql('p_partkey', repr('split'), 0)}, p_partkey) "
          "<= ceil(0.2 * (SELECT count(*) FROM part)) AS te FROM coded), "
          "st AS (SELECT avg(p_retailprice) AS m1, stddev_samp(p_retailprice) AS s1, avg(p_size) AS m2, stddev_samp(p_size) AS s2 FROM ranked WHERE NOT te), "
          "z AS MATERIALIZED (SELECT p_partkey AS k, te, (p_retailprice - m1) / s1 AS x1, (p_size - m2) / s2 AS x2, p_brand::DOUBLE AS x3, p_type::DOUBLE AS y FROM ranked, st), "
          "nn AS (SELECT q.k, q.y AS label, d.y FROM z q JOIN z d ON q.te AND NOT d.te QUALIFY row_number() OVER (PARTITION BY q.k "
          "ORDER BY round(sqrt((q.x1 - d.x1) * (q.x1 - d.x1) + (q.x2 - d.x2) * (q.x2 - d.x2) + (q.x3 - d.x3) * (q.x3 - d.x3)), 12), d.k) <= 5), "
          "pr AS (SELECT k, any_value(label) AS label, y AS prediction FROM nn GROUP BY k, y QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, y) = 1)")


def _parts(spark, folder):
    df = coded(table(spark, folder, "part"), PART)
    train, test = split.train_test_split(df, PART, 0.2, 0)
    stats = utility.scale_stats(train, PART)
    return utility.standardize(train, stats), utility.standardize(test, stats)


@check("knn_classifier", _SPLIT + " SELECT k AS p_partkey, prediction FROM pr")
def knn_classifier(spark, folder):
    return utility.knn_classify(*_parts(spark, folder), PART)


@check("micro_f1", _SPLIT + " SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM pr")
def micro_f1(spark, folder):
    train, test = _parts(spark, folder)
    guess = utility.knn_classify(train, test, PART).join(test.select("p_partkey", F.col("p_type").alias("label")), "p_partkey")
    return utility.micro_f1(guess, "label", "prediction").select(F.round("f1", 6).alias("f1"))


def _model(spark, folder, name):
    scores = utility.model_scores(*_parts(spark, folder), PART, models=(name,))
    rows = [(name, scores.f1[name])] + [(f"importance of {c}", v) for c, v in scores.importance.items()]
    return spark.createDataFrame(rows, "name string, score double")


@check("logistic_regression")
def logistic_regression(spark, folder):
    return _model(spark, folder, "logit")


# at the fitted weights the mean loss with its penalty has no slope, in any class and covariate (the last one is the constant)
@check("logistic_slope", _SPLIT[:_SPLIT.index(", nn AS")] + " SELECT c::INTEGER AS class, j::INTEGER AS covariate, 0.0::DOUBLE AS slope FROM (SELECT DISTINCT y AS c FROM z WHERE NOT te), range(0, 4) r(j)")
def logistic_slope(spark, folder):
    train, _ = _parts(spark, folder)
    rows = cut(utility._assembled(train, PART), "rows")
    n = rows.count()
    model = utility.estimators(n)["logit"].fit(rows)
    weights, classes, size = model.coefficientMatrix.toArray(), model.numClasses, len(PART.covariates)
    made = model.transform(rows).select(vector_to_array("probability").alias("p"), vector_to_array("features").alias("x"), "label")
    off = [F.get("p", F.lit(c)) - F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in range(classes)]
    got = made.agg(*[F.avg(off[c] * (F.get("x", F.lit(j)) if j < size else F.lit(1.0))) for c in range(classes) for j in range(size + 1)]).first()
    slopes = [(c, j, v + (weights[c, j] / n if j < size else 0.0)) for (c, j), v in zip(((c, j) for c in range(classes) for j in range(size + 1)), got)]
    return spark.createDataFrame([(c, j, round(float(v), 2) + 0.0) for c, j, v in slopes], "class int, covariate int, slope double")


_BAYES = ", ".join([
    _SPLIT[:_SPLIT.index(", nn AS")],
    "nb AS (SELECT y, count(*) AS n, " + ", ".join(f"avg({x}) AS m_{x}, avg({x} * {x}) - avg({x}) * avg({x}) AS v_{x}" for x in ("x1", "x2", "x3")) + " FROM z WHERE NOT te GROUP BY y)",
    "ep AS (SELECT 1e-9 * greatest(var_pop(x1), var_pop(x2), var_pop(x3)) AS e, count(*) AS n FROM z WHERE NOT te)",
    "ll AS (SELECT k, z.y AS label, nb.y AS prediction, ln(nb.n / ep.n) - 0.5 * (" + " + ".join(f"ln(v_{x} + e) + ({x} - m_{x}) * ({x} - m_{x}) / (v_{x} + e)" for x in ("x1", "x2", "x3"))
    + ") AS score FROM z, nb, ep WHERE te)",
    "best AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, prediction) = 1)"])


@check("gaussian_naive_bayes", _BAYES + " SELECT 'GaussNB' AS name, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS score FROM best")
def gaussian_naive_bayes(spark, folder):
    return _model(spark, folder, "GaussNB")


@check("decision_tree")
def decision_tree(spark, folder):
    return _model(spark, folder, "tree")


@check("random_forest")
def random_forest(spark, folder):
    return _model(spark, folder, "RF")


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@check("spearman", f"WITH r AS (SELECT {_RANK.format(c='l_quantity')} AS a, {_RANK.format(c='l_extendedprice')} AS b FROM lineitem) "
       "SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, folder):
    return position.spearman(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


_SOME = "SELECT CASE WHEN l_quantity > 3 THEN l_quantity END AS a, CASE WHEN l_extendedprice < 50000 THEN l_extendedprice END AS b FROM lineitem"


def _some(spark, folder):
    return table(spark, folder, "lineitem").select(F.expr("CASE WHEN l_quantity > 3 THEN l_quantity END").alias("a"),
                                                   F.expr("CASE WHEN l_extendedprice < 50000 THEN l_extendedprice END").alias("b"))


@check("spearman_with_nulls", f"WITH s AS ({_SOME}), p AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL), "
       f"r AS (SELECT {_RANK.format(c='a')} AS a, {_RANK.format(c='b')} AS b FROM p) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_with_nulls(spark, folder):
    return position.spearman(_some(spark, folder), "a", "b").select(F.round("spearman", 6).alias("spearman"))


@check("average_rank_with_nulls", f"WITH s AS ({_SOME}), r AS (SELECT b, {_RANK.format(c='b')} AS rank FROM s WHERE b IS NOT NULL) "
       "SELECT b, rank FROM r UNION ALL SELECT NULL, NULL FROM s WHERE b IS NULL")
def average_rank_with_nulls(spark, folder):
    return position.average_rank(_some(spark, folder).select("b"), "b").select("b", "rank")


@check("average_rank", f"WITH {LINE_SQL} SELECT l_key, {_RANK.format(c='l_quantity')} AS rank FROM lines")
def average_rank(spark, folder):
    return position.average_rank(lineitem(spark, folder), "l_quantity").select("l_key", "rank")


@check("only_first_class", f"WITH {coded_sql('part', PART)} SELECT sum(p_type) = 0 AS first, sum(p_type * 0) = 0 AS zeroed FROM coded")
def only_first_class(spark, folder):
    df = coded(table(spark, folder, "part"), PART)
    return df.agg(F.lit(utility.only_first_class(df, "p_type")).alias("first"),
                  F.lit(utility.only_first_class(df.withColumn("p_type", F.lit(0)), "p_type")).alias("zeroed"))


@check("experiment_part")
def experiment_part(spark, folder):
    return experiment(C.project(table(spark, folder, "part"), PART), PART)


@check("experiment_tuned")
def experiment_tuned(spark, folder):
    """With a learned metric and cached vectors."""
    return experiment(C.project(table(spark, folder, "part"), PART), PART, tune=True, cache=new_path(spark, "vectors"))
