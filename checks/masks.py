"""Missingness mechanisms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import LINE_SQL, LINEITEM, PART, check, coded, coded_sql, lineitem, table, u_sql
from lacuna.functions.randomness import normal_weights, pick_names
from lacuna.operators import ampute as A
from lacuna.operators import cells as C

CODED = coded_sql("part", PART)
RATE = 0.3


def _mask_sql(source: str, roles, conditions: dict[str, str]) -> str:
    columns = ", ".join(f"coalesce({conditions.get(f, 'false')}, false) AS {f}" for f in roles.features)
    return f"SELECT {roles.key}, {columns} FROM {source}"


def _u(f, salt, key="p_partkey"):
    return u_sql(key, repr(f), repr(salt), 0)


def _part(spark, folder):
    return coded(table(spark, folder, "part"), PART)


@check("mask_mcar", f"WITH {LINE_SQL} " + _mask_sql("lines", LINEITEM, {f: f"{_u(f, 'mcar', 'l_key')} < 0.3" for f in LINEITEM.features}))
def mask_mcar(spark, folder):
    df = lineitem(spark, folder)
    return C.mask_table(df, LINEITEM, A.mcar(LINEITEM, RATE, 0))


def _logit_ctes(raw: dict[str, str]) -> str:
    """raw scores -> z (standardised), long scores, bisection for the intercepts, b per column."""
    names = list(raw)
    z = ", ".join(f"(r{i} - (SELECT avg(r{i}) FROM raw)) / (SELECT stddev_samp(r{i}) FROM raw) AS z{i}" for i in range(len(names)))
    long = " UNION ALL ".join(f"SELECT {i} AS j, z{i} AS z FROM zs" for i in range(len(names)))
    return (f"raw AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS r{i}' for i, e in enumerate(raw.values()))} FROM coded), "
            f"zs AS MATERIALIZED (SELECT *, {z} FROM raw), zl AS MATERIALIZED ({long}), "
            "bis(it, j, lo, hi) AS (SELECT 0, j, -60.0::DOUBLE, 60.0::DOUBLE FROM (SELECT DISTINCT j FROM zl) UNION ALL "
            f"SELECT it + 1, j, CASE WHEN m < {RATE} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m < {RATE} THEN hi ELSE (lo + hi) / 2 END "
            "FROM (SELECT b.it, b.j, b.lo, b.hi, avg(1 / (1 + exp(-(zl.z + (b.lo + b.hi) / 2)))) AS m "
            "FROM bis AS b JOIN zl ON zl.j = b.j WHERE b.it < 52 GROUP BY b.it, b.j, b.lo, b.hi)), "
            "fit AS MATERIALIZED (SELECT j, (lo + hi) / 2 AS b FROM bis WHERE it = 52)")


def _hit(f: str, i: int, salt: str) -> str:
    return f"{_u(f, salt)} < 1 / (1 + exp(-(z{i} + (SELECT b FROM fit WHERE j = {i}))))"


def _sum_sql(inputs, weights) -> str:
    return " + ".join(f"{n}::DOUBLE * ({w!r})" for n, w in zip(inputs, weights))


def _logistic(inputs, targets) -> dict[str, str]:
    w = normal_weights(len(inputs), len(targets), 0)
    return {t: _sum_sql(inputs, [row[j] for row in w]) for j, t in enumerate(targets)}


_MAR_IN, _MAR_OUT = A.logistic_inputs(PART, A.OBSERVED_SHARE, 0, "mar")
_MAR = f"WITH RECURSIVE {CODED}, {_logit_ctes(_logistic(_MAR_IN, _MAR_OUT))} "


@check("mask_mar", _MAR + _mask_sql("zs", PART, {f: _hit(f, i, "mar") for i, f in enumerate(_MAR_OUT)}))
def mask_mar(spark, folder):
    df = _part(spark, folder)
    return C.mask_table(df, PART, A.mar(df, PART, RATE, 0))


_NL_IN, _NL_OUT = A.logistic_inputs(PART, A.OBSERVED_SHARE, 0, "mnarl")
_NL = f"WITH RECURSIVE {CODED}, {_logit_ctes(_logistic(_NL_IN, _NL_OUT))} "


@check("mask_mnar_logistic", _NL + _mask_sql("zs", PART, {
    **{f: _hit(f, i, "mnarl") for i, f in enumerate(_NL_OUT)}, **{f: f"{_u(f, 'mnarl-inputs')} < {RATE}" for f in _NL_IN}}))
def mask_mnar_logistic(spark, folder):
    df = _part(spark, folder)
    return C.mask_table(df, PART, A.mnar_logistic(df, PART, RATE, 0))


_ALL = f"WITH RECURSIVE {CODED}, {_logit_ctes(_logistic(PART.features, PART.features))} "


@check("mask_mnar_logistic_all_inputs", _ALL + _mask_sql("zs", PART, {f: _hit(f, i, "mnarl") for i, f in enumerate(PART.features)}))
def mask_mnar_logistic_all_inputs(spark, folder):
    df = _part(spark, folder)
    return C.mask_table(df, PART, A.mnar_logistic(df, PART, RATE, 0, exclude_inputs=False))


_SELF_W = normal_weights(1, len(PART.features), 0)[0]
_SELF = f"WITH RECURSIVE {CODED}, " + _logit_ctes({f: f"{f}::DOUBLE * ({w!r})" for f, w in zip(PART.features, _SELF_W)}) + " "


@check("mask_mnar_self", _SELF + _mask_sql("zs", PART, {f: _hit(f, i, "self") for i, f in enumerate(PART.features)}))
def mask_mnar_self(spark, folder):
    df = _part(spark, folder)
    return C.mask_table(df, PART, A.mnar_self(df, PART, RATE, 0))


@check("fitted_intercepts", _ALL + "SELECT " + "CASE j " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(PART.features))
       + " END AS feature, round(b, 6) AS intercept FROM fit")
def fitted_intercepts(spark, folder):
    df = _part(spark, folder)
    w = normal_weights(4, 4, 0)
    raw = {t: A.weighted_sum(PART.features, [row[j] for row in w]) for j, t in enumerate(PART.features)}
    fitted = A.fit_intercepts(df, A.unit_scores(df, raw), RATE)
    return spark.createDataFrame([(f, round(b, 6)) for f, b in fitted.items()], "feature string, intercept double")


@check("unit_variance_scores", f"WITH {CODED}, raw AS (SELECT *, " + ", ".join(
    f"{e} AS r{i}" for i, e in enumerate(_logistic(_MAR_IN, _MAR_OUT).values())) + " FROM coded) SELECT p_partkey, " + ", ".join(
    f"round((r{i} - (SELECT avg(r{i}) FROM raw)) / (SELECT stddev_samp(r{i}) FROM raw), 6) AS {f}" for i, f in enumerate(_MAR_OUT)) + " FROM raw")
def unit_variance_scores(spark, folder):
    df = _part(spark, folder)
    w = normal_weights(len(_MAR_IN), len(_MAR_OUT), 0)
    scores = A.unit_scores(df, {t: A.weighted_sum(_MAR_IN, [row[j] for row in w]) for j, t in enumerate(_MAR_OUT)})
    return df.select("p_partkey", *[F.round(c, 6).alias(t) for t, c in scores.items()])


def _nth(f: str, share: float, source: str) -> str:
    return f"(SELECT {f} FROM {source} ORDER BY {f} LIMIT 1 OFFSET (SELECT floor({share} * count(*))::INT - 1 FROM {source}))"


def _quantile_sql(cut_at: str, overlay: bool = False) -> str:
    chosen = pick_names(LINEITEM.features, max(int((1 - A.OBSERVED_SHARE) * len(LINEITEM.features)), 1), "mnarq", 0)
    conditions = {}
    for f in LINEITEM.features:
        parts = []
        if f in chosen:
            lower = f"{f} <= {_nth(f, A.QUANTILE, 'coded')}"
            upper = f"{f} >= {_nth(f, 1 - A.QUANTILE, 'coded')}"
            tail = {"lower": lower, "upper": upper, "both": f"({lower} OR {upper})"}[cut_at]
            parts.append(f"({_u(f, 'mnarq', 'l_key')} < {RATE} AND {tail})")
        if overlay:
            parts.append(f"{_u(f, 'mnarq-overlay', 'l_key')} < {RATE}")
        if parts:
            conditions[f] = "(" + " OR ".join(parts) + ")"
    return f"WITH {LINE_SQL}, {coded_sql('lines', LINEITEM)} " + _mask_sql("coded", LINEITEM, conditions)


def _quantile(spark, folder, **options):
    df = coded(lineitem(spark, folder), LINEITEM)
    return C.mask_table(df, LINEITEM, A.mnar_quantile(df, LINEITEM, RATE, 0, **options))


@check("mask_mnar_quantile_both", _quantile_sql("both"))
def mask_mnar_quantile_both(spark, folder):
    return _quantile(spark, folder)


@check("mask_mnar_quantile_upper", _quantile_sql("upper"))
def mask_mnar_quantile_upper(spark, folder):
    return _quantile(spark, folder, cut_at="upper")


@check("mask_mnar_quantile_lower", _quantile_sql("lower"))
def mask_mnar_quantile_lower(spark, folder):
    return _quantile(spark, folder, cut_at="lower")


@check("mask_mnar_quantile_overlay", _quantile_sql("both", overlay=True))
def mask_mnar_quantile_overlay(spark, folder):
    return _quantile(spark, folder, overlay=True)


@check("ampute_by_name", f"WITH RECURSIVE {CODED}, {_logit_ctes(_logistic(_MAR_IN, _MAR_OUT))} SELECT p_partkey, " + ", ".join(
    f"CASE WHEN {_hit(f, _MAR_OUT.index(f), 'mar')} THEN NULL ELSE {f} END AS {f}" if f in _MAR_OUT else f for f in PART.features) + " FROM zs")
def ampute_by_name(spark, folder):
    return A.ampute(_part(spark, folder), PART, "MAR", RATE, 0)
