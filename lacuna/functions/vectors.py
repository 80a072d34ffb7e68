"""Vector arithmetic on array columns, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRICS = ("cosine", "manhattan", "chebyshev", "correlation", "mahalanobis", "euclidean")


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return dot(a, a)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    scale = norm2(a) * norm2(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(scale))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y))))


def center(a: Column) -> Column:
    mean = _sum(_wide(a)) / F.size(a)
    return F.transform(_wide(a), lambda x: x - mean)


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - Pearson; infinite when either vector is constant, so such pairs come last."""
    flat = (F.array_max(a) == F.array_min(a)) | (F.array_max(b) == F.array_min(b))
    return F.when(flat, F.lit(float("inf"))).otherwise(1 - cosine_similarity(center(a), center(b)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The named distance of two array columns. Mahalanobis is Euclidean after projection."""
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    known = {"manhattan": manhattan, "chebyshev": chebyshev, "euclidean": euclidean,
             "mahalanobis": euclidean, "correlation": correlation_distance}
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}, one of {METRICS}")
    return known[metric](a, b)


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def first_token(token_vectors: Column) -> Column:
    return F.element_at(token_vectors, 1)


def mean_tokens(token_vectors: Column, attention: Column | None = None) -> Column:
    """Mean over the tokens; with ``attention`` (0/1 per token) padding is left out."""
    if attention is not None:
        kept = F.filter(F.arrays_zip(token_vectors.alias("v"), attention.alias("m")), lambda t: t["m"] != 0)
        token_vectors = F.transform(kept, lambda t: t["v"])
    wide = token_vectors.cast("array<array<double>>")
    total = F.aggregate(
        F.slice(wide, 2, F.greatest(F.size(wide) - 1, F.lit(0))), F.element_at(wide, 1),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(wide))


def narrow(v: Column) -> Column:
    return v.cast("array<float>")


def density_ratio_logit(hx: Column, hu: Column, a_weights, a_bias: float, b_weights, b_bias: float) -> Column:
    """r(x, u) = <h_x, h_u> + a(h_x) + b(h_u), a and b affine."""
    return (dot(hx, hu)
            + dot(hx, literal_vector(a_weights)) + F.lit(float(a_bias))
            + dot(hu, literal_vector(b_weights)) + F.lit(float(b_bias)))


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    """Per-row loss of a logit, stable for large values of either sign."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
