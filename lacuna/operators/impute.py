"""Filling holes from the nearest rows that have the cell observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lacuna.operators import coding
from lacuna.functions.holes import nan_as_null, q, unused
from lacuna.operators.embed import HashEncoder, hash_vectors, in_metric_space
from lacuna.operators.neighbors import PROFILE, nearest_cells, profiles, tag_rows, with_long_keys
from lacuna.roles import Roles
from lacuna.scratch import cut


def fill_value(values, feature: str, roles: Roles):
    """The fill of one cell from its donors' values (nearest first): mean or mode, whole if integer."""
    if feature in roles.continuous:
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
        return mean.cast("bigint").cast("double") if feature in roles.integer else mean
    # most frequent code, the lowest of equally frequent ones
    votes = F.transform(F.array_distinct(values), lambda v: F.struct(
        (-F.size(F.filter(values, lambda x: x == v))).alias("count"), v.alias("code")))
    return F.array_min(votes)["code"]


def merge_fills(tagged: DataFrame, found: DataFrame, roles: Roles) -> DataFrame:
    """Put the fills into the holes; observed cells stay as they are.

    All rows of a profile have the same holes and the same donors, so a fill is made once per
    profile and joined to its rows. The rows side of that join may be skewed, never the fills side.
    """
    donors = (found.groupBy(*PROFILE, "f")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]).alias("v"))
              .groupBy(*PROFILE).agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("donors")))
    fills = donors.select(*PROFILE, *[
        fill_value(F.element_at("donors", F.lit(i)), f, roles).alias(f"fill{i}") for i, f in enumerate(roles.features)])
    joined = tagged.select(*PROFILE, "key", "vals").join(fills, list(PROFILE), "left")
    return joined.select(F.col("key").alias(roles.key), *[
        _typed(F.coalesce(F.element_at("vals", i + 1), F.col(f"fill{i}")), f, roles).alias(f)
        for i, f in enumerate(roles.features)])


def _typed(value, feature: str, roles: Roles):
    return value.cast("int") if feature in roles.categorical else value


def fill_table(coded: DataFrame, roles: Roles, vector: str = "vec", k: int = 5, metric: str = "cosine", **tuning) -> DataFrame:
    """Impute a table of numbers and category codes that carries one vector per row.

    A single pass: fills never serve as donors. A feature without any observed cell stays NULL; NaN is a hole. The key may
    be of any type. Every row is kept, also those of a repeated or NULL key, which are rows like any other.
    """
    coded, restore = with_long_keys(nan_as_null(coded, roles.features), roles.key)
    table, metric = in_metric_space(coded, vector, metric)
    tagged = cut(tag_rows(table, roles.key, vector, roles.features), "rows", lean=True)
    groups = profiles(tagged, k)
    found = nearest_cells(groups, groups, k, metric, len(roles.features), **tuning)
    return restore(merge_fills(tagged, found, roles), roles.key)


def nearest_donors(coded: DataFrame, roles: Roles, vector: str = "vec", k: int = 5, metric: str = "cosine", **tuning) -> DataFrame:
    """The donors behind every fill: key, feature, rank, donor key, its value, distance."""
    coded, restore = with_long_keys(nan_as_null(coded, roles.features), roles.key)
    table, metric = in_metric_space(coded, vector, metric)
    tagged = cut(tag_rows(table, roles.key, vector, roles.features), "rows", lean=True)
    groups = profiles(tagged, k)
    found = nearest_cells(groups, groups, k, metric, len(roles.features), **tuning)
    names = F.array(*[F.lit(f) for f in roles.features])
    return restore(tagged.select(*PROFILE, F.col("key").alias("row_id")).join(found, list(PROFILE)).select(
        F.col("row_id").alias(roles.key), F.element_at(names, F.col("f") + 1).alias("feature"), "rank",
        F.col("key").alias("donor_id"), "value", "dist"), roles.key, "donor_id")


def impute(df: DataFrame, roles: Roles, k: int = 5, metric: str = "cosine", encoder: HashEncoder = HashEncoder(),
           vector: str | None = None, decode: bool = True, **tuning) -> DataFrame:
    """Fill every hole of ``df``: key and features, categories as in the input.

    ``vector`` names a column with the user's own row vectors; without it the hashing encoder is used.
    """
    types = {f: df.schema[f].dataType for f in roles.features}
    df = nan_as_null(df, roles.features)
    if vector is None:
        vector = unused(df, "__vec")
        df = hash_vectors(df, roles, encoder, vector)
    dimension = coding.build_dimension(df, roles.categorical) if roles.categorical else None
    coded = coding.encode(df, dimension, roles.categorical) if dimension is not None else df
    filled = fill_table(coded, roles, vector, k, metric, **tuning)
    if not decode or dimension is None:
        return filled
    filled = coding.decode(filled, dimension, roles.categorical, types)
    return filled.select(roles.key, *[q(f) for f in roles.features])
