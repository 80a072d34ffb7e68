"""Seeded split of exact size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions.randomness import uniform
from lacuna.operators.position import order_statistics
from lacuna.roles import Roles


def test_rule(df: DataFrame, key: str, test_size: float, seed: int) -> Column:
    """The condition that a row is a test row; ceil(test_size * n) rows fulfil it.

    The rows with the smallest keyed uniforms are taken, lowest key first among equals.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    u = uniform(F.col(key), "split", seed)
    n = df.count()
    take = math.ceil(test_size * n)
    if take >= n:
        raise ValueError("the training part would be empty")
    limit = order_statistics(df, {"u": (u, [take])})["u"][0]
    ties = df.where(u == limit)
    below, equal = df.agg(F.count_if(u < limit), F.count_if(u == limit)).first()
    if below + equal == take:
        return u <= limit
    # distinct keys whose 32-bit uniforms agree: a handful
    last = ties.select(key).orderBy(key).limit(take - below).agg(F.max(key)).first()[0]
    return (u < limit) | ((u == limit) & (F.col(key) <= F.lit(last)))


def train_test_split(df: DataFrame, roles: Roles, test_size: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    rule = test_rule(df, roles.key, test_size, seed)
    return df.where(~rule), df.where(rule)
