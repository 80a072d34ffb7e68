"""Seeded randomness keyed by content, so it never depends on partitioning or retries."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

# 2**32: eight hexadecimal digits of a digest, read as a share of this
SPAN = 4294967296.0


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '|'. Plain strings and numbers are literals; columns hold no NULL."""
    pieces, plain = [], []
    for i, p in enumerate(parts):
        if i:
            plain.append("|")
        if isinstance(p, Column):
            if plain:
                pieces.append(F.lit("".join(plain)))
            pieces.append(p.cast("string"))
            plain = []
        else:
            plain.append(str(p))
    if plain:
        pieces.append(F.lit("".join(plain)))
    return F.md5(F.concat(*pieces))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that is a function of the parts alone."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(SPAN)


def uniform_below(share: float, *parts: Column | str | int) -> Column:
    """``uniform(*parts) < share``, decided on the digits without making a number of them."""
    limit = math.ceil(share * SPAN)
    if limit <= 0 or limit >= SPAN:
        return F.lit(limit > 0)
    return F.substring(digest(*parts), 1, 8) < F.lit(f"{limit:08x}")


def cell_uniform(key: Column, feature: str, salt: str, seed: int) -> Column:
    return uniform(key, feature, salt, seed)


def pick_names(names, count: int, salt: str, seed: int) -> list[str]:
    """``count`` names without replacement, in the order of their digests."""
    def rank(name):
        return hashlib.md5(f"{name}|{salt}|{seed}".encode()).hexdigest()

    return sorted(names, key=rank)[:count]


def normal_weights(rows: int, columns: int, seed: int) -> list[list[float]]:
    """Standard normal weights as plain numbers, to be put into the plan as literals."""
    return np.random.default_rng(seed).standard_normal((rows, columns)).tolist()


def truncated_poisson_table(max_count: int) -> list[list[float]]:
    """Row r: P(X <= k), k = 1..max_count, of a Poisson at rate r/2 given X >= 1."""
    table = [[1.0] * max_count]
    for observed in range(1, max_count + 1):
        rate = observed / 2
        term = rate * math.exp(-rate) / -math.expm1(-rate)
        total, row = 0.0, []
        for k in range(1, max_count + 1):
            total += term
            row.append(total)
            term *= rate / (k + 1)
        table.append(row)
    return table


def truncated_poisson(u: Column, observed: Column, max_count: int) -> Column:
    """Zero-truncated Poisson draw at rate observed/2 by inversion, at most ``observed``.

    Rate 0 gives 1, which the cap turns into 0.
    """
    table = F.array(*[F.array(*[F.lit(p) for p in row]) for row in truncated_poisson_table(max_count)])
    row = F.element_at(table, observed.cast("int") + 1)
    below = F.size(F.filter(row, lambda p: p < u))
    return F.least(below + 1, observed).cast("int")


def poisson_draw(u: Column, rate: Column, cap: int) -> Column:
    """Zero-truncated Poisson draw at any rate by inversion, at most ``cap``."""
    first = rate * F.exp(-rate) / (1 - F.exp(-rate))
    start = F.struct(
        F.lit(1).alias("k"), first.alias("term"), first.alias("total"),
    )

    def step(acc, i):
        more = acc["total"] < u
        term = acc["term"] * rate / (i + 1)
        return F.struct(
            F.when(more, i + 1).otherwise(acc["k"]).alias("k"),
            term.alias("term"),
            F.when(more, acc["total"] + term).otherwise(acc["total"]).alias("total"),
        )

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(cap - 1)), start, step, lambda acc: acc["k"]) if cap > 1 else F.lit(1)
    return F.when(rate <= 0, F.lit(1)).otherwise(drawn)
