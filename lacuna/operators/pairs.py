"""Contrastive triples of row texts: anchor, positive (more cells hidden), negative (a row mate's positive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lacuna.functions.holes import q
from lacuna.functions.randomness import digest, truncated_poisson, uniform
from lacuna.functions.text import (
    MASK_TOKEN, fields, fields_to_json, fields_to_sentence, fields_to_values,
)
from lacuna.operators.position import with_batch
from lacuna.roles import Roles
from lacuna.scratch import cut

# Fields hidden in value-only texts, and rows per batch
VALUES_HIDDEN = 3
BATCH_SIZE = 16


def _hide(items: Column, chosen: Column, token: str) -> Column:
    return F.transform(items, lambda x: F.struct(
        x["name"].alias("name"),
        F.when(F.array_contains(chosen, x["name"]), F.lit(token)).otherwise(x["value"]).alias("value")))


def _chosen(items: Column, key: Column, count: Column, token: str, salt: str, seed: int) -> Column:
    """Names of ``count`` observed fields, in the order of their digests."""
    observed = F.filter(items, lambda x: x["value"] != token)
    ranked = F.array_sort(F.transform(observed, lambda x: F.struct(
        digest(key, x["name"], salt, seed).alias("rank"), x["name"].alias("name"))))
    return F.transform(F.slice(ranked, 1, count), lambda x: x["name"])


def observed_count(items: Column, token: str) -> Column:
    return F.size(F.filter(items, lambda x: x["value"] != token))


def remask(items: Column, key: Column, width: int, seed: int, token: str = MASK_TOKEN, salt: str = "remask") -> Column:
    """Hide further observed fields: their number is a zero-truncated Poisson draw at half the observed."""
    observed = observed_count(items, token)
    count = truncated_poisson(uniform(key, salt + "-count", seed), observed, width)
    return _hide(items, _chosen(items, key, count, token, salt, seed), token)


def remask_fixed(items: Column, key: Column, seed: int, token: str = MASK_TOKEN,
                 count: int = VALUES_HIDDEN, salt: str = "remask") -> Column:
    """Hide ``count`` further observed fields, or all there are."""
    return _hide(items, _chosen(items, key, F.lit(count), token, salt, seed), token)


def usable_batches(positives: DataFrame) -> DataFrame:
    """Batches of more than one row whose positives are not all equal."""
    return (positives.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("positive").alias("n_distinct"))
            .where("n_distinct > 1"))


def with_negatives(positives: DataFrame, key: str, seed: int) -> DataFrame:
    """Per batch a keyed random order of its positives; turned by one place if it changes nothing.

    Groups are mini-batches, so the lists have at most the batch size. Batches without two different
    positives drop out: no order of theirs could differ.
    """
    rank = digest(F.col(key), "negative", seed)
    grouped = positives.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col(key).alias("key"), rank.alias("rank"), "anchor", "positive"))).alias("rows"))
    plain = F.transform("rows", lambda r: r["positive"])
    mixed = F.transform(F.array_sort(F.transform("rows", lambda r: F.struct(r["rank"], r["positive"]))), lambda r: r["positive"])
    listed = grouped.select("batch_id", "rows", plain.alias("plain"), mixed.alias("mixed"))
    turned = F.concat(F.slice("plain", 2, F.size("plain")), F.slice("plain", 1, 1))
    listed = listed.where(F.size(F.array_distinct("plain")) > 1).select(
        "batch_id", "rows", F.when(F.col("mixed") != F.col("plain"), F.col("mixed")).otherwise(turned).alias("negatives"))
    return listed.select("batch_id", F.posexplode(F.arrays_zip("rows", "negatives")).alias("i", "e")).select(
        "batch_id", F.col("e.rows.key").alias(key), F.col("e.rows.anchor").alias("anchor"),
        F.col("e.rows.positive").alias("positive"), F.col("e.negatives").alias("negative"))


def positives(df: DataFrame, roles: Roles, encoding: str = "tab2text", *, token: str = MASK_TOKEN,
              seed: int = 0, batch_size: int = BATCH_SIZE, epoch: int = 0) -> DataFrame:
    """batch_id, key, anchor, positive. Another epoch keeps the batches and draws anew."""
    salt = "remask" if epoch == 0 else f"remask{epoch}"
    writers = {"tab2text": fields_to_sentence, "tab2json": fields_to_json, "tab2num": fields_to_values}
    if encoding not in writers:
        raise ValueError(f"unknown encoding {encoding!r}, one of {tuple(writers)}")
    # rows are put in order before their texts are made, so texts are neither sampled nor sorted, and are made by as many tasks as the sort has
    placed = with_batch(df.select(roles.key, *[q(f) for f in roles.features]), roles.key, batch_size)
    rows = placed.select("batch_id", roles.key, fields(placed, roles, token).alias("items"))
    key, items = F.col(roles.key), F.col("items")
    hidden = (remask_fixed(items, key, seed, token, salt=salt) if encoding == "tab2num"
              else remask(items, key, len(roles.features), seed, token, salt))
    write = writers[encoding]
    return rows.select("batch_id", roles.key, write(items).alias("anchor"), write(hidden).alias("positive"))


def contrastive_pairs(df: DataFrame, roles: Roles, encoding: str = "tab2text", *, token: str = MASK_TOKEN,
                      seed: int = 0, batch_size: int = BATCH_SIZE, epoch: int = 0) -> DataFrame:
    """batch_id, key, anchor, positive, negative over all usable batches."""
    made = positives(df, roles, encoding, token=token, seed=seed, batch_size=batch_size, epoch=epoch)
    return with_negatives(made, roles.key, seed + epoch)
