"""Rows as text and text as rows: native column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lacuna.functions.holes import known
from lacuna.functions.randomness import digest
from lacuna.roles import Roles

# The two mask tokens and the token limit of the text encoders
MASK_TOKEN = "[MASK]"
UNKNOWN_TOKEN = "[UNK]"
MAX_TOKENS = 512

ENCODINGS = ("tab2text", "tab2json", "tab2num")


def number_text(col: Column) -> Column:
    """A number as plain decimal text: six places at most, no trailing zeros, no exponent."""
    fixed = col.try_cast("decimal(38,6)").cast("string")
    return F.coalesce(F.regexp_replace(fixed, r"\.?0+$", ""), col.cast("string"))


def value_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return number_text(known(df, name)) if isinstance(kind, T.NumericType) else F.col(f"`{name}`").cast("string")


def cell_text(df: DataFrame, name: str, token: str = MASK_TOKEN) -> Column:
    """Text of a cell, the mask token where it is a hole."""
    return F.coalesce(value_text(df, name), F.lit(token))


def fields(df: DataFrame, roles: Roles, token: str = MASK_TOKEN, permute_seed: int | None = None) -> Column:
    """The row as an array of (name, value), in role order or in a keyed random order."""
    items = []
    for f in roles.features:
        parts = [F.lit(f).alias("name"), cell_text(df, f, token).alias("value")]
        if permute_seed is not None:
            parts.insert(0, digest(F.col(roles.key), f, "permute", permute_seed).alias("rank"))
        items.append(F.struct(*parts))
    array = F.array(*items)
    if permute_seed is None:
        return array
    return F.transform(F.array_sort(array), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def fields_to_sentence(items: Column) -> Column:
    def clean(c):
        return F.replace(c, F.lit(","), F.lit(""))

    return F.concat_ws(", ", F.transform(
        items, lambda x: F.concat(clean(x["name"]), F.lit(" is "), clean(F.trim(x["value"])))))


def fields_to_values(items: Column) -> Column:
    return F.concat_ws(", ", F.transform(items, lambda x: x["value"]))


def fields_to_json(items: Column) -> Column:
    """An object in the order of the fields; a map would lose it only for repeated names."""
    return F.to_json(F.map_from_entries(items))


def encode_rows(df: DataFrame, roles: Roles, encoding: str = "tab2text", *,
                token: str = MASK_TOKEN, permute_seed: int | None = None, out: str = "text") -> DataFrame:
    """key + one text per row, in one of the three encodings."""
    writers = dict(zip(ENCODINGS, (fields_to_sentence, fields_to_json, fields_to_values)))
    if encoding not in writers:
        raise ValueError(f"unknown encoding {encoding!r}, one of {ENCODINGS}")
    return df.select(roles.key, writers[encoding](fields(df, roles, token, permute_seed)).alias(out))


def parse_sentence(text: Column) -> Column:
    """'a is 1, b is x' as a map; numbers are printed in the same form as in the anchor text."""
    pairs = F.transform(F.split(text, ", "), lambda item: F.split(item, " is ", 2))
    return F.map_from_entries(F.transform(
        pairs, lambda p: F.struct(
            F.element_at(p, 1).alias("name"),
            F.coalesce(number_text(F.element_at(p, 2).try_cast("double")), F.element_at(p, 2)).alias("value"))))


def format_map(parsed: Column) -> Column:
    return F.concat_ws(", ", F.transform(
        F.map_entries(parsed), lambda e: F.concat(e["key"], F.lit(" is "), e["value"])))


def truncate_tokens(text: Column, limit: int = MAX_TOKENS) -> Column:
    """The first ``limit`` whitespace-separated tokens, as the encoders' token limit does."""
    return F.concat_ws(" ", F.slice(F.split(F.trim(text), r"\s+"), 1, limit))
