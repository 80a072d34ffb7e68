"""The bounded sample of labelled texts that classifiers are fitted on."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lacuna.llm.texts import with_place
from lacuna.scratch import cut, small_table


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5. Fold 0 is held out: its labels are never read."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)).cast("int")


#: A text of more than this part of the byte bound is passed over, so that a few long ones do not fill it.
SHARE = 16


def fit_on_labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, fit: Callable[[list[tuple[str, int]]], dict],
                    key: str = "doc_id", text: str = "text") -> dict:
    """What ``fit`` makes of (text, label) of at most ``rows`` labelled rows outside fold 0, of ``most_bytes`` in all.

    The rows are the first in a keyed random order, so they are the same in every run; texts are whole. A key gives
    one text, that of the smallest digest, and is taken once with each label it has. Null
    labels, keys without a text row, labels other than 0 and 1 and texts of more than ``most_bytes`` / SHARE are passed
    over, and later rows take their place. Labelled texts of which none can be taken are an error. One task fits on the
    bounded sample, and what it returns (plain values and arrays) goes to the driver.
    """
    order = F.md5(F.col(key).cast("string"))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(key)) != 0))
    known = known.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label"), order.alias("order")).distinct()
    placed = with_place(docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text")), "texts")
    sized = placed.select("__key", "__file", "__place", F.octet_length("text").alias("n"), F.xxhash64("text").alias("tie"))
    # one text of a key, so that a key held by many rows is one row before it is joined
    least = F.min(F.struct("tie", "__file", "__place", "n")).alias("least")
    short = sized.where(F.col("n") <= most_bytes // SHARE).groupBy("__key").agg(least).select("__key", "least.*")
    # the sample is bounded by ``rows`` and by bytes before any text is read
    first = short.join(known, "__key").orderBy("order", "label").limit(rows).select("order", "label", "__file", "__place", "n").collect()
    kept = [r for r, total in zip(first, accumulate(r["n"] for r in first)) if total <= most_bytes]
    if not kept:
        if not sized.join(known, "__key").isEmpty():
            raise ValueError(f"{label}: every labelled text has more than {most_bytes // SHARE} bytes")
        return fit([])
    types = {"order": pa.string(), "label": pa.int32(), "__file": pa.int64(), "__place": pa.int64()}
    chosen = small_table(docs.sparkSession, **{c: ([r[c] for r in kept], t) for c, t in types.items()})
    found = cut(placed.drop("__key").join(F.broadcast(chosen), ["__file", "__place"]).select("order", "label", "text"), "labelled")

    def run(batches):
        read = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(3)))]
        model = fit([(t, y) for _, y, t in sorted(read)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = found.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"])
