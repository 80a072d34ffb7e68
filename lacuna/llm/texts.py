"""Helpers of the text operators: streaming over whole texts, word rules, keyed random order."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.scratch import cut

#: Texts handed to one call, in characters; a single longer text is a call of its own.
SLICE_CHARS = 4_000_000

#: Words between ASCII white space, as a regular expression both Python and Java read alike.
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"


def slices(batch: pa.RecordBatch, chars: pa.Array) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch that hold about SLICE_CHARS each, so memory follows one text at most."""
    start = total = 0
    for i, n in enumerate(chars.to_pylist()):
        if total and total + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def by_text(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list[str]], dict]], added: str) -> DataFrame:
    """Columns ``keep`` of every row and the columns ``added`` that a function of the texts gives.

    ``make()`` runs once per task and returns that function: a list of texts in, a list per added
    column out. A null text is the empty text. Other columns of ``df`` are left out, so none can clash.
    """
    kept = StructType([df.schema[k] for k in keep])
    extra = StructType.fromDDL(added)
    out = StructType([*kept, *extra])
    rows = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches):
        work, arrow = make(), to_arrow_schema(out)
        for batch in batches:
            texts = batch.column(len(keep))
            for part in slices(batch, pc.utf8_length(texts)):
                columns = work(part.column(len(keep)).to_pylist())
                made = [pa.array(columns[f.name], arrow.field(f.name).type) for f in extra]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema=arrow)

    return rows.mapInArrow(run, out)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def per_worker(key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` gives, kept by the Python worker for its later tasks. Only speed depends on it."""
    kept = sys.modules.setdefault("_lacuna_kept", types.ModuleType("_lacuna_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def with_place(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``__file`` and ``__place``, which tell all rows apart, equal ones too, and are the same whenever the result is read.

    Rows read from Parquet files, also filtered or with columns left out, are named by their place in the file. Any other table
    is written once.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    place = F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place")
    if node.nodeName() == "LogicalRelation":
        try:
            return df.select("*", *place)
        except AnalysisException:  # files of another kind
            pass
    return cut(df, label).select("*", *place)


#: Bits of a filter for each value, and the least and the most of all: 2**29 bits are 64 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29

PAGE_BITS = 1 << 15


def bitmap(values: DataFrame, hashed: str, n: int) -> tuple[DataFrame, int]:
    """A filter in which the hashes of ``n`` values set a bit each, as a table of pages of 4 KB, and its number of bits: BITS_EACH per
    value, within LEAST_BITS and MOST_BITS."""
    bits = min(max(LEAST_BITS, 1 << (max(1, BITS_EACH * n) - 1).bit_length()), MOST_BITS)
    low = (F.col(hashed).bitwiseAND(F.lit(bits - 1)) + 1).alias("low")
    return values.select(low).groupBy(F.bitmap_bucket_number("low").alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("low")).alias("__bits")), bits


def with_passed(df: DataFrame, hashed: Column, pages: DataFrame, bits: int, out: str) -> DataFrame:
    """``df`` with ``out``, false where the filter of ``bitmap`` surely lacks the hash. The filter has a fixed largest size, so every task gets it."""
    low = hashed.bitwiseAND(F.lit(bits - 1))
    page, at = F.call_function("shiftright", low, F.lit(15)) + 1, low.bitwiseAND(F.lit(PAGE_BITS - 1))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1))
    joined = df.join(F.broadcast(pages), page == F.col("__page"), "left")
    return joined.select(*df.columns, F.coalesce(bit == 1, F.lit(False)).alias(out))
