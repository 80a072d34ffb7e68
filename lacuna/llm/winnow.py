"""Benchmark decontamination by winnowing: fingerprints, a join on them, and extension of every hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.llm.texts import slices
from lacuna.scratch import cut

#: A window is this many words, a fingerprint covers GRAM of them. Every WINDOW - GRAM + 1 grams in a
#: row keep their smallest hash, so any WINDOW shared words share a kept fingerprint.
WINDOW, GRAM = 10, 5

#: Bits of the filter that the benchmark's fingerprints set: 2**24 bits are 2 MB whatever its size.
FILTER_BITS = 24

#: Words remembered per task; only speed depends on it.
MEMORY = 500_000

# the word rule on UTF-8 bytes: A-Z lowered, other ASCII but digits and letters is space
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Hashes(dict):
    """Word to 64-bit hash, computed once per distinct word."""

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, salt, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + words[j : j + count]
    return mixed(h)


def kept_grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are smallest in some ``width`` consecutive grams; all of equal smallest ones."""
    windows = len(hashes) - width + 1
    if windows <= 0:
        return np.empty(0, np.int64)
    least = hashes[:windows].copy()
    for j in range(1, width):
        np.minimum(least, hashes[j : j + windows], out=least)
    keep = np.zeros(len(hashes), bool)
    for j in range(width):
        keep[j : j + windows] |= hashes[j : j + windows] == least
    return np.flatnonzero(keep)


def fingerprints(words: list[bytes], memory: Hashes, short: list[int], known) -> list[tuple]:
    """(length, hash, position, words on the left, gram, words on the right) of kept grams that ``known`` lets pass."""
    ids = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    out = []
    for length in [WINDOW, *short]:
        # a short item is one gram of its own length, and its hash is salted by that length
        n = GRAM if length == WINDOW else length
        hashes = gram_hashes(ids, n, length)
        at = kept_grams(hashes, WINDOW - GRAM + 1) if length == WINDOW else np.arange(len(hashes))
        at = at[known(hashes[at])]
        reach = WINDOW - n if length == WINDOW else 0
        for p in at.tolist():
            out.append((length, int(hashes[p].view(np.int64)), p, b" ".join(words[max(0, p - reach) : p]),
                        b" ".join(words[p : p + n]), b" ".join(words[p + n : p + n + reach])))
    return out


POINTS = "length int, hash bigint, at int, left binary, gram binary, right binary"


def _points(df: DataFrame, key: str, text: str, short: list[int], known_bits) -> DataFrame:
    """``id``, ``row``, ``n_words`` and ``points`` of every row; ``row`` tells rows with equal keys apart."""
    out = StructType.fromDDL(f"id {df.schema[key].dataType.simpleString()}, row string, n_words bigint, points array<struct<{POINTS.replace(' ', ':').replace(',:', ',')}>>")
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        types, memory, done, task = to_arrow_schema(out), Hashes(), 0, TaskContext.get().partitionId()
        bits = None if known_bits is None else np.frombuffer(known_bits.value, np.uint8)

        def known(h):
            if bits is None:
                return np.ones(len(h), bool)
            low = h & np.uint64((1 << FILTER_BITS) - 1)
            return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for part in slices(batch, pc.utf8_length(batch.column(1))):
                names, counts, points = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    lengths = short if bits is not None else [len(words)] if 0 < len(words) < WINDOW else []
                    found = fingerprints(words, memory, lengths, known) if words else []
                    names.append(f"{task}-{done}")
                    counts.append(len(words))
                    points.append([dict(zip(("length", "hash", "at", "left", "gram", "right"), f)) for f in found])
                    done += 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(counts, pa.int64()),
                                                  pa.array(points, types.field("points").type)], schema=types)

    return rows.mapInArrow(run, out)


def _filter(items: DataFrame):
    """The fingerprints of ``items`` as a bitmap of fixed size, built by Spark's bitmap aggregate."""
    low = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    parts = (items.select(low.alias("low")).groupBy(F.bitmap_bucket_number("low").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("low")).alias("bits")).collect())
    whole = bytearray(1 << (FILTER_BITS - 3))  # at most 2**(FILTER_BITS - 15) rows of 4 KB
    for r in parts:
        start = (r["bucket"] - 1) * 4096
        whole[start : start + 4096] = r["bits"]
    return items.sparkSession.sparkContext.broadcast(bytes(whole))


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _extended(pairs: DataFrame, id_type: str, item_type: str) -> DataFrame:
    """Pairs of equal fingerprints, extended word by word to the left and right; spans of whole windows stay."""
    out = StructType.fromDDL(f"id {id_type}, row string, item {item_type}, first bigint, last bigint")

    def run(batches):
        types = to_arrow_schema(out)
        for batch in batches:
            at, firsts, lasts = [], [], []
            columns = [batch.column(n).to_pylist() for n in ("length", "at", "left", "gram", "right", "i_left", "i_gram", "i_right")]
            for i, (length, p, left, gram, right, i_left, i_gram, i_right) in enumerate(zip(*columns)):
                if gram != i_gram:
                    continue
                n = len(gram.split())
                before = _common(left.split()[::-1], i_left.split()[::-1])
                after = _common(right.split(), i_right.split())
                if before + n + after >= length:
                    at.append(i)
                    firsts.append(p - before)
                    lasts.append(p + n + after)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("row"), kept.column("item"),
                                              pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())], schema=types)

    return pairs.mapInArrow(run, out)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): a row per document row, and the word spans shared with benchmark items.

    documents: ``id``, ``row``, ``n_words``, ``n_hit`` (words inside a shared window), ``items`` (sorted
    item ids as strings). spans: ``id``, ``row``, ``item``, ``first``, ``last`` (end exclusive), merged by nobody, so
    they may overlap. Windows are WINDOW words; an item of fewer words is one window; null and
    empty texts have none. Null document keys are kept; windows of an item without id are hits without a name; equal
    rows stay separate; empty tables give no hits.

    The benchmark's fingerprints set bits in a filter of fixed size, through which documents pass
    only what may match; the filter decides nothing. The rest meets the benchmark by a join on the hash,
    which Spark may split if one passage is in a third of all documents.
    """
    id_type, item_type = (d.schema[k].dataType.simpleString() for d, k in ((docs, key), (items, item_key)))
    points = _points(items, item_key, item_text, [], None).select(F.col("id").alias("item"), F.explode("points").alias("p"))
    theirs = cut(points.select("item", "p.length", "p.hash", *[F.col(f"p.{c}").alias(f"i_{c}") for c in ("left", "gram", "right")]).distinct(), "benchmark")
    short = sorted(r[0] for r in theirs.where(F.col("length") < WINDOW).select("length").distinct().collect())  # WINDOW - 1 at most
    found = cut(_points(docs, key, text, short, _filter(theirs)), "fingerprints")
    ours = found.select("id", "row", F.explode("points").alias("p")).select("id", "row", "p.*")
    spans = cut(_extended(ours.join(theirs, ["length", "hash"]), id_type, item_type).distinct(), "spans")
    so_far = F.max("last").over(W.partitionBy("row").orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(so_far, F.lit(0))))
    hit = (spans.groupBy("row", "first").agg(F.max("last").alias("last")).select("row", new.alias("n"))
           .groupBy("row").agg(F.sum("n").alias("n_hit")))
    named = (spans.select("row", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    documents = (found.select("id", "row", "n_words").join(hit.join(named, "row"), "row", "left")
                 .select("id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    return documents, spans
