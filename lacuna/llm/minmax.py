"""Near-duplicates by min-max hashing: banded signatures propose, full shingle sets confirm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.llm.components import components, join_nodes, roots_of
from lacuna.llm.texts import slices
from lacuna.llm.winnow import Hashes, gram_hashes, mixed
from lacuna.scratch import cut

#: Words of a shingle.
SHINGLE = 5

#: Bands of a signature and permutations of a band. A permutation gives two values, its minimum and its
#: maximum, so 192 evaluations per shingle give 384 values. Two sets of similarity s meet in some band with
#: probability 1 - (1 - s**8)**48: all but 3e-7 of pairs at 0.85, and
#: all but 1.5e-4 at 0.80 (1.3e-3 for 4 of 5 shingles, where minimum and maximum depend on each other).
BANDS, PERMUTATIONS = 48, 4

#: Shingles hashed together, so that the values stay in the processor's cache.
SPAN = 2048

#: Shingles of one block of a cluster. A cluster of more is compared block by block.
BLOCK_SHINGLES = 400_000

#: Bits of the filter that lets through the rows whose sets are compared: 2**24 bits are 2 MB at any size.
FILTER_BITS = 24

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str, memory: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    ids = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    return np.unique(gram_hashes(ids, n, n)) if n else ids


def permutations(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    count = BANDS * PERMUTATIONS
    return (draw.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], draw.integers(0, 1 << 32, count, np.uint32)[:, None]


def band_keys(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from the smallest and the largest value of each of its permutations."""
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), SPAN):
        values = a * x[None, i : i + SPAN]
        values += b
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in np.concatenate([low.reshape(BANDS, -1), high.reshape(BANDS, -1)], axis=1).T:
        keys = mixed(keys * np.uint64(0x100000001B3) + column)
    return keys.view(np.int64)


def _signed(rows: DataFrame, key_type: str) -> DataFrame:
    """``row``, ``key``, ``n``, ``digest`` of the set, ``bands`` of every row."""
    out = StructType.fromDDL(f"row bigint, key {key_type}, n bigint, digest binary, bands array<bigint>")

    def run(batches):
        arrow, memory, (a, b) = to_arrow_schema(out), Hashes(), permutations()
        for batch in batches:
            for part in slices(batch, pc.utf8_length(batch.column(2))):
                made, known = ([], [], []), {}
                for text in part.column(2).to_pylist():
                    found = shingles(text, memory)
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    if digest not in known:
                        known[digest] = band_keys(found, a, b) if len(found) else np.empty(0, np.int64)
                    for column, value in zip(made, (len(found), digest, known[digest])):
                        column.append(value)
                columns = [pa.array(c, arrow.field(i + 2).type) for i, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=arrow)

    return rows.mapInArrow(run, out)


def _sets(rows: DataFrame, wanted) -> DataFrame:
    """``row`` and its shingle set (sorted 64-bit hashes) for the rows that the filter lets through."""
    out = StructType.fromDDL("row bigint, set binary")

    def run(batches):
        arrow, memory = to_arrow_schema(out), Hashes()
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            low = _low_bits(batch.column(0).to_numpy())
            passed = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(passed))
            for part in slices(batch, pc.utf8_length(batch.column(1))):
                sets = [shingles(t, memory).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=arrow)

    return rows.select("row", "text").mapInArrow(run, out)


def _low_bits(rows: np.ndarray) -> np.ndarray:
    return (mixed(rows.astype(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter(ids: DataFrame):
    """A bitmap of fixed size in which the rows of ``ids`` set a bit each; built in tasks, merged by bit or."""
    out = StructType.fromDDL("page int, bits binary")

    def run(batches):
        whole = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            whole[_low_bits(batch.column(0).to_numpy())] = True
        pages = np.packbits(whole, bitorder="little").reshape(-1, 4096)
        used = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pages[i].tobytes() for i in used], pa.binary())], schema=to_arrow_schema(out))

    merged = ids.mapInArrow(run, out).groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits")).collect()
    whole = bytearray(1 << (FILTER_BITS - 3))  # at most 512 pages of 4 KB
    for r in merged:
        whole[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["bits"]
    return ids.sparkSession.sparkContext.broadcast(bytes(whole))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i in left, j in right) of similarity of at least ``percent``, by counting common shingles through posting lists.

    Pairs of one tree are not told apart: links that join nothing new are left out.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent: dict[int, int] = {}
    links = []
    for i in left.tolist():
        start = np.searchsorted(values, sets[i], "left")
        count = np.searchsorted(values, sets[i], "right") - start
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)
        common = np.bincount(owner[at], minlength=len(right))
        union = sizes[i] + sizes[right] - common
        for j in right[np.flatnonzero((100 * common >= percent * union) & (common > 0))].tolist():
            if roots_of(parent, i) != roots_of(parent, j):
                join_nodes(parent, i, j)
                links.append((i, j))
    return links


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """Edges between rows whose full sets are similar. ``members``: cluster, low, high, block, row, set; one group per (cluster, low, high)."""
    out = StructType.fromDDL("a bigint, b bigint")

    def run(batches):
        group, rows, blocks, sets = None, [], [], []

        def close():
            if len(rows) < 2:
                return None
            ids, block = np.array(rows), np.array(blocks)
            left, right = np.flatnonzero(block == group[1]), np.flatnonzero(block == group[2])
            links = linked(sets, left, right, percent) if len(left) and len(right) else []
            pairs = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, c]], pa.int64()) for c in (0, 1)], schema=to_arrow_schema(out))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            data = batch.column(5)
            for i, (cluster, low, high, block, row) in enumerate(zip(*columns)):
                if group != (cluster, low, high):
                    if (made := close()) is not None:
                        yield made
                    group, rows, blocks, sets = (cluster, low, high), [], [], []
                rows.append(row)
                blocks.append(block)
                sets.append(np.frombuffer(data[i].as_py(), np.uint64))
        if (made := close()) is not None:
            yield made

    dealt = members.select("cluster", "low", "high", "block", "row", "set").repartition("cluster", "low", "high")
    return dealt.sortWithinPartitions("cluster", "low", "high").mapInArrow(run, out)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(groups, table). groups: ``row``, ``key``, ``n_shingles``, ``component_id`` (smallest key reachable), ``first`` (true for
    one row of each component). table: the rows of ``df`` with the ``row`` that names them, as ``__row``.

    1. Rows with equal sets are one class; only classes go on, so copies cost one row.
    2. Classes that share a band key are one cluster, by components over (class, smallest class of the key).
    3. A cluster compares full sets, block by block where it is large; its links are final.
    4. Components over the links.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Null keys
    count as larger than all others; a component of null keys alone has a null id. Rows with equal keys are separate
    rows of ``groups``, and of a component one row alone is ``first``. An empty table gives no rows; other
    columns are kept in ``table`` and nowhere else.
    """
    table = cut(df.withColumn("__row", F.monotonically_increasing_id()), "documents")
    rows = table.select(F.col("__row").alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = table.schema[key].dataType.simpleString()
    signed = cut(_signed(rows.select("row", "key", "text"), key_type), "signatures")
    classes = cut(signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("id"), F.min("key").alias("key"),
                                                              F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    dealt = classes.select(F.col("id"), F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("times")).where("times > 1").select("band", "hub")
    met = dealt.join(shared, "band").where("id <> hub").select("id", "hub")
    grown = components(met)
    clusters = cut(grown.select(F.col("node").alias("row"), F.col("root").alias("cluster"))
                   .unionAll(grown.select(F.col("root").alias("row"), F.col("root").alias("cluster")).distinct()), "clusters")
    sizes = clusters.join(classes.select(F.col("id").alias("row"), "n"), "row")
    blocks = cut(sizes.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "blocks")
    members = (_sets(rows, _filter(clusters.select("row"))).join(clusters, "row").join(blocks, "cluster")
               .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    links = components(cut(_confirmed(members, percent), "links"))
    named = classes.select("id", "digest", "key").join(links.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("key").alias("component_id"))
    of_class = cut(named.join(lowest, "root").select("digest", "root", "component_id"), "components")
    joined = signed.select("row", "key", "n", "digest").join(of_class, "digest", "left")
    alone = F.col("root").isNull()
    groups = cut(joined.select("row", "key", F.col("n").alias("n_shingles"),
                               F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
                               F.when(alone, F.lit(-1) - F.col("row")).otherwise(F.col("root")).alias("root")), "groups")
    # one row of each component: the first that has the smallest key
    chosen = groups.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return groups.join(chosen, "row", "left").select("row", "key", "n_shingles", "component_id", F.coalesce("first", F.lit(False)).alias("first")), table


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df`` that are the first of their component, with all their columns."""
    groups, table = near_duplicates(df, key, text, percent)
    return table.join(groups.where("first").select(F.col("row").alias("__row")), "__row", "left_semi").drop("__row")
