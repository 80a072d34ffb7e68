"""Exact per-cell nearest donors, as a join of vector blocks.

1. Rows with equal vector and equal set of observed cells form one *profile*. All its rows have the
   same nearest donors, and of its own rows only the k lowest keys can ever be chosen as donors. So
   a group of copies, however large, costs one profile of k rows.
2. Profiles are range-partitioned by (nearest reference vector, distance to it) and cut into blocks of
   bounded size, so a block is a neighbourhood, however the rows lay before. It knows the range of its
   distances to every reference, and a first bound for each of its holes from its own donors.
3. Query blocks that follow each other form teams that a task can hold. By the triangle inequality a donor block
   is left out for every team whose queries all lie beyond one of its ranges: the ranges alone travel to find this out, and
   vectors only to the teams that may need them, the nearest first. Where only some features have holes, profiles without a hole
   do not ask, and those without any wanted cell do not give; neither travels for nothing.
4. Donors of a team are dealt into slots. A task takes one team and one slot, keeps the running k best of every
   cell while donor blocks stream past, and excludes blocks and pairs again as its bounds fall. What cannot be
   excluded is computed, so the result is exact.
5. Teams take their turns in waves. What a wave is dealt has a bounded size and is deleted before the next, so the disk holds
   the blocks and one wave, though the blocks sent to all teams grow with the square of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, LongType, StructType

from lacuna.functions.vectors import METRICS
from lacuna.functions.holes import known, q, unused
from lacuna.operators.position import with_position
from lacuna.operators.tiles import PLACES, Tile, as_metric, closest, distances, prepare
from lacuna.scratch import cut, cut_counted, cut_parts, drop_table, small_table

REFERENCES = 32
BLOCK_BYTES = 8 << 20
PART_BYTES = 64 << 20  # profiles that one task cuts into blocks
PART_ROWS = 4096  # and those that are worth a task
TEAM_BYTES = 32 << 20  # query vectors and rows that a task holds
TASKS_PER_CORE = 32
SLOT_BYTES = 64 << 20  # donor blocks that stream past a team in one task
SLOT_BLOCKS = 256  # and their number, or as many rows in smaller blocks
WAVE_BYTES = 4 << 30  # blocks that are dealt to tasks at one time
STACK_ROWS = 2048  # profiles on each side of one tile, at least those of one block
STRIP_PAIRS = 1 << 20  # pairs of a tile whose distances are held at once
FEW_PAIRS = 50  # one in so many pairs of a tile is computed alone, more all at once
SLACK = 1e-9  # bounds are widened by this, so rounding never excludes a tie
ROUNDED = 4 * 10.0**-PLACES  # two ways to sum one distance may round it to neighbours

PROFILE = ("h1", "h2")


# ---------------------------------------------------------------- profiles

def profile_id(vector: Column, observed: list[Column]) -> list[Column]:
    """128 bits that identify a vector together with the set of observed cells."""
    pattern = F.concat(*[F.when(o, F.lit("1")).otherwise(F.lit("0")) for o in observed]) if observed else F.lit("")
    return [F.xxhash64(F.lit(1), vector, pattern).alias("h1"), F.xxhash64(F.lit(2), pattern, vector).alias("h2")]


def tag_rows(df: DataFrame, key: str, vector: str, features) -> DataFrame:
    """h1, h2, key, vec, and the features as doubles."""
    if not isinstance(df.schema[key].dataType, LongType):
        raise TypeError(f"{key}: the join works on bigint keys; ``with_long_keys`` gives them to any table")
    ids = profile_id(q(vector), [known(df, f).isNotNull() for f in features])
    values = F.array(*[known(df, f).cast("double") for f in features]) if features else F.array().cast("array<double>")
    return df.select(*ids, q(key).alias("key"), q(vector).alias("vec"), values.alias("vals"))


@dataclass(frozen=True)
class Profiles:
    """Written table of profiles, their number and the length of their vectors."""

    table: DataFrame
    n: int
    dim: int


def profiles(tagged: DataFrame, k: int, once: bool = False) -> Profiles:
    """One row per profile with its k lowest keys and their values, or with ``once`` its k lowest different keys.

    The rank filter is applied in every task before the shuffle, so a hot profile sends k rows per task.
    """
    lowest = W.partitionBy(*PROFILE).orderBy("key") if once else W.partitionBy(*PROFILE).orderBy("key", "vals")
    rank = F.dense_rank() if once else F.row_number()
    kept = tagged.withColumn("rn", rank.over(lowest)).where(F.col("rn") <= k)
    if once:
        kept = kept.withColumn("before", F.lag("key").over(lowest)).where("before IS NULL OR before <> key")
    grouped = kept.groupBy(*PROFILE).agg(
        F.first("vec").alias("vec"),
        F.collect_list(F.struct("key", "vals")).alias("rows"),  # k entries at most
    )
    table, seen = cut_counted(grouped, "profiles", F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"),
                              F.count_if(F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x))).alias("bad"), lean=True)
    if seen["least"] != seen["most"] or seen["bad"]:
        raise ValueError("vectors must exist for every row, hold numbers alone and have one length")
    return Profiles(table, seen["n"], seen["most"] or 0)


# ---------------------------------------------------------------- blocks

def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return _flat(column).astype(np.float64, copy=False).reshape(len(column), -1)


PLACED = "h1 bigint, h2 bigint, vec {kind}, rows array<struct<key:bigint,vals:array<double>>>, asks boolean, gives boolean"


def _assigner(references: np.ndarray, metric: str):
    """Adds the nearest reference of every vector and the distance to it."""
    ready = prepare(references, metric)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = as_metric(distances(prepare(_vectors(batch.column("vec")), metric), ready, metric), metric)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                names=[*batch.schema.names, "cell", "ring"])

    return assign


BLOCK_SCHEMA = ("part int, seq int, asks boolean, gives boolean, n int, ids binary, mat binary, counts binary, keys binary, vals binary, "
                "far binary, lo binary, hi binary, bound binary, reach binary, asked bigint, bytes bigint")


def _packer(references: np.ndarray, metric: str, block_rows: int, k: int, n_features: int, vector_type: str):
    """Cuts the sorted stream into blocks of at most ``block_rows`` profiles.

    Profiles that ask and profiles that give are blocks of their own, unless all do both. Holes get their first
    bound from the donors of their own stretch of the stream and of the one before it.
    """
    ready, types = prepare(references, metric), to_arrow_schema(StructType.fromDDL(BLOCK_SCHEMA))

    def pack_one(t: pa.Table, **known) -> dict:
        t = t.combine_chunks()
        column = {c: t.column(c).combine_chunks() for c in t.column_names}
        rows = column["rows"]
        counts = rows.value_lengths().to_numpy().astype(np.int32)
        entries = rows.flatten()
        keys = entries.field("key").to_numpy()
        vals = _flat(entries.field("vals")).astype(np.float64).reshape(len(keys), n_features)
        order = np.lexsort((keys, np.repeat(np.arange(len(counts)), counts)))
        vectors = _vectors(column["vec"])
        far = as_metric(distances(prepare(vectors, metric), ready, metric), metric)
        return {**known, "n": len(counts), "ids": np.stack([column["h1"].to_numpy(), column["h2"].to_numpy()], axis=1).tobytes(),
                "mat": vectors.astype(vector_type).tobytes(), "counts": counts.tobytes(), "keys": keys[order].tobytes(), "vals": vals[order].tobytes(),
                "far": far.tobytes(), "lo": far.min(axis=0).tobytes(), "hi": far.max(axis=0).tobytes(), "bound": b"", "reach": b""}

    def pack(batches):
        from pyspark import TaskContext

        pending: list[pa.Table] = []
        size = seq = asked = 0
        part, before = TaskContext.get().partitionId(), None

        def stretch():
            nonlocal seq, before, asked
            t = pa.concat_tables(pending)
            asks, gives = t.column("asks"), t.column("gives")
            both = pc.all(asks).as_py() and pc.all(gives).as_py()
            sides = [(t, True, True)] if both else [(t.filter(asks), True, False), (t.filter(gives), False, True)]
            packed = [pack_one(side, asks=a, gives=g, part=part, seq=seq + i) for i, (side, a, g) in enumerate(sides) if side.num_rows]
            donors = next((Block(p, True, metric, n_features, vector_type) for p in packed if p["gives"]), None)
            for p in packed:
                if p["asks"]:
                    best = _Best(Block(p, False, metric, n_features, vector_type), k, n_features)
                    for near in (donors, before):
                        if near is not None:
                            best.add([near], metric)
                    best.limit += ROUNDED
                    p["bound"], p["reach"] = best.limit.tobytes(), best.reach(metric).tobytes()
                p["asked"], p["bytes"] = asked, sum(len(v) for v in p.values() if isinstance(v, bytes))
                asked += p["n"] if p["asks"] else 0
            seq, before = seq + len(packed), donors or before
            return pa.RecordBatch.from_pylist(packed, schema=types)

        for batch in batches:
            table, at = pa.Table.from_batches([batch]), 0
            while at < batch.num_rows:
                piece = table.slice(at, block_rows - size)
                pending.append(piece)
                size += piece.num_rows
                at += piece.num_rows
                if size == block_rows:
                    yield stretch()
                    pending, size = [], 0
        if size:
            yield stretch()

    return pack


def _element(kind: str) -> str:
    """How vector elements travel: floats stay floats."""
    return "<f4" if kind == "array<float>" else "<f8"


@dataclass(frozen=True)
class Blocks:
    """Written table of blocks with their number along the curve, and how many profiles ask and give. A team asks for as many
    profiles as ``per_team`` full blocks hold."""

    table: DataFrame
    n: int
    per_team: int
    vector_type: str
    block_rows: int
    asking: int
    giving: int

    @property
    def teams(self) -> int:
        return math.ceil(self.asking / (self.per_team * self.block_rows))


def hole(f: int) -> Column:
    """Whether the rows of a profile lack a feature."""
    value = F.col("rows")[0]["vals"][f]
    return value.isNull() | F.isnan(value)


def wanted_features(queries: DataFrame, n_features: int) -> list[int]:
    """Features that a profile lacks."""
    lacking = queries.agg(*[F.coalesce(F.max(hole(f)), F.lit(False)).alias(f"f{f}") for f in range(n_features)]).first()
    return [f for f in range(n_features) if lacking[f]]


def build_blocks(queries: DataFrame, donors: DataFrame, references: np.ndarray, metric: str, block_rows: int, k: int, n_features: int,
                 parts: int = 1, per_team: int = 1, wanted: list[int] | None = None) -> Blocks:
    """Blocks of at most ``block_rows`` profiles, dealt to ``parts`` tasks by (nearest reference, distance to it). Profiles that lack
    a ``wanted`` feature ask, those that have one give; without any named, all do."""
    holes = [hole(f) for f in wanted or []]
    asks, gives = (F.greatest(F.lit(False), *holes), ~F.least(F.lit(True), *holes)) if holes else (F.lit(True), F.lit(True))

    def side(table: DataFrame, asks: Column, gives: Column) -> DataFrame:
        return table.select("h1", "h2", "vec", "rows", asks.alias("asks"), gives.alias("gives")).where("asks OR gives")

    no = F.lit(False)
    both = side(queries, asks, gives) if queries is donors else side(queries, asks, no).unionByName(side(donors, no, gives))
    kind = both.schema["vec"].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        both, kind = both.withColumn("vec", F.col("vec").cast("array<double>")), "array<double>"
    order = ["cell", "ring", "h1", "h2"]
    placed = both.mapInArrow(_assigner(references, metric), PLACED.format(kind=kind) + ", cell int, ring double")
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = ranged.mapInArrow(_packer(references, metric, block_rows, k, n_features, _element(kind)), BLOCK_SCHEMA)
    asking, giving = (F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("asks", "gives"))
    written, seen = cut_counted(packed, "blocks", asking, giving, lean=True)
    if parts == 1:
        table = written.withColumns({"start": F.lit(0), "first": F.lit(0)})
    else:
        # one row per task that cut blocks
        sizes = sorted((r["part"], r["n"], r["asks"]) for r in written.groupBy("part").agg(F.count(F.lit(1)).alias("n"), asking).collect())
        starts, firsts = ([0, *accumulate(s[i] for s in sizes)][:-1] for i in (1, 2))
        offsets = small_table(written.sparkSession, part=([s[0] for s in sizes], pa.int32()), start=(starts, pa.int64()), first=(firsts, pa.int64()))
        table = written.join(offsets, "part")
    team = F.floor((F.col("first") + F.col("asked")) / (per_team * block_rows)).cast("int")
    table = table.withColumns({"block": (F.col("start") + F.col("seq")).cast("bigint"), "team": team}).drop("part", "seq", "start", "first", "asked")
    return Blocks(table, seen["n"], per_team, _element(kind), block_rows, seen["asks"], seen["gives"])


class Block:
    """A block as arrays. ``lo`` and ``hi`` are the ranges of its distances to the references, ``far`` the distances."""

    def __init__(self, row, donor: bool, metric: str, n_features: int, vector_type: str):
        def field(name, dtype):
            return np.frombuffer(row[name], dtype=dtype)

        n = int(row["n"])
        self.n = n
        self.vectors = prepare(field("mat", vector_type).reshape(n, -1), metric)
        self.counts = field("counts", np.int32).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        # rows of a profile have the same cells observed
        self.vals = field("vals", np.float64).reshape(int(self.counts.sum()), n_features)
        self.observed = ~np.isnan(self.vals[self.starts])
        if donor:
            self.keys = field("keys", np.int64)
            self.by_key = np.argsort(self.keys, kind="stable")
            self.owner = np.repeat(np.arange(n), self.counts)
            self.lo, self.hi = field("lo", np.float64), field("hi", np.float64)
        else:
            self.ids = field("ids", np.int64).reshape(n, 2)
            self.far = field("far", np.float64).reshape(n, -1)
            bound = field("bound", np.float64)
            self.bound = bound.reshape(-1, n) if len(bound) else None

    @classmethod
    def stacked(cls, blocks: list[Block], donor: bool) -> Block:
        """Several blocks as one; only of a single block are the ranges kept."""
        if len(blocks) == 1:
            return blocks[0]
        out = cls.__new__(cls)
        out.n = sum(b.n for b in blocks)
        out.vectors = tuple(None if part[0] is None else np.concatenate(part) for part in zip(*(b.vectors for b in blocks)))
        out.counts = np.concatenate([b.counts for b in blocks])
        out.starts = np.cumsum(out.counts) - out.counts
        out.observed = np.concatenate([b.observed for b in blocks])
        if donor:
            out.vals, out.keys = np.concatenate([b.vals for b in blocks]), np.concatenate([b.keys for b in blocks])
            out.by_key = np.argsort(out.keys, kind="stable")
            out.owner = np.repeat(np.arange(out.n), out.counts)
        else:
            out.ids, out.far = np.concatenate([b.ids for b in blocks]), np.concatenate([b.far for b in blocks])
            out.bound = None if any(b.bound is None for b in blocks) else np.concatenate([b.bound for b in blocks], axis=1)
        return out

    def only(self, profiles: np.ndarray) -> Block:
        """Some profiles of a donor block as a block."""
        rows, _ = self.rows_of(profiles)
        out = Block.__new__(Block)
        out.n, out.counts = len(profiles), self.counts[profiles]
        out.vectors = tuple(None if part is None else part[profiles] for part in self.vectors)
        out.starts = np.cumsum(out.counts) - out.counts
        out.observed, out.vals, out.keys = self.observed[profiles], self.vals[rows], self.keys[rows]
        out.by_key = np.argsort(out.keys, kind="stable")
        out.owner = np.repeat(np.arange(out.n), out.counts)
        return out

    def rows_of(self, profiles: np.ndarray):
        """Row numbers of the given profiles, and for each row the position of its profile in the list."""
        counts = self.counts[profiles]
        at = np.repeat(np.arange(len(profiles)), counts)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.starts[profiles][at] + inside, at


# ---------------------------------------------------------------- tiles in tasks

CANDIDATE_SCHEMA = "h1 bigint, h2 bigint, f int, key bigint, value double, dist double"


def beyond(far: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How far a donor of a block at least is from each query, by its ranges around every reference.

    A distance that is undefined (infinite for vectors without spread) excludes nothing.
    """
    with np.errstate(invalid="ignore"):
        gap = np.fmax(far - hi, lo - far)
    return np.where(np.isfinite(gap), gap, 0.0).max(axis=1)


class _Best:
    """Running k best donors of every wanted cell of one query block."""

    def __init__(self, block: Block, k: int, n_features: int):
        self.block, self.k = block, k
        self.any_row = n_features == 0
        width = max(n_features, 1)
        self.wanted = np.ones((width, block.n), dtype=bool) if self.any_row else ~block.observed.T
        # a donor must beat (limit, last_key); a bound from elsewhere may be met, but not passed
        self.limit = np.full((width, block.n), np.inf) if block.bound is None else block.bound.copy()
        self.last_key = np.full((width, block.n), np.iinfo(np.int64).max)
        self.held: list[dict | None] = [None] * width
        self.full = np.zeros((width, block.n), dtype=bool)  # k donors are held

    def reach(self, metric: str) -> np.ndarray:
        """How far from each query a donor may be."""
        return np.where(self.wanted, as_metric(self.limit, metric), -np.inf).max(axis=0)

    def near(self, donors: Block, metric: str) -> np.ndarray:
        """Queries that a donor of the block may still serve, by its ranges around every reference."""
        return np.flatnonzero(beyond(self.block.far, donors.lo, donors.hi) <= self.reach(metric) + SLACK)

    def add(self, blocks: list[Block], metric: str):
        """Blocks that may serve a query are one tile with all queries that one of them may serve."""
        near = [(b, rows) for b in blocks if len(rows := self.near(b, metric))]
        if not near:
            return
        rows = near[0][1] if len(near) == 1 else np.flatnonzero(np.bincount(np.concatenate([r for _, r in near]), minlength=self.block.n))
        donors = Block.stacked([b for b, _ in near], True)
        if not self.any_row:
            # profiles without any cell that is wanted here
            useful = donors.observed[:, self.wanted[:, rows].any(axis=1)].any(axis=1)
            if not useful.any():
                return
            if not useful.all():
                donors = donors.only(np.flatnonzero(useful))
        tile = Tile(tuple(None if part is None else part[rows] for part in self.block.vectors), donors.vectors, metric)
        offered = np.ones((len(self.wanted), donors.n), dtype=bool) if self.any_row else donors.observed.T
        wanted = self.wanted[:, rows]
        # a vector without spread is as far from all others, so once k are held only keys count
        flat = tile.a[1] == 0 if metric == "correlation" else np.zeros(len(rows), dtype=bool)
        by_key = wanted & flat & self.full[:, rows]
        open_ = wanted & np.isinf(self.limit[:, rows]) & ~by_key
        for f in np.flatnonzero(by_key.any(axis=1)):
            self._search_keys(f, rows[by_key[f]], donors, offered[f])
        for f in np.flatnonzero(open_.any(axis=1)):
            self._search_all(f, np.flatnonzero(open_[f]), rows, tile, donors, offered[f])
        self._search_near(tile, rows, donors, offered, wanted & ~open_ & ~by_key)

    def _search_keys(self, f, rows, donors, offered):
        """Cells that are equally far from every donor: the lowest keys."""
        columns = donors.by_key[offered[donors.owner[donors.by_key]]]
        many = np.minimum(np.searchsorted(donors.keys[columns], self.last_key[f][rows], side="right"), self.k)
        if many.any():
            i = np.repeat(rows, many)
            at = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            self._merge(f, i, columns[at], np.full(len(i), np.inf), donors)

    def _search_all(self, f, open_, rows, tile, donors, offered):
        """Cells without a bound yet: the k best of the whole block."""
        columns = donors.by_key[offered[donors.owner[donors.by_key]]]
        if not len(columns):
            return
        step = max(1, STRIP_PAIRS // len(columns))
        for lo in range(0, len(open_), step):
            part = open_[lo:lo + step]
            d = tile.dense(part)[:, donors.owner[columns]]
            i, j = closest(d, donors.keys[columns], self.k)
            self._merge(f, rows[part[i]], columns[j], d[i, j], donors)

    def _search_near(self, tile, rows, donors, offered, cells):
        """Cells with a bound: only pairs that can beat it are looked at."""
        if not cells.any():
            return
        reach = np.where(cells, self.limit[:, rows], -np.inf).max(axis=0)
        mask = tile.nearby(reach)
        n = np.count_nonzero(mask)
        if not n:
            return
        least = donors.keys[donors.starts]
        if n * FEW_PAIRS > mask.size:
            return self._search_crowd(tile, rows, donors, offered, cells, reach, least)
        i, j = np.divmod(np.flatnonzero(mask), donors.n)
        d = tile.exact(i, j)
        for f in range(len(cells)):
            at = rows[i]
            wins = (d < self.limit[f][at]) | ((d == self.limit[f][at]) & (least[j] <= self.last_key[f][at]))
            near = np.flatnonzero(wins & cells[f][i] & offered[f][j])
            if len(near):
                found, pair = donors.rows_of(j[near])
                self._merge(f, at[near][pair], found, d[near][pair], donors)

    def _search_crowd(self, tile, rows, donors, offered, cells, reach, least):
        """As ``_search_near`` where many pairs are as near as the bound: most lose by their keys. Some rows at a time."""
        step = max(1, STRIP_PAIRS // donors.n)
        for lo in range(0, len(rows), step):
            pairs = np.flatnonzero(tile.rough[lo:lo + step] <= (reach[lo:lo + step] + tile.slack)[:, None]) + lo * donors.n
            i, j = np.divmod(pairs, donors.n)
            rough, first = tile.rough.ravel()[pairs], least[j]
            for f in range(len(cells)):
                near = np.flatnonzero(cells[f][i] & offered[f][j])
                at = rows[i[near]]
                gap = rough[near] - self.limit[f][at]
                # surely not nearer than the bound: only a key as low can win
                near = near[(gap < -tile.slack) | ((gap <= tile.slack) & (first[near] <= self.last_key[f][at]))]
                if not len(near):
                    continue
                d = tile.exact(i[near], j[near])
                found, pair = donors.rows_of(j[near])
                self._merge(f, rows[i[near]][pair], found, d[pair], donors)

    def _merge(self, f, i, rows, dist, donors):
        key = donors.keys[rows]
        limit = self.limit[f][i]
        wins = (dist < limit) | ((dist == limit) & (key <= self.last_key[f][i]))
        i, key, dist = i[wins], key[wins], dist[wins]
        value = np.zeros(len(i)) if self.any_row else donors.vals[rows[wins], f]
        held = self.held[f]
        if held is not None:
            i = np.concatenate([held["i"], i])
            key = np.concatenate([held["key"], key])
            value = np.concatenate([held["value"], value])
            dist = np.concatenate([held["dist"], dist])
        order = np.lexsort((value, key, dist, i))  # rows of one key by their value
        i = i[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        keep, last = rank < self.k, rank == self.k - 1
        kept = order[keep]
        self.held[f] = {"i": i[keep], "key": key[kept], "value": value[kept], "dist": dist[kept]}
        full = i[last]
        self.limit[f][full] = dist[order[last]]
        self.last_key[f][full] = key[order[last]]
        self.full[f][full] = True

    def rows(self):
        for f, held in enumerate(self.held):
            if held is not None and len(held["i"]):
                ids = self.block.ids[held["i"]]
                yield pd.DataFrame({"h1": ids[:, 0], "h2": ids[:, 1], "f": np.int32(f), "key": held["key"],
                                    "value": held["value"], "dist": held["dist"]})


def _tile_task(k: int, metric: str, n_features: int, vector_type: str, stack_rows: int = STACK_ROWS):
    def run(batches):
        current, held, asking, giving = None, [], [], []

        def ask():
            held.append(_Best(Block.stacked(asking, False), k, n_features))
            asking.clear()

        def give():
            for best in held:
                best.add(giving, metric)
            giving.clear()

        def finished():
            if giving:
                give()
            for best in held:
                yield from best.rows()

        for pdf in batches:
            for row in pdf.to_dict("records"):
                if (row["team"], row["slot"]) != current:
                    yield from finished()
                    current, held = (row["team"], row["slot"]), []
                    asking.clear()
                block, stack = Block(row, row["is_donor"], metric, n_features, vector_type), giving if row["is_donor"] else asking
                if row["is_donor"] and asking:
                    ask()
                if stack and sum(b.n for b in stack) + block.n > stack_rows:
                    give() if row["is_donor"] else ask()
                stack.append(block)
        yield from finished()

    return run


DEALT = "team int, slot int, rank int, is_donor boolean, block bigint, bytes bigint"


def _chooser(slot_rows: int, least_slots: int):
    """The tasks of every team: its query blocks, then the ranges of all donor blocks, to the blocks each slot gets."""

    def chosen(team, held, seen):
        """Donor blocks by how near they may be."""
        near = sorted(seen)
        slots = max(math.ceil(sum(n for *_, n, _ in near) / slot_rows), min(least_slots, len(near)))
        rows = [(team, slot, 0, False, block, size) for block, size in held for slot in range(slots)]
        rows += [(team, i % slots, i // slots, True, block, size) for i, (_, block, _, size) in enumerate(near)]
        return pd.DataFrame(rows, columns=["team", "slot", "rank", "is_donor", "block", "bytes"])

    def run(batches):
        team, held, queries, seen, ready = None, [], [], [], None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["team"] != team:
                    if seen:
                        yield chosen(team, held, seen)
                    team, held, queries, seen, ready = row["team"], [], [], [], None
                if not row["is_donor"]:
                    n = int(row["n"])
                    far = np.frombuffer(row["far"], np.float64).reshape(n, -1)
                    reach = np.frombuffer(row["reach"], np.float64)
                    if np.isneginf(reach).all():
                        continue  # nothing is wanted
                    held.append((row["block"], row["bytes"]))
                    queries.append((far[~np.isneginf(reach)], reach[~np.isneginf(reach)]))
                    continue
                if not queries:
                    continue
                if ready is None:
                    # per query block its own ranges, looked at first
                    ready = np.array([f.min(axis=0) for f, _ in queries]), np.array([f.max(axis=0) for f, _ in queries]), np.array([r.max() for _, r in queries])
                lo, hi = np.frombuffer(row["lo"], np.float64), np.frombuffer(row["hi"], np.float64)
                with np.errstate(invalid="ignore"):
                    gap = np.fmax(ready[0] - hi, lo - ready[1])
                gap = np.where(np.isfinite(gap), gap, 0.0).max(axis=1)
                least = None
                for i in np.flatnonzero(gap <= ready[2] + SLACK):
                    far, reach = queries[i]
                    at = beyond(far, lo, hi)
                    if (at <= reach + SLACK).any():
                        least = min(at.min(), math.inf if least is None else least)
                        if least <= 0:
                            break
                if least is not None:
                    seen.append((float(least), row["block"], row["n"], row["bytes"]))
        if seen:
            yield chosen(team, held, seen)

    return run


def choose(blocks: Blocks, slot_blocks: int, least_slots: int) -> DataFrame:
    """Which block goes to which team and slot: query blocks to all slots of their team, a donor block to one slot of each
    team that may need it. Only ranges and bounds are read, no vectors."""
    nothing = F.lit(None).cast("binary")
    queries = blocks.table.where("asks").select("team", F.lit(False).alias("is_donor"), "block", "n", "bytes", "far",
                                                "reach", nothing.alias("lo"), nothing.alias("hi"))
    donors = blocks.table.where("gives").select(F.explode(F.sequence(F.lit(0), F.lit(blocks.teams - 1))).alias("team"), F.lit(True).alias("is_donor"), "block", "n",
                                                "bytes", nothing.alias("far"), nothing.alias("reach"), "lo", "hi")
    met = queries.unionByName(donors).repartition(blocks.teams, "team").sortWithinPartitions("team", "is_donor", "block")
    return met.mapInPandas(_chooser(slot_blocks * blocks.block_rows, least_slots), DEALT)


def waves(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """First and last team of every wave: teams that follow each other and are dealt at most so many bytes, or a single team."""
    found, held = [], most + 1
    for team in sorted(sizes):
        if held + sizes[team] > most:
            found.append((team, team))
            held = 0
        found[-1] = found[-1][0], team
        held += sizes[team]
    return found


def deal(blocks: Blocks, chosen: DataFrame, tasks: int, slots: int) -> DataFrame:
    """Blocks laid out for the tasks of the join: the queries of a team, then the donors of a slot, the nearest first. A task
    may get several slots of at most ``slots`` per team, one after the other."""
    task = F.pmod(F.col("team").cast("bigint") * slots + F.col("slot"), F.lit(tasks)).cast("int")
    # what only the other side of the join reads stays behind
    given = {c: F.when(F.col("is_donor") == donors, F.col(c)) for donors, names in ((True, ("keys", "lo", "hi")), (False, ("ids", "far", "bound")))
             for c in names}
    # the list of a wave has some bytes for each block
    met = blocks.table.drop("reach", "team", "bytes").join(F.broadcast(chosen.drop("bytes")), "block").withColumns(given)
    return met.repartitionById(tasks, task).sortWithinPartitions("team", "slot", "is_donor", "rank")


def best_k(candidates: DataFrame, k: int) -> DataFrame:
    """The final merge: k nearest per cell over all tasks."""
    order = W.partitionBy("h1", "h2", "f").orderBy("dist", "key", "value")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- the join

def nearest_cells(queries: Profiles, donors: Profiles, k: int, metric: str, n_features: int,
                  block_rows: int | None = None, n_pivots: int | None = None) -> DataFrame:
    """k nearest donors of every hole of every query profile.

    ``queries`` and ``donors`` are tables as built by ``profiles``. Returns
    h1, h2, f (feature number), key, value, dist, rank. Without features (0) whole rows are sought.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, one of {METRICS}")
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = donors.table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    same = queries is donors
    if not donors.n or not queries.n:
        return spark.createDataFrame([], CANDIDATE_SCHEMA + ", rank int")
    # blocks large enough for dense arithmetic, small enough for memory and for every core to have some
    row_bytes = 8 * (donors.dim + k * n_features + REFERENCES)
    most = max(64, min(2048, BLOCK_BYTES // row_bytes))
    size = block_rows or int(min(most, max(64, math.ceil(max(queries.n, donors.n) / (2 * cores)))))
    chosen = donors.table.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(n_pivots or REFERENCES).collect()
    references = np.array([r["vec"] for r in chosen], dtype=np.float64)
    wanted = wanted_features(queries.table, n_features) if n_features else None
    if wanted == []:
        return spark.createDataFrame([], CANDIDATE_SCHEMA + ", rank int")
    placed = queries.n + (0 if same else donors.n)
    parts = max(math.ceil(placed * row_bytes / PART_BYTES), min(cores, placed // PART_ROWS))
    per_team = max(1, TEAM_BYTES // (size * row_bytes))
    blocks = build_blocks(queries.table, donors.table, references, metric, size, k, n_features, parts, per_team, wanted)
    least_slots = math.ceil(2 * cores / blocks.teams)
    slot_blocks = max(1, min(SLOT_BLOCKS * max(1, most // size), SLOT_BYTES // (size * row_bytes)))
    chosen = cut(choose(blocks, slot_blocks, least_slots), "dealt", lean=True)
    slots = max(least_slots, math.ceil(blocks.giving / (slot_blocks * size)))
    task = _tile_task(k, metric, n_features, blocks.vector_type, most)
    sizes = {r["team"]: r["bytes"] for r in chosen.groupBy("team").agg(F.sum("bytes").alias("bytes")).collect()}  # one row per team
    found = []
    for first, last in waves(sizes, WAVE_BYTES):
        tasks = min((last - first + 1) * slots, TASKS_PER_CORE * cores)
        dealt = deal(blocks, chosen.where(F.col("team").between(first, last)), tasks, slots)
        found.append(best_k(dealt.mapInPandas(task, CANDIDATE_SCHEMA), k))
    if not found:
        return spark.createDataFrame([], CANDIDATE_SCHEMA + ", rank int")
    result = cut_parts(found, "found", lean=True)
    drop_table(blocks.table)
    return result


# ---------------------------------------------------------------- keys of any type

#: Stands for a NULL key, which comes before all others.
NO_KEY = -(1 << 63)


def with_long_keys(df: DataFrame, key: str):
    """(``df`` with a bigint key that is never NULL, a function that puts the first keys back into named columns of a result).

    Whole numbers are widened and NULL becomes the lowest bigint, which is an error as a key. Other keys get the rank of
    their value, NULL the lowest. No row is lost or doubled, however often a key occurs.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, IntegralType):
        wide = q(key).cast("bigint")
        taken = F.raise_error(F.lit(f"{key}: {NO_KEY} cannot be a key")).cast("bigint")
        given = F.when(wide == NO_KEY, taken).otherwise(F.coalesce(wide, F.lit(NO_KEY)))
        return df.withColumn(key, given), lambda out, *columns: out.withColumns({c: F.when(q(c) != NO_KEY, q(c)).cast(kind) for c in columns})
    names = with_position(df.select(q(key).alias("value")).distinct(), "value", "number", "keys")
    value, number = unused(df, "__value"), unused(df, "__number")
    lookup = names.withColumnsRenamed({"value": value, "number": number})

    def restore(out, *columns):
        for c in columns:
            found = names.withColumnsRenamed({"value": unused(out, "__value"), "number": unused(out, "__number")})
            joined = out.join(found, q(c) == q(found.columns[1]))
            out = joined.select(*[q(found.columns[0]).alias(c) if o == c else q(o) for o in out.columns])
        return out

    numbered = df.join(lookup, q(key).eqNullSafe(q(value)))
    return numbered.select(*[q(number).alias(c) if c == key else q(c) for c in df.columns]), restore


# ---------------------------------------------------------------- whole rows

def nearest_rows(df: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", **tuning) -> DataFrame:
    """row_id, donor_id, dist, rank: the k nearest other rows of every row. The key may be of any type.

    Rows of one key never serve each other. A key, or NULL, held by several rows is an error where they are so near to
    each other that k others can't be told.
    """
    df, restore = with_long_keys(df, key)
    tagged = tag_rows(df, key, vector, [])
    groups = profiles(tagged, k + 1, once=True)
    found = nearest_cells(groups, groups, k + 1, metric, 0, **tuning)
    lists = found.groupBy(*PROFILE).agg(F.array_sort(F.collect_list(F.struct("dist", "key"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["key"] != F.col("row_id")), 1, k)
    short = (F.size("near") > k) & (F.size("others") < k)
    out = (tagged.select(*PROFILE, F.col("key").alias("row_id")).join(lists, list(PROFILE)).withColumn("others", others)
           .select("row_id", F.posexplode(F.when(short, F.raise_error(F.lit(f"{key} holds keys of several rows")).cast("array<struct<dist:double,key:bigint>>"))
                                          .otherwise(F.col("others"))).alias("pos", "donor"))
           .select("row_id", F.col("donor.key").alias("donor_id"), F.col("donor.dist").alias("dist"),
                   (F.col("pos") + 1).alias("rank")))
    return restore(out, "row_id", "donor_id")
