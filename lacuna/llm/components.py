"""Connected components of a graph given by its edges, in rounds over a written table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.scratch import cut


def roots_of(parent: dict[int, int], node: int) -> int:
    """The root of a node in a forest that is flattened on the way."""
    top = node
    while (up := parent.get(top, top)) != top:
        top = up
    while node != top:
        parent[node], node = top, parent[node]
    return top


def join_nodes(parent: dict[int, int], a: int, b: int) -> None:
    """Put two nodes into one tree, whose root is the smaller root."""
    a, b = roots_of(parent, a), roots_of(parent, b)
    if a < b:
        parent[b] = a
    elif b < a:
        parent[a] = b


def _forests(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: each task keeps a star per component of its own edges."""
    schema = edges.schema

    def run(batches):
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                join_nodes(parent, a, b)
        nodes = list(parent)
        roots = [roots_of(parent, n) for n in nodes]
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()) for x in (nodes, roots)], schema=to_arrow_schema(schema))

    return edges.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node that is not a root.

    ``edges`` has two bigint columns. Rounds of large and small stars: every node hangs its larger
    neighbours, then its smaller ones, below the smallest. A round writes at most as many edges as it read, so hubs
    never multiply; the minimum of a node's neighbours is an aggregate that is joined back, which
    Spark may split where one node has very many. Only the count and a checksum of a round reach the driver.
    """
    edges = edges.toDF("a", "b").where("a <> b")
    stars = cut(_forests(edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct()).where("a <> b").distinct(), "edges")
    before = None
    while True:
        seen = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before or seen[0] == 0:
            return stars.toDF("node", "root")
        before = seen
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select("a", F.col("m").alias("b")).unionAll(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        stars = cut(small.distinct(), "edges")
