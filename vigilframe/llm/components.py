"""Connected components over a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import checkpoint


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (the larger ones, or the smaller ones and itself) on its smallest neighbour.

    Only a minimum is aggregated for a node; neighbours are never gathered.
    """
    way = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = way.join(least, "a")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node and root by union and find, for a bounded number of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        for lo in range(0, len(nodes), 1 << 14):
            some = nodes[lo : lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([top(x) for x in some], pa.int64())], names=["node", "root"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, rows: int | None = None, few: int = 0) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges (a, b). No edges, no rows. rows: about how many edges.

    Up to `few` edges, whose nodes are integers then, are joined in one task: rounds over few rows cost more stages than work. Of
    more, the rounds end when the edges no longer change, told by their number and the sum of a hash over them.
    """
    now, told = checkpoint(edges.select("a", "b").where("a <> b"), rows), None
    if few and now.count() <= few:
        return checkpoint(_in_one_task(now), few)
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(seen) == told or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        told = tuple(seen)
        now = checkpoint(_star(_star(now, True), False), seen[0])
