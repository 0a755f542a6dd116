"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import checkpoint


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """Of edges (a, b): one row (node, root) per node that has an edge, root being the component's smallest node.

    Each round costs two aggregations and two joins of the edges, which only shrink; they end as stars,
    after a number of rounds that grows with the logarithm of the longest path. Loops and repeated edges
    do no harm. The smallest neighbours are written before they are joined, so both sides of a join come
    straight from a shuffle and adaptive execution can split a star's hub.

    As soon as no more than `at_once` edges are left, one task settles them instead of further rounds: a round
    is five jobs, whose plans and tasks the driver bears. More edges go on in rounds, so no task holds more.
    """
    stars = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(stars)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        if before[0] <= at_once:
            stars = checkpoint(stars.coalesce(1).mapInArrow(_settled, "a long, b long"))
            break
        stars = checkpoint(_small_star(_large_star(stars)))
        now = _state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> each node that isn't the smallest of its component, with that."""
    from tickloom.llm.simhash import _labels

    pairs = pa.Table.from_batches(batches)
    own, place = np.unique(np.concatenate([pairs.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    label = _labels(len(own), place[: len(pairs)], place[len(pairs) :])
    moved = np.flatnonzero(label != np.arange(len(own)))
    yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour that is larger than u to the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    least = checkpoint(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
