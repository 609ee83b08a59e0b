"""Connected components by star contraction, and joins on keys of any skew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.shared import Table, cut, hot_limit

#: Bound against endless loops; the rounds needed grow with the logarithm of the longest path. Beyond it is an error.
MAX_ROUNDS = 80
#: Edges that one task contracts in one go (16 bytes each and their sorted ends); more take distributed rounds.
ONE_TASK_EDGES = 1_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("v", "w")


def attach(edges: DataFrame, value: DataFrame, rows: int) -> DataFrame:
    """Directed edges (v, w) with ``m`` of v; vertices of more than the limit (at most HOT_SHARE) are broadcast."""
    limit = hot_limit(rows)
    if rows <= limit:
        return edges.join(value.select("v", "m"), "v")
    hot = F.broadcast(value.filter(F.col("deg") > limit).select("v", F.col("m").alias("hm")))
    marked = edges.join(hot, "v", "left")
    cold = marked.filter("hm is null").drop("hm").join(value.filter(F.col("deg") <= limit).select("v", "m"), "v")
    return marked.filter("hm is not null").withColumnRenamed("hm", "m").unionByName(cold)


def lookup(df: DataFrame, key: str, table: DataFrame, rows: int) -> DataFrame:
    """``df`` with ``r`` of the row of ``table`` (k unique, r) for ``key``, null where there is none. Keys of more rows
    than the limit (at most HOT_SHARE of them) are broadcast."""
    limit = hot_limit(rows)
    if rows <= limit:
        return df.join(table.withColumnRenamed("k", key), key, "left")
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(F.col(key).alias("hot"))
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left")
    known = F.broadcast(hot.join(table, F.col("hot") == F.col("k")).select(F.col("k").alias(key), "r"))
    warm = marked.filter("hot is not null").drop("hot").join(known, key, "left")
    cold = marked.filter("hot is null").drop("hot").join(table.withColumnRenamed("k", key), key, "left")
    return warm.unionByName(cold)


def hang_on_smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, v) of every end v that is not itself the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, w = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[w])
        before = label.copy()
        np.minimum.at(label, before[u], low)  # hook the roots of both ends, then the ends themselves
        np.minimum.at(label, before[w], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label, before):
            break
    off = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[off]], ids[off]


def _contract_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if got:
        table = pa.Table.from_batches(got)
        root, v = hang_on_smallest(table.column("a").to_numpy(), table.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(v)], ["a", "b"])


def star_contraction(edges: Table, keep: bool = True) -> Table:
    """Edges (a < b) of a star forest with the components of ``edges``: each vertex hangs on its component's smallest.

    Alternately link all larger, then all smaller neighbours of a vertex to its smallest neighbour. Either step makes
    the sum of all ends smaller if it changes any edge, so an equal sum is the end. What fits one task is contracted
    there. ``keep`` spares the input table.
    """
    ends = {"ends": (F.col("a") + F.col("b")).cast("decimal(20,0)")}
    e, last = edges, None
    for _ in range(MAX_ROUNDS):
        if e.rows <= ONE_TASK_EDGES:
            after = cut(e.df.select("a", "b").coalesce(1).mapInArrow(_contract_here, "a long, b long"), "star")
            if not (keep and e is edges):
                e.drop()
            return after
        two = both_ways(e.df)
        least = two.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("deg"))
        large = attach(two, least, 2 * e.rows).filter("w > v").select(F.col("w").alias("v"), F.col("m").alias("w"))
        large = cut(large.filter("v <> w").distinct(), "star")
        # small star: here every v points to smaller w only
        low = large.df.groupBy("v").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("deg"))
        small = attach(large.df, low, large.rows).select(F.col("w").alias("v"), F.col("m").alias("w"))
        small = small.union(low.select("v", "m")).filter("v <> w").distinct().select(F.col("w").alias("a"), F.col("v").alias("b"))
        after = cut(small, "star", ends)
        large.drop()
        if not (keep and e is edges):
            e.drop()
        e = after
        if after.sums["ends"] == last:
            return e
        last = after.sums["ends"]
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def components(links: DataFrame) -> DataFrame:
    """(v, root): every end of ``links`` (a, b; null, equal and repeated ones do not matter) with the smallest id
    reachable from it. Empty links give no rows."""
    clean = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(clean, "links")
    if not edges.rows:
        return edges.df.select(F.col("a").alias("v"), F.col("b").alias("root"))
    star = star_contraction(edges, keep=False).df
    return star.select(F.col("b").alias("v"), F.col("a").alias("root")).union(star.select("a", "a").distinct())
