"""Connected components of pairwise matches: strip leaves, compress chains by list ranking, solve the core, restore.

Each layer removes vertices and writes one row (v, up) for each: ``up`` is a vertex of the same component that stays.
Layers alternate between leaves (degree one), chains (degree two, compressed to one edge between their two ends by
pointer doubling over ranked arcs) and, once those no longer shrink the graph, a core layer. Labels are restored by
joining the layers backwards. Every join is on an edge (both ends) or on a vertex that occurs once on one side and
few times on the other, so a vertex holding a third of all pairs never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.graph import MAX_ROUNDS, ONE_TASK_EDGES, both_ways, lookup, star_contraction
from siftmill.shared import Table, cut

#: Leaf and chain layers go on while each pair of them removes at least this share of the edges and the core is more than
#: one task contracts.
WORTHWHILE = 0.15

def clean_links(pairs: DataFrame, a: Column, b: Column, keep: Column) -> DataFrame:
    """Undirected distinct links (a < b) of the rows kept; null ids and self links have none."""
    return (
        pairs.filter(keep)
        .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"), a.isNotNull().alias("ok"), b.isNotNull().alias("ok2"))
        .filter("ok and ok2 and a < b")
        .select("a", "b")
        .distinct()
    )


def _degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("lo"), F.max("w").alias("hi"))


def _strip_leaves(edges: Table, layers: list[Table]) -> Table:
    """One layer of degree-one vertices. Of a lone edge the smaller end stays."""
    leaves = _degrees(edges.df).filter("deg = 1").select(F.least("v", "lo").alias("a"), F.greatest("v", "lo").alias("b"), "v")
    gone = cut(leaves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("ends"), F.max("v").alias("v")), "cc-leaves")
    if not gone.rows:
        gone.drop()
        return edges
    layers.append(Table(gone.df.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("up")), gone.path, gone.rows, {}))
    return cut(edges.df.join(gone.df.select("a", "b"), ["a", "b"], "left_anti"), "cc-edges")


def _compress_chains(edges: Table, layers: list[Table]) -> Table:
    """Contract every maximal path of degree-two vertices to one edge between its ends, every pure cycle to its
    smallest vertex.

    An arc (v, w) of a chain vertex v goes on with the arc (w, x), x being w's other neighbour. Doubling these
    pointers ranks each arc: ``end`` is the vertex that ends the chain on that side, ``dist`` its distance. Arcs on a
    cycle never end; they carry the smallest vertex passed, which is the cycle's once no arc changes any more.
    """
    chain = cut(_degrees(edges.df).filter("deg = 2").select("v", "lo", "hi"), "cc-chain")
    if not chain.rows:
        chain.drop()
        return edges
    c = chain.df
    follow = c.select(F.col("lo").alias("v"), F.col("v").alias("w"), F.col("hi").alias("x")).union(c.select("hi", "v", "lo"))
    arcs = c.select("v", F.col("lo").alias("w")).union(c.select("v", "hi"))
    # state of an arc: the last arc (pv, pw) reached, steps made, smallest vertex passed; done once pw is no chain vertex
    state = cut(
        arcs.join(follow, ["v", "w"], "left").select(
            "v", "w",
            F.when(F.col("x").isNull(), F.col("v")).otherwise(F.col("w")).alias("pv"),
            F.coalesce("x", "w").alias("pw"),
            F.when(F.col("x").isNull(), 1).otherwise(2).cast("long").alias("dist"),
            F.least("v", "w").alias("low"),
            F.col("x").isNull().alias("done"),
        ),
        "cc-arcs",
        {"open": F.when(F.col("done"), 0).otherwise(1)},
    )
    # an arc that reached (pv, pw) holds what lies before it; the arc (pv, pw) goes on from there
    for _ in range(MAX_ROUNDS):
        if not state.sums["open"]:
            break
        s, o = state.df.alias("s"), state.df.select(*(F.col(k).alias(f"o_{k}") for k in state.df.columns)).alias("o")
        jump = (
            s.filter("not done")
            .join(o, (F.col("pv") == F.col("o_v")) & (F.col("pw") == F.col("o_w")), "left")
            .select(
                "v", "w",
                F.coalesce("o_pv", "pv").alias("pv"),
                F.coalesce("o_pw", "pw").alias("pw"),
                (F.col("dist") + F.coalesce(F.col("o_dist") - 1, F.lit(0))).alias("dist"),
                F.least("low", F.coalesce("o_low", "low")).alias("low"),
                F.coalesce("o_done", F.lit(True)).alias("done"),
                (F.coalesce("o_done", F.lit(True)) | (F.coalesce("o_low", "low") < F.col("low"))).alias("moved"),
            )
        )
        after = cut(
            s.filter("done").withColumn("moved", F.lit(False)).unionByName(jump),
            "cc-arcs",
            {"open": F.when(F.col("done"), 0).otherwise(1), "moved": F.col("moved").cast("int")},
        )
        state.drop()
        state = Table(after.df.drop("moved"), after.path, after.rows, after.sums)
        if not after.sums["moved"]:
            break
    else:
        raise RuntimeError(f"chains not ranked after {MAX_ROUNDS} rounds")
    sides = state.df.groupBy("v").agg(
        F.min(F.when(F.col("done"), F.struct("dist", "pw"))).alias("near"),
        F.min(F.when(F.col("done"), F.col("pw"))).alias("e1"),
        F.max(F.when(F.col("done"), F.col("pw"))).alias("e2"),
        F.min("low").alias("low"),
    )
    removed = cut(
        sides.select("v", F.coalesce("near.pw", "low").alias("up"), "e1", "e2").filter("v <> up"),
        "cc-ranked",
    )
    layers.append(Table(removed.df.select("v", "up"), removed.path, removed.rows, {}))
    # edges of chain vertices are named by their arcs, so no join gathers a vertex
    touched = arcs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    joined = removed.df.filter("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    left = edges.df.join(touched, ["a", "b"], "left_anti").union(joined).distinct()
    out = cut(left, "cc-edges")
    state.drop()
    chain.drop()
    return out


def _solve_core(edges: Table, layers: list[Table]) -> None:
    """The layer of what is left: every vertex hangs on the smallest of its component."""
    e = star_contraction(edges)
    layers.append(Table(e.df.select(F.col("b").alias("v"), F.col("a").alias("up")), e.path, e.rows, {}))


def connected_groups(links: DataFrame) -> DataFrame:
    """(file_id, group_id) for every end of ``links`` (a < b, distinct): group_id is the smallest id reachable.

    Empty links give no rows. Stars, chains, cycles and cliques of any size are split over all tasks; intermediate
    tables lie in the shared folder.
    """
    layers: list[Table] = []
    start = cut(links.select("a", "b"), "cc-edges")
    edges = start
    for _ in range(MAX_ROUNDS):
        before = edges.rows
        if not before:
            break
        for step in (_strip_leaves, _compress_chains):
            after = step(edges, layers) if edges.rows else edges
            if after is not edges:
                edges.drop()
            edges = after
        if before - edges.rows < WORTHWHILE * before or edges.rows <= ONE_TASK_EDGES:
            break
    else:
        raise RuntimeError(f"leaves and chains left after {MAX_ROUNDS} rounds")
    if edges.rows:
        _solve_core(edges, layers)
    if not layers:
        return start.df.select(F.col("a").alias("file_id"), F.col("b").alias("group_id"))
    # restore: every removed vertex hangs on one that stayed longer; doubling takes it to its root
    hung = layers[0].df.select("v", "up")
    for layer in layers[1:]:
        hung = hung.unionByName(layer.df.select("v", "up"))
    forest, depth = Table(hung, "", sum(x.rows for x in layers), {}), 1
    while depth < len(layers):
        above = forest.df.select(F.col("v").alias("k"), F.col("up").alias("r"))
        up = lookup(forest.df, "up", above, forest.rows).select("v", F.coalesce("r", "up").alias("up"))
        after = cut(up, "cc-forest")
        if forest.path:
            forest.drop()
        forest, depth = after, depth * 2
    # every vertex has an edge, so a root is always hung on
    low = forest.df.groupBy("up").agg(F.least(F.min("v"), F.col("up")).alias("r"))
    named = lookup(forest.df, "up", low.withColumnRenamed("up", "k"), forest.rows).select(F.col("v").alias("file_id"), F.col("r").alias("group_id"))
    return named.unionByName(low.select(F.col("up").alias("file_id"), F.col("r").alias("group_id")))
