"""Connected components of an edge table by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014): the number of rounds grows with the
logarithm of the nodes, not with the graph's diameter. A node's neighbours are never gathered: each step needs only
their minimum, which is combined before the shuffle, so a hub costs no more than its edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, share

SALTS = 64


def _beside_least(rows: DataFrame, nodes: DataFrame, n_edges: int, parts: int) -> DataFrame:
    """rows (u, v) with m, of nodes (u, m, n), as (v, m).

    A node with over a quarter of a partition's share of the edges is a hub: there are at most 8 x parts of those, so
    their list is broadcast, and their edges and minima meet on SALTS keys instead of one."""
    is_hub = F.col("n") > max(64, n_edges // (4 * parts))
    hubs = nodes.where(is_hub).select(F.col("u").alias("hub"))
    salts = F.when(is_hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    least = nodes.select(F.col("u").alias("w"), "m", F.explode(salts).alias("w_salt"))
    rows = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    rows = rows.withColumn("salt", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")))
    return rows.join(least, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("w_salt"))).select("v", "m").where("v <> m")


def _large_star(edges: DataFrame, n_edges: int, parts: int, k: int = 0, passes: int = 1) -> DataFrame:
    """Of the k-th pass's nodes. Two passes may give the same edge; a small-star step takes edges that repeat once."""
    both = share(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), k, passes, "u")
    nodes = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return _beside_least(both.where("v > u"), nodes, n_edges, parts).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nodes = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _beside_least(down, nodes, n_edges, parts).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(nodes.select("u", F.col("m").alias("v"))).distinct()


def _anchors(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[..., None], *more: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of edges (u, v): each node is put down to its anchors, the u's of its edges; a u is an anchor of its own.

    rows: (node, a), once for each edge of a v, and for a u. names: (a, least, more), the least name beside an anchor. Anchors
    are hashes, taken again with another seed if two names share one."""
    for seed in range(100):
        a = F.xxhash64(F.lit(seed), F.col("u")).alias("a")
        by = edges.groupBy(a).agg(F.min(F.least("u", "v")).alias("least"), F.min("u").alias("lo"), F.max("u").alias("hi"), *more)
        seen = Observation()
        names = keep(by.observe(seen, F.count_if(F.col("lo") != F.col("hi")).alias("shared")).drop("lo", "hi"))
        if not seen.get["shared"]:
            break
        drop(names)
    return edges.select(F.col("v").alias("node"), a).union(edges.select(F.col("u").alias("node"), a).distinct()), names


def _chained(rows: DataFrame) -> DataFrame:
    """rows (node, a) with prev, the anchor before it at the same node."""
    return rows.withColumn("prev", F.lag("a").over(Window.partitionBy("node").orderBy("a")))


def _anchored(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[..., None]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, names) of edges (u, v) whose nodes are no integers.

    nodes: (node, a, prev), with the node's first anchor where prev is null, else an anchor and the one before it at the same
    node: links (u, v)."""
    rows, names = _anchors(edges, keep, drop)
    rows = _chained(rows).where("prev IS NULL OR prev <> a")
    nodes = keep(rows.select(F.when(F.col("prev").isNull(), F.col("node")).alias("node"), "a", "prev"))
    return nodes, nodes.where("prev IS NOT NULL").select(F.col("prev").alias("u"), F.col("a").alias("v")), names


def components(edges: DataFrame, src: str, dst: str, keep: Callable[[DataFrame], DataFrame], max_rounds: int = 50) -> tuple[DataFrame, int, bool]:
    """((node, component), rounds, converged). component: the least node that it can reach, which has a row too.

    keep: writes a DataFrame where executors can be lost without losing it, and returns it read again; how many edges
    there are, and a checksum of them, are observed in that write. keep.drop, if it has one, removes such a table. Edges with
    a null end are ignored; a node without edges to another has no row. Of nodes that are no integers, the rounds join
    anchors only: a star's members follow theirs. Such edges are read twice, so that they should be a table."""
    drop = getattr(keep, "drop", lambda *tables: None)
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    if now.schema["u"].dataType.typeName() in ("long", "integer", "short", "byte"):
        now, rounds, converged = _stars(now.distinct(), keep, drop, max_rounds)
        return _labelled(now), rounds, converged
    nodes, links, names = _anchored(now, keep, drop)
    now, rounds, converged = _stars(links.distinct(), keep, drop, max_rounds)
    found = _labelled(now).withColumnRenamed("node", "a")
    rooted = keep(names.join(found, "a", "left").select("a", F.coalesce("component", "a").alias("root"), "least"))
    drop(now, names)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = keep(rooted.select("a", "root").join(least, "root").select("a", "component"))
    drop(rooted)
    return nodes.where("prev IS NULL").join(labels, "a").select("node", "component"), rounds, converged


def component_sizes(edges: DataFrame, src: str, dst: str, keep: Scratch, passes: int = 1, max_rounds: int = 50) -> tuple[DataFrame, int, bool]:
    """((component, size), rounds, converged): components and how many nodes they have, without a row for a node.

    A component's nodes are the rows of its anchors, less those that are not the first of their node. The edges are read
    in so many passes, each with the shuffle files of its own nodes only, and go when they were read if keep wrote them."""
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    rows, names = _anchors(now, keep, keep.drop, (F.count(F.lit(1)) + 1).alias("n"))
    links = keep(*(_chained(share(rows, k, passes, "node")).where("prev IS NOT NULL").select("prev", "a") for k in range(passes)))
    keep.drop(edges)
    rest = links.select("a", F.lit(None).cast(names.schema["least"].dataType).alias("least"), F.lit(-1).cast("long").alias("n"))
    counts = keep(names.union(rest).groupBy("a").agg(F.min("least").alias("least"), F.sum("n").alias("n")))
    keep.drop(names)
    between = links.where("prev <> a").select(F.col("prev").alias("u"), F.col("a").alias("v")).distinct()
    now, rounds, converged = _stars(between, keep, keep.drop, max_rounds, links, passes=passes)
    found = _labelled(now).withColumnRenamed("node", "a")
    rooted = counts.join(found, "a", "left").groupBy(F.coalesce("component", "a").alias("root"))
    return rooted.agg(F.min("least").alias("component"), F.sum("n").alias("size")).drop("root"), rounds, converged


def _labelled(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _stars(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[..., None], max_rounds: int, *used: DataFrame, passes: int = 1) -> tuple[DataFrame, int, bool]:
    """(edges (node, root) as a table, rounds, converged). used: tables that go when the edges are written. More passes than
    one need a Scratch."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        return df, (seen.get["n"], seen.get["sum"])

    between = keep if hasattr(keep, "drop") else lambda df: df  # a table, so that one step's shuffles go before the next
    now, before = kept(edges)
    drop(*used)
    rounds, converged = 0, before[0] == 0
    while not converged and rounds < max_rounds:
        large = between(*(_large_star(now, before[0], parts, k, passes) for k in range(passes)))
        drop(now)
        now, after = kept(_small_star(large, before[0], parts))
        drop(large)
        converged, before, rounds = after == before, after, rounds + 1
    return now, rounds, converged
