"""What a run would change, and whether to let it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(proposed: DataFrame, current: DataFrame, proposed_sizes: DataFrame, current_sizes: DataFrame, delta: DataFrame | None = None, run_id: str = "", at: Column | None = None) -> DataFrame:
    """NEW, UNCHANGED or MOVED for each proposed entity (of the delta)."""
    p = proposed.select("entity_key", F.col("resolved_id").alias("proposed_resolved_id"))
    if delta is not None:
        p = p.join(delta.select("entity_key").distinct(), "entity_key", "left_semi")
    c = current.select("entity_key", F.col("resolved_id").alias("current_resolved_id"))
    d = p.join(c, "entity_key", "left")
    d = d.join(current_sizes.select(F.col("resolved_id").alias("current_resolved_id"), F.col("cluster_size").alias("current_cluster_size")), "current_resolved_id", "left")
    d = d.join(proposed_sizes.select(F.col("resolved_id").alias("proposed_resolved_id"), F.col("cluster_size").alias("proposed_cluster_size")), "proposed_resolved_id", "left")
    change = F.when(F.col("current_resolved_id").isNull(), "NEW").when(F.col("current_resolved_id") == F.col("proposed_resolved_id"), "UNCHANGED").otherwise("MOVED")
    return d.select(
        F.lit(run_id).alias("run_id"), "entity_key", "current_resolved_id", "proposed_resolved_id", change.alias("change_type"),
        "current_cluster_size", "proposed_cluster_size", (at if at is not None else F.lit(None).cast("timestamp")).alias("created_at"),
    )


def changes(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """NEW, MOVED and REMOVED over both sides; what stays is left out."""
    p, c = proposed.select("entity_key", F.col("resolved_id").alias("proposed_resolved_id")), current.select("entity_key", F.col("resolved_id").alias("current_resolved_id"))
    kind = F.when(F.col("current_resolved_id").isNull(), "NEW").when(F.col("proposed_resolved_id").isNull(), "REMOVED").when(F.col("current_resolved_id") != F.col("proposed_resolved_id"), "MOVED")
    return p.join(c, "entity_key", "full_outer").withColumn("change_type", kind).where("change_type IS NOT NULL")


def summary(d: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("change_type") == kind)
    return d.agg(
        F.count("*").alias("total_entities"), of("NEW").alias("new_entities"), of("MOVED").alias("moved_entities"), of("UNCHANGED").alias("unchanged_entities"),
        F.coalesce(F.max("proposed_cluster_size"), F.lit(0)).cast("long").alias("largest_proposed_cluster"),
    )


def reshaped(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """(merged_clusters, split_clusters): proposed clusters with entities of several current ones, and the reverse."""
    p, c = proposed.select("entity_key", F.col("resolved_id").alias("p")), current.select("entity_key", F.col("resolved_id").alias("c"))
    pairs = p.join(c, "entity_key").select("p", "c").distinct()
    of = lambda k, name: pairs.groupBy(k).count().agg(F.count_if(F.col("count") > 1).alias(name))
    return of("p", "merged_clusters").crossJoin(F.broadcast(of("c", "split_clusters")))


def gate(row, max_moved: int = 10_000, max_cluster: int = 50_000) -> bool:
    """Whether a live run may follow a dry run with this summary."""
    return row["moved_entities"] <= max_moved and row["largest_proposed_cluster"] <= max_cluster
