"""Membership, cluster sizes, edge statistics, confidence and golden profiles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Metadata, Survivorship


def labelled(labels: DataFrame) -> DataFrame:
    return labels.select("entity_key", F.col("label").alias("resolved_id"))


def lone(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Each entity without a label as its own cluster."""
    alone = entities.select("entity_key").distinct().join(labels, "entity_key", "left_anti")
    return alone.withColumn("resolved_id", F.col("entity_key"))


def membership(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Each labelled node, and each entity without one as its own cluster."""
    return labelled(labels).unionByName(lone(labels, entities))


def cluster_sizes(members: DataFrame, impacted: DataFrame | None = None) -> DataFrame:
    rows = members if impacted is None else members.join(impacted.select("resolved_id").distinct(), "resolved_id", "left_semi")
    return rows.groupBy("resolved_id").agg(F.count("*").alias("cluster_size"))


def edge_stats(members: DataFrame, edges: DataFrame, count: str = "doubled", whole: bool = False) -> DataFrame:
    """Types and edges of each cluster. An OR of two ends would be planned as a nested loop; two equi-joins are not.

    doubled: an edge counts at both of its ends; unique: once. whole: both ends of every edge are in one cluster, so that
    edges are counted by their left ends before anything is joined."""
    m = members.select(F.col("entity_key").alias("k"), "resolved_id")
    kinds = edges.select(F.col("left_entity_key").alias("k"), "identifier_type")
    if whole:
        per_key = kinds.groupBy("k", "identifier_type").agg(F.count("*").alias("n"))
        by_type = per_key.join(m, "k").groupBy("resolved_id", "identifier_type").agg((F.sum("n") * (2 if count == "doubled" else 1)).alias("n"))
        return by_type.groupBy("resolved_id").agg(F.count("*").alias("edge_diversity"), F.sum("n").alias("edge_count"))
    if count == "doubled":
        kinds = kinds.union(edges.select(F.col("right_entity_key").alias("k"), "identifier_type"))
    # counted by (cluster, type) first: few rows for each, whatever the cluster's size
    by_type = kinds.join(m, "k").groupBy("resolved_id", "identifier_type").agg(F.count("*").alias("n"))
    return by_type.groupBy("resolved_id").agg(F.count("*").alias("edge_diversity"), F.sum("n").alias("edge_count"))


def match_density(size: Column, edge_count: Column) -> Column:
    return F.when(size <= 1, 1.0).otherwise(F.least(F.lit(1.0), edge_count / (size - 1)))


#: The wording of the reasons.
def primary_reason(size: Column, diversity: Column, density: Column, kind: str = "short") -> Column:
    several = F.concat(diversity.cast("string"), F.lit(" identifier types"))
    if kind == "short":
        return F.when(size == 1, "SINGLETON_NO_MATCH_REQUIRED").when(diversity >= 2, several).otherwise("Single identifier type")
    level = F.when(density >= 0.5, "moderate").otherwise("low")
    return (
        F.when(size == 1, "SINGLETON_NO_MATCH_REQUIRED")
        .when((diversity >= 3) & (density >= 0.8), F.concat(several, F.lit(", high density")))
        .when((diversity >= 2) & (density >= 0.5), F.concat(several, F.lit(", moderate density")))
        .when((diversity == 1) & (density >= 0.8), "Single identifier type, high density")
        .when((diversity == 1) & (density < 0.5), "Single identifier type, chain pattern")
        .otherwise(F.concat(diversity.cast("string"), F.lit(" identifier type(s), "), level, F.lit(" density")))
    )


def confidence(sizes: DataFrame, stats: DataFrame, reasons: str = "short") -> DataFrame:
    """resolved_id, cluster_size, edge_diversity, edge_count, match_density, confidence_score, primary_reason.

    The diversity is relative to the largest among these clusters."""
    zero = F.lit(0)
    c = sizes.join(stats, "resolved_id", "left").select("resolved_id", "cluster_size", F.coalesce("edge_diversity", zero).alias("edge_diversity"), F.coalesce("edge_count", zero).alias("edge_count"))
    top = stats.agg(F.greatest(F.coalesce(F.max("edge_diversity"), F.lit(1)), F.lit(1)).alias("max_diversity"))
    c = c.crossJoin(F.broadcast(top)).withColumn("match_density", match_density(F.col("cluster_size"), F.col("edge_count")))
    score = F.round(0.50 * F.col("edge_diversity") / F.col("max_diversity") + 0.35 * F.col("match_density") + 0.15, 3)
    c = c.withColumn("confidence_score", F.when(F.col("cluster_size") == 1, 1.0).otherwise(score))
    reason = primary_reason(F.col("cluster_size"), F.col("edge_diversity"), F.col("match_density"), reasons)
    return c.withColumn("primary_reason", reason).drop("max_diversity")


def _order(s: Survivorship) -> Column:
    """Least is best; the key decides ties."""
    recent = -F.unix_micros("recency")
    rank = F.col("trust_rank")
    if s.source_priority:
        listed = F.lit(None).cast("int")
        for k, name in enumerate(s.source_priority):
            listed = F.when((F.col("table_id") == name), F.lit(k)).otherwise(listed)
        rank = F.coalesce(listed, F.lit(9999))
    kind = s.strategy.upper().replace(" ", "")
    if kind == "MOST_RECENT":
        return F.struct(recent, "entity_key")
    if kind == "SOURCE_PRIORITY":
        return F.struct(rank, F.col("entity_key"))
    if kind in ("SOURCE_PRIORITY+MOST_RECENT", "TRUST_RECENCY"):
        return F.struct(rank, recent, F.col("entity_key"))
    raise ValueError(f"no survivorship strategy {s.strategy!r}")


def golden_profiles(members: DataFrame, attributes: DataFrame, rules: tuple[Survivorship, ...], impacted: DataFrame | None = None) -> DataFrame:
    """One row for each cluster with the best value of each attribute that is not null: a single aggregation.

    Only rows that have an attribute are joined and aggregated; the others decide nothing."""
    some = reduce(or_, (F.col(s.attribute).isNotNull() for s in rules), F.lit(False))
    rows = attributes.where(some).join(members.select("entity_key", "resolved_id"), "entity_key")
    ids = members.select("resolved_id").distinct()
    if impacted is not None:
        ids = ids.join(impacted.select("resolved_id").distinct(), "resolved_id", "left_semi")
        rows = rows.join(ids, "resolved_id", "left_semi")
    def best(s: Survivorship) -> Column:
        has = F.col(s.attribute).isNotNull()
        return F.min_by(F.when(has, F.col(s.attribute)), F.when(has, _order(s))).alias(f"{s.attribute}_primary")

    return ids.join(rows.groupBy("resolved_id").agg(*map(best, rules)), "resolved_id", "left") if rules else ids


def survivorship_of(meta: Metadata, names: tuple[str, ...]) -> tuple[Survivorship, ...]:
    have = {s.attribute: s for s in meta.survivorship}
    return tuple(have.get(n, Survivorship(n)) for n in names)
