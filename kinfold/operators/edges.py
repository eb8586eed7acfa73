"""Groups of equal identifiers, their star edges, and the graph around what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..model import Metadata

VALUE = ["identifier_type", "identifier_value_norm"]
GROUP = ["rule_id", *VALUE]
EDGE = ["rule_id", "left_entity_key", "right_entity_key", *VALUE]


def max_group_size(meta: Metadata) -> Column:
    """By rule, 10,000 where a rule has none."""
    c = F.lit(None).cast("long")
    for r in meta.active_rules():
        c = F.when(F.col("rule_id") == r.rule_id, F.lit(int(r.max_group_size or 10_000))).otherwise(c)
    return F.coalesce(c, F.lit(10_000))


def delta_values(ids: DataFrame, delta: DataFrame) -> DataFrame:
    return ids.where("identifier_value_norm IS NOT NULL").join(delta.select("entity_key").distinct(), "entity_key", "left_semi").select(*VALUE).distinct()


def members(ids: DataFrame, values: DataFrame) -> DataFrame:
    return ids.join(values, VALUE, "left_semi")


def group_sizes(ids: DataFrame) -> DataFrame:
    return ids.where("identifier_value_norm IS NOT NULL").groupBy(*GROUP).agg(F.count("*").alias("group_size"), F.min("entity_key").alias("anchor"))


def oversized(ids: DataFrame, groups: DataFrame, meta: Metadata, run_id: str = "", at: Column | None = None, sample: int = 5, few: bool = False) -> DataFrame:
    """Groups above their rule's size, with their first keys in order. Each task passes on at most `sample` keys a group.

    few: those groups were counted, and can be broadcast, so that only their identifiers are shuffled."""
    big = groups.withColumn("max_allowed", max_group_size(meta)).where("group_size > max_allowed")
    first = Window.partitionBy(*GROUP).orderBy("entity_key")
    listed = big.select(*GROUP)
    keys = ids.join(F.broadcast(listed) if few else listed, GROUP, "left_semi").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
    samples = keys.groupBy(*GROUP).agg(F.to_json(F.sort_array(F.collect_list("entity_key"))).alias("sample_entity_keys"))
    return big.join(samples, GROUP).select(
        F.lit(run_id).alias("run_id"), *GROUP, "group_size", "max_allowed", "sample_entity_keys", F.lit("EXCEEDED_MAX_GROUP_SIZE").alias("reason"),
        (at if at is not None else F.lit(None).cast("timestamp")).alias("skipped_at"),
    )


def top_offenders(skipped: DataFrame, n: int = 3) -> DataFrame:
    return skipped.orderBy(F.desc("group_size"), *VALUE).limit(n)


def star_edges(ids: DataFrame, groups: DataFrame, meta: Metadata, dedup: bool = True) -> DataFrame:
    """anchor to member for groups within their rule's size: n - 1 edges for n members."""
    anchors = groups.where(F.col("group_size") <= max_group_size(meta)).where("group_size > 1").select(*GROUP, "anchor")
    e = ids.join(anchors, GROUP).where("entity_key <> anchor")
    e = e.select("rule_id", F.col("anchor").alias("left_entity_key"), F.col("entity_key").alias("right_entity_key"), *VALUE)
    return e.distinct() if dedup else e


def by_type(edges: DataFrame) -> DataFrame:
    """Edges of the persistent model, whose rule is named after the type of identifier."""
    return edges.withColumn("rule_id", F.concat(F.lit("rule_"), "identifier_type")).distinct()


def impacted_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("left_entity_key", "right_entity_key")).alias("entity_key")).distinct()


def one_hop(impacted: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and their neighbours."""
    def beside(here: str, there: str) -> DataFrame:
        return edges.join(impacted.withColumnRenamed("entity_key", here), here, "left_semi").select(F.col(there).alias("entity_key"))

    return impacted.union(beside("left_entity_key", "right_entity_key")).union(beside("right_entity_key", "left_entity_key")).distinct()


def closure(impacted: DataFrame, membership: DataFrame) -> DataFrame:
    """The nodes and all members of the clusters they were in: exact, as those clusters were whole components."""
    touched = membership.join(impacted, "entity_key", "left_semi").select("resolved_id").distinct()
    return impacted.union(membership.join(touched, "resolved_id", "left_semi").select("entity_key")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    left, right = nodes.withColumnRenamed("entity_key", "left_entity_key"), nodes.withColumnRenamed("entity_key", "right_entity_key")
    return edges.join(left, "left_entity_key", "left_semi").join(right, "right_entity_key", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, entity_key): each edge both ways, once."""
    ways = [F.struct(F.col(a).alias("src"), F.col(b).alias("entity_key")) for a, b in (("left_entity_key", "right_entity_key"), ("right_entity_key", "left_entity_key"))]
    return edges.select(F.explode(F.array(*ways)).alias("e")).select("e.*").distinct()


def heard(labels: DataFrame, both: DataFrame) -> DataFrame:
    """The least label among a node's neighbours."""
    return both.join(labels.select(F.col("entity_key").alias("src"), "label"), "src").groupBy("entity_key").agg(F.min("label").alias("heard"))


def propagate(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One round: the least of a node's own label and its neighbours'."""
    return labels.join(heard(labels, neighbours(edges)), "entity_key", "left").select("entity_key", F.least("label", F.coalesce("heard", "label")).alias("label"))


def propagated(nodes: DataFrame, edges: DataFrame, passes: int = 3) -> DataFrame:
    """Labels after a fixed number of rounds in one plan, for graphs whose clusters are known to be that narrow."""
    labels, both = nodes.select("entity_key", F.col("entity_key").alias("label")), neighbours(edges)
    for _ in range(passes):
        labels = labels.join(heard(labels, both), "entity_key", "left").select("entity_key", F.least("label", F.coalesce("heard", "label")).alias("label"))
    return labels


def hash_min(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame], max_iters: int = 30) -> tuple[DataFrame, int, bool]:
    """(labels, rounds with the last unchanged one, converged). Only labels that changed are sent on."""
    both = keep(neighbours(edges))
    labels = keep(nodes.select("entity_key", F.col("entity_key").alias("label"), F.lit(True).alias("changed")))
    for k in range(1, max_iters + 1):
        seen, lower = Observation(), F.coalesce(F.col("heard") < F.col("label"), F.lit(False))
        after = labels.join(heard(labels.where("changed"), both), "entity_key", "left").select("entity_key", F.when(lower, F.col("heard")).otherwise(F.col("label")).alias("label"), lower.alias("changed"))
        labels = keep(after.observe(seen, F.count_if("changed").alias("n")))
        if not seen.get["n"]:
            return labels.drop("changed"), k, True
    return labels.drop("changed"), max_iters, False
