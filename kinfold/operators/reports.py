"""Monitoring reports over the state tables: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and upper ends of the size buckets.
HEALTH = ((1, "01_singleton"), (5, "02_small (2-5)"), (20, "03_medium (6-20)"), (100, "04_large (21-100)"), (1000, "05_xlarge (101-1000)"), (None, "06_giant (1000+)"))
DASHBOARD = ((1, "1 (singleton)"), (5, "2-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1000"), (None, "1000+"))


def bucket(size: Column, buckets) -> Column:
    c = F.lit(buckets[-1][1])
    for top, name in reversed(buckets[:-1]):
        c = F.when(size <= top, name).otherwise(c)
    return c


def run_summary(history: DataFrame) -> DataFrame:
    return history.select(
        "run_id", "run_mode", "status", "started_at", "ended_at", "duration_seconds", "entities_processed", "edges_created", "clusters_impacted", "lp_iterations", "source_tables_processed", "error_message"
    ).orderBy(F.desc("started_at"))


def cluster_health(clusters: DataFrame) -> DataFrame:
    n = F.col("cluster_size")
    return clusters.groupBy(bucket(n, HEALTH).alias("size_bucket")).agg(
        F.count("*").alias("cluster_count"), F.sum(n).alias("total_entities"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("avg_size")
    ).orderBy("size_bucket")


#: The wording of severities and the recommendation below, and the statuses that a run ends with.
SUCCEEDED, FAILED = ("SUCCESS", "SUCCESS_WITH_WARNINGS"), ("FAILED", "ERROR")


def identifier_issues(ids: DataFrame, above: int = 100) -> DataFrame:
    n = F.col("entity_count")
    severity = F.when(n > 10_000, "CRITICAL: Excessive matches (>10K)").when(n > 1000, "WARNING: High matches (>1K)").when(n > 100, "INFO: Elevated matches (>100)").otherwise("OK")
    g = ids.groupBy("identifier_type", "identifier_value_norm").agg(F.count("*").alias("entity_count")).where(n > above)
    return g.select("*", severity.alias("severity"), F.lit("Review identifier quality - may indicate data issue").alias("recommendation")).orderBy(F.desc(n))


def rule_effectiveness(rules: DataFrame, audit: DataFrame) -> DataFrame:
    """The last run is the greatest run_id."""
    last = audit.agg(F.max("run_id").alias("last_run"))
    a = audit.crossJoin(F.broadcast(last)).groupBy("rule_id").agg(F.sum("edges_created").alias("total"), F.max(F.when(F.col("run_id") == F.col("last_run"), F.col("edges_created")).otherwise(0)).alias("recent"))
    return rules.where("is_active").join(a, "rule_id", "left").select(
        "rule_id", "rule_name", "identifier_type", F.coalesce("total", F.lit(0)).alias("total_edges_created"), F.coalesce("recent", F.lit(0)).alias("edges_last_run"), "priority"
    ).orderBy("priority")


def run_trends(history: DataFrame) -> DataFrame:
    return history.groupBy(F.to_date("started_at").alias("run_date")).agg(
        F.count("*").alias("run_count"), F.count_if(F.col("status").isin(*SUCCEEDED)).alias("success_count"), F.count_if(F.col("status").isin(*FAILED)).alias("error_count"),
        F.avg("duration_seconds").alias("avg_duration_seconds"), F.sum("entities_processed").alias("total_entities"), F.sum("edges_created").alias("total_edges"),
    ).orderBy(F.desc("run_date"))


def cluster_distribution(clusters: DataFrame) -> DataFrame:
    n = F.col("cluster_size")
    return clusters.groupBy(bucket(n, DASHBOARD).alias("bucket")).agg(F.count("*").alias("cluster_count"), F.sum(n).alias("entity_count"), F.min(n).alias("_o")).orderBy("_o").drop("_o")


def largest_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    return clusters.orderBy(F.desc("cluster_size"), "resolved_id").limit(n)


def orphaned_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    return clusters.join(members, "resolved_id", "left_anti")


def orphaned_entities(entities: DataFrame, members: DataFrame) -> DataFrame:
    return entities.join(members, "entity_key", "left_anti")


def stale_sources(run_state: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return run_state.withColumn("hours_since", F.timestamp_diff("HOUR", F.col("last_run_ts"), now)).where(F.col("hours_since") >= hours)


def cluster_root_cause(members: DataFrame, ids: DataFrame, resolved_id: str) -> DataFrame:
    m = members.where(F.col("resolved_id") == resolved_id).select("entity_key")
    return ids.join(m, "entity_key", "left_semi").groupBy("identifier_type", "identifier_value_norm").agg(F.countDistinct("entity_key").alias("entities"))


def success_rate(history: DataFrame) -> DataFrame:
    good = F.count_if(F.col("status").isin("SUCCESS", "SUCCESS_WITH_WARNINGS", "DRY_RUN_COMPLETE"))
    return history.agg(F.count("*").alias("total_runs"), good.alias("successful"), F.round(100.0 * good / F.nullif(F.count("*"), F.lit(0)), 2).alias("success_rate"))


def size_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.groupBy("cluster_size").agg(F.count("*").alias("clusters_before"))
    b = after.groupBy("cluster_size").agg(F.count("*").alias("clusters_after"))
    z = F.lit(0)
    return a.join(b, "cluster_size", "full_outer").select("cluster_size", F.coalesce("clusters_before", z).alias("clusters_before"), F.coalesce("clusters_after", z).alias("clusters_after")).withColumn("diff", F.col("clusters_after") - F.col("clusters_before"))


def moved_in(diff: DataFrame, at_least: int = 1) -> DataFrame:
    return diff.where("change_type = 'MOVED'").groupBy("proposed_resolved_id").agg(F.count("*").alias("moved_in")).where(F.col("moved_in") >= at_least)


def run_timings(audit: DataFrame) -> DataFrame:
    return audit.groupBy("run_id").agg(F.sum("edges_created").alias("edges"), F.timestamp_diff("SECOND", F.min("started_at"), F.max("ended_at")).alias("seconds"))


def touchpoints(members: DataFrame, events: DataFrame, channel: str, at_least: int = 2) -> DataFrame:
    """Clusters that were seen in several channels."""
    return events.join(members, "entity_key").groupBy("resolved_id").agg(F.countDistinct(channel).alias("channels"), F.count("*").alias("touches")).where(F.col("channels") >= at_least)


def first_touch(members: DataFrame, events: DataFrame, channel: str, at: str) -> DataFrame:
    return events.join(members, "entity_key").groupBy("resolved_id").agg(F.min_by(channel, F.struct(at, "entity_key")).alias("first_channel"), F.min(at).alias("first_at"))


def alerts(history: DataFrame, skipped: DataFrame, clusters: DataFrame, most_skipped: int = 100, largest: int = 10_000) -> DataFrame:
    failed = history.where(F.col("status").isin("FAILED", "ERROR")).select(F.lit("failed_run").alias("alert"), F.col("run_id").alias("subject"), F.lit(1).cast("long").alias("n"))
    many = skipped.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > most_skipped).select(F.lit("skipped_groups").alias("alert"), F.col("run_id").alias("subject"), "n")
    big = clusters.where(F.col("cluster_size") > largest).select(F.lit("giant_cluster").alias("alert"), F.col("resolved_id").alias("subject"), F.col("cluster_size").cast("long").alias("n"))
    return failed.union(many).union(big)


def excessive_values(ids: DataFrame, above: int) -> DataFrame:
    big = ids.groupBy("identifier_type", "identifier_value_norm").agg(F.count("*").alias("n")).where(F.col("n") > above).drop("n")
    return ids.join(big, ["identifier_type", "identifier_value_norm"], "left_semi")
