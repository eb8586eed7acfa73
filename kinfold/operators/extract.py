"""Entities and identifiers out of source tables: each source is scanned once."""

from __future__ import annotations

from collections.abc import Mapping as Dict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonicalize, entity_key
from ..model import Exclusion, Metadata, Source

EPOCH = "1900-01-01 00:00:00"

ENTITIES = "run_id string, table_id string, entity_key string, watermark_value timestamp"
IDENTIFIERS = "table_id string, entity_key string, rule_id string, identifier_type string, identifier_value_norm string, is_hashed boolean"


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def watermark_predicate(source: Source, mode: str, last: str | None) -> Column | None:
    """None in a full run. The bare column is compared, so that the predicate reaches the scan."""
    if mode.upper() == "FULL" or not source.watermark_column:
        return None
    bound = F.lit(last or EPOCH).cast("timestamp")
    if source.lookback_minutes:
        bound = bound - F.expr(f"INTERVAL {int(source.lookback_minutes)} MINUTE")
    return F.expr(source.watermark_column) >= bound


def changed(frames: Dict[str, DataFrame], meta: Metadata, mode: str, marks: Dict[str, str]) -> dict[str, DataFrame]:
    """The sources' rows since their marks; a source without a watermark column gives all of its rows."""
    since = {s.table_id: watermark_predicate(s, mode, marks.get(s.table_id)) for s in meta.active_sources()}
    return {k: frames[k] if p is None else frames[k].where(p) for k, p in since.items()}


def entities(spark: SparkSession, frames: Dict[str, DataFrame], meta: Metadata, run_id: str = "", mode: str = "FULL", marks: Dict[str, str] | None = None) -> DataFrame:
    """A row for each source row since its table's mark; rows whose key is null are left out."""
    parts = []
    since = changed(frames, meta, mode, marks or {})
    for s in meta.active_sources():
        rows = since[s.table_id]
        mark = F.expr(s.watermark_column).cast("timestamp") if s.watermark_column else F.lit(None).cast("timestamp")
        parts.append(rows.select(F.lit(run_id).alias("run_id"), F.lit(s.table_id).alias("table_id"), entity_key(s.table_id, s.entity_key_expr).alias("entity_key"), mark.alias("watermark_value")))
    return _union(spark, parts, ENTITIES).where("entity_key IS NOT NULL")


def identifiers(spark: SparkSession, frames: Dict[str, DataFrame], meta: Metadata) -> DataFrame:
    """A row for each entity, active rule and mapped value, in the rule's canonical form; without nulls, unless the rule
    doesn't require values. Nulls never form groups.

    The rules are driver-side values, so the canonical form is part of the projection and needs no join."""
    parts = []
    for s in meta.active_sources():
        items = [
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(m.identifier_type).alias("identifier_type"),
                canonicalize(F.expr(m.expr).cast("string"), r.canonicalize).alias("identifier_value_norm"), F.lit(bool(m.is_hashed)).alias("is_hashed"),
                F.lit(bool(r.require_non_null)).alias("required"),
            )
            for m in meta.mappings_of(s.table_id) for r in meta.active_rules(m.identifier_type)
        ]
        if items:
            rows = frames[s.table_id].select(entity_key(s.table_id, s.entity_key_expr).alias("entity_key"), F.explode(F.array(*items)).alias("i"))
            rows = rows.where("entity_key IS NOT NULL AND (i.identifier_value_norm IS NOT NULL OR NOT i.required)")
            parts.append(rows.select(F.lit(s.table_id).alias("table_id"), "entity_key", F.col("i").dropFields("required").alias("i")).select("table_id", "entity_key", "i.*"))
    return _union(spark, parts, IDENTIFIERS)


def source_plan(spark: SparkSession, meta: Metadata, state: DataFrame) -> DataFrame:
    """(table_id, table, entity_key_expr, watermark_column, lookback_minutes, last_watermark_value) of the active sources;
    the mark is EPOCH for one that was never read. Raises ValueError if there is none."""
    rows = [(s.table_id, s.table, s.entity_key_expr, s.watermark_column, s.lookback_minutes) for s in meta.active_sources()]
    if not rows:
        raise ValueError("no active source")
    plan = spark.createDataFrame(rows, "table_id string, table string, entity_key_expr string, watermark_column string, lookback_minutes int")
    mark = F.coalesce("last_watermark_value", F.lit(EPOCH).cast("timestamp")).alias("last_watermark_value")
    return plan.join(state.select("table_id", "last_watermark_value"), "table_id", "left").select(*plan.columns, mark)


def excluded(ids: DataFrame, exclusions: tuple[Exclusion, ...]) -> Column:
    """Whether an identifier is on the list. The list is configuration: it becomes a part of the filter."""
    hit = F.lit(False)
    exact: dict[str, list[str]] = {}
    for e in exclusions:
        if e.match_type.upper() == "EXACT":
            exact.setdefault(e.identifier_type, []).append(e.pattern)
        else:
            hit = hit | ((F.col("identifier_type") == e.identifier_type) & F.col("identifier_value_norm").like(e.pattern))
    for kind, values in exact.items():
        hit = hit | ((F.col("identifier_type") == kind) & F.col("identifier_value_norm").isin(values))
    return hit


def flagged(ids: DataFrame, exclusions: tuple[Exclusion, ...], most_inline: int = 500) -> DataFrame:
    """ids with `excluded`. A long list of exact values is joined, a list of patterns is always part of the projection."""
    exact = [e for e in exclusions if e.match_type.upper() == "EXACT"]
    if len(exact) <= most_inline:
        return ids.withColumn("excluded", excluded(ids, exclusions))
    listed = ids.sparkSession.createDataFrame([(e.identifier_type, e.pattern) for e in exact], "identifier_type string, identifier_value_norm string").distinct()
    rest = tuple(e for e in exclusions if e.match_type.upper() != "EXACT")
    both = ids.join(listed.withColumn("listed", F.lit(True)), ["identifier_type", "identifier_value_norm"], "left")
    return both.select(*ids.columns, (F.coalesce("listed", F.lit(False)) | excluded(ids, rest)).alias("excluded"))


def without_excluded(ids: DataFrame, exclusions: tuple[Exclusion, ...], most_inline: int = 500) -> DataFrame:
    return flagged(ids, exclusions, most_inline).where("NOT excluded").drop("excluded")


def attributes(spark: SparkSession, frames: Dict[str, DataFrame], meta: Metadata, names: tuple[str, ...]) -> DataFrame:
    """entity_key, table_id, trust_rank, recency and a column for each attribute, null where a table has none."""
    parts = []
    for s in meta.active_sources():
        of = {a.name: a.expr for a in meta.attributes if a.table_id == s.table_id}
        recency = of.get("record_updated_at") or s.watermark_column
        cols = [F.expr(of[n]).cast("string").alias(n) if n in of else F.lit(None).cast("string").alias(n) for n in names]
        when = F.expr(recency).cast("timestamp") if recency else F.lit(EPOCH).cast("timestamp")
        parts.append(frames[s.table_id].select(
            F.lit(s.table_id).alias("table_id"), entity_key(s.table_id, s.entity_key_expr).alias("entity_key"), F.lit(s.trust_rank).alias("trust_rank"),
            F.coalesce(when, F.lit(EPOCH).cast("timestamp")).alias("recency"), *cols,
        ))
    return reduce(DataFrame.unionByName, parts).where("entity_key IS NOT NULL")


#: Columns that are taken for an attribute where nothing is mapped, first found first.
PROBED = {"email": ("email", "customer_email"), "phone": ("phone", "customer_phone"), "first_name": ("first_name",), "last_name": ("last_name",)}


def probed_attributes(frames: Dict[str, DataFrame], meta: Metadata) -> Metadata:
    """meta with attributes from the tables' column names, for tables of which none is mapped."""
    from dataclasses import replace

    from ..model import Attribute

    more = []
    for s in meta.active_sources():
        if not any(a.table_id == s.table_id for a in meta.attributes):
            have = {c.lower() for c in frames[s.table_id].columns}
            for name, options in PROBED.items():
                more += [Attribute(s.table_id, name, c) for c in [next((o for o in options if o in have), None)] if c]
    return replace(meta, attributes=meta.attributes + tuple(more))
