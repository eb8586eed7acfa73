"""A resolution run: sources to clusters, scores and golden profiles, or a dry run that writes none of those."""

from __future__ import annotations

import hashlib
import json
import uuid
import warnings
from collections.abc import Mapping as Dict
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import Metadata, RunConfig
from ..operators import clusters as C
from ..operators import dryrun, extract
from ..operators import edges as E
from ..operators.components import components
from ..sources.metadata import validate
from ..sources.scratch import Scratch, put, remove
from ..sources.state import SCHEMAS, StateStore, upserted, upserted_edges

MEMBERS, CLUSTERS, EDGES, GOLDEN = "identity_resolved_membership_current", "identity_clusters_current", "identity_edges_current", "golden_profile_current"
IDENTIFIERS = "identifiers_current"


@dataclass
class Result:
    run_id: str
    status: str
    lp_iterations: int = 0
    converged: bool = True
    counts: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    stages: list[dict] = field(default_factory=list)
    summary: dict | None = None


class _Scratch(Scratch):
    """Work tables of one run, in a folder of the state store that is removed at its end."""

    def __init__(self, store: StateStore, run_id: str):
        super().__init__(store.spark, f"{store.root}/_work/{run_id}-{uuid.uuid4().hex}")
        self.store, self.placed, self.committed = store, {}, False

    def counted(self, df: DataFrame, into: str | None = None, **more: Column) -> tuple[DataFrame, dict[str, int]]:
        """The work table, and its rows and further aggregates, observed while it is written. into: the table of the state
        that it becomes a part of, so that it isn't written twice."""
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in more.items()))
        if into is None:
            return self(df), seen.get
        self.placed.setdefault(into, []).append([path := self.store.place(into), None, None])
        return put(df, path), seen.get

    def end(self) -> None:
        remove(self.spark, self.root)
        for path, _, _ in (p for parts in self.placed.values() for p in parts if not self.committed):
            remove(self.spark, path)


def labels_of(nodes: DataFrame | None, edges: DataFrame, config: RunConfig, keep) -> tuple[DataFrame, int, bool]:
    if config.algorithm == "hash_min":
        return E.hash_min(nodes, edges, keep, config.max_iters)
    comps, rounds, converged = components(edges, "left_entity_key", "right_entity_key", keep, config.max_iters)
    found = comps.select(F.col("node").alias("entity_key"), F.col("component").alias("label"))
    if nodes is None:
        return found, rounds, converged
    return nodes.join(found, "entity_key", "left").select("entity_key", F.coalesce("label", "entity_key").alias("label")), rounds, converged


def run(spark: SparkSession, meta: Metadata, frames: Dict[str, DataFrame], store: StateStore, config: RunConfig = RunConfig(), run_id: str | None = None, run_ts: str | None = None) -> Result:
    """run_ts: UTC time of the run, to the second; a dry run writes only dry-run tables, history and stage metrics."""
    began = datetime.now(UTC)
    run_ts = run_ts or began.strftime("%Y-%m-%d %H:%M:%S")
    run_id = run_id or ("dry_run_" if config.dry_run else "run_") + uuid.uuid4().hex[:12]
    result, now, keep = Result(run_id, "RUNNING"), store.pointer(), _Scratch(store, run_id)
    ts = F.lit(run_ts).cast("timestamp")
    where = ["preflight"]

    @contextmanager
    def stage(name: str):
        where[0] = name
        t, row = datetime.now(UTC), {"stage_name": name, "rows_out": None}
        yield row
        end = datetime.now(UTC)
        result.stages.append(row | {"stage_order": len(result.stages) + 1, "started_at": t, "ended_at": end, "duration_seconds": (end - t).total_seconds()})

    def finish(status: str, error: str | None = None) -> None:
        result.status = status
        end, c = datetime.now(UTC), result.counts
        history = {
            "run_id": run_id, "run_mode": config.mode, "status": status, "started_at": began, "ended_at": end, "duration_seconds": (end - began).total_seconds(),
            "entities_processed": c.get("entities"), "edges_created": c.get("edges"), "edges_updated": c.get("edges_updated"), "clusters_impacted": c.get("clusters"), "lp_iterations": result.lp_iterations,
            "source_tables_processed": len(meta.active_sources()), "groups_skipped": c.get("skipped"), "values_excluded": c.get("excluded"), "large_clusters": c.get("large"),
            "warnings": json.dumps(result.warnings), "watermarks_json": json.dumps(c.get("watermarks") or {}), "error_message": error, "error_stage": where[0] if error else None, "created_at": end,
        }
        rows = [{"run_id": run_id, "rows_in": None, "notes": None} | s for s in result.stages]
        store.append_all({"run_history": spark.createDataFrame([history], SCHEMAS["run_history"])} | ({"stage_metrics": spark.createDataFrame(rows, SCHEMAS["stage_metrics"])} if rows else {}))

    try:
        report = validate(meta, frames)
        if not report.ok:
            raise ValueError("; ".join(report.errors))
        result.warnings += report.warnings
        marks = {r["table_id"]: str(r["last_watermark_value"]) for r in store.read("run_state", now).collect() if r["last_watermark_value"] is not None}

        with stage("entity_extraction") as s:
            delta, seen = keep.counted(extract.entities(spark, frames, meta, run_id, config.mode, marks))
            s["rows_out"] = result.counts["entities"] = seen["rows"]
        with stage("identifier_extraction") as s:
            made_by = hashlib.sha256(repr((meta.active_sources(), meta.rules, meta.mappings, meta.exclusions)).encode()).hexdigest()[:16]
            known = store.read(IDENTIFIERS, now) if config.mode.upper() != "FULL" and IDENTIFIERS in now else None
            if known is not None and known.where(F.col("made_by") != made_by).isEmpty():
                rows_of = extract.changed(frames, meta, config.mode, marks)  # the others are in the state
            else:
                known, rows_of = None, frames
            flagged = extract.flagged(extract.identifiers(spark, rows_of, meta), meta.exclusions).withColumn("made_by", F.lit(made_by))
            flagged, seen = keep.counted(flagged, IDENTIFIERS if known is None and not config.dry_run else None, excluded=F.count_if("excluded"))
            s["rows_out"], result.counts["excluded"] = seen["rows"], seen["excluded"]
            changed = delta.select("entity_key").distinct()
            every = flagged if known is None else known.join(changed, "entity_key", "left_anti").unionByName(flagged)
            ids = every.where("NOT excluded").drop("excluded", "made_by")
        with stage("edge_building") as s:
            if config.mode.upper() != "FULL":
                mine = flagged.where("NOT excluded") if known is not None else ids
                ids = keep(E.members(ids, E.delta_values(mine, delta)))
            groups, seen = keep.counted(E.group_sizes(ids), big=F.count_if(F.col("group_size") > E.max_group_size(meta)))
            skipped, seen = keep.counted(E.oversized(ids, groups, meta, run_id, ts, few=seen["big"] <= 10_000))
            result.counts["skipped"] = seen["rows"]
            only = EDGES not in now and config.dedup_edges and not config.dry_run  # they are the table as they are
            new, seen = keep.counted(E.star_edges(ids, groups, meta, config.dedup_edges).select(*E.EDGE, ts.alias("first_seen_ts"), ts.alias("last_seen_ts")), EDGES if only else None)
            keep.drop(groups)
            s["rows_out"] = result.counts["edges"] = seen["rows"]
            if EDGES in now:
                old, fresh_keys = store.read(EDGES, now), new.select(*E.EDGE).distinct()
                again, seen = keep.counted(old.join(fresh_keys, E.EDGE, "left_semi"))
                result.counts["edges_updated"] = seen["rows"]
                seen_edges = keep(upserted_edges(again, new, E.EDGE))
                edges = old.join(fresh_keys, E.EDGE, "left_anti").unionByName(seen_edges)
            else:
                result.counts["edges_updated"], seen_edges = 0, new if config.dedup_edges else keep(upserted_edges(new.limit(0), new, E.EDGE))
                edges = seen_edges
        with stage("label_propagation") as s:
            before = store.read(MEMBERS, now)
            touched = E.impacted_nodes(new)
            first = MEMBERS not in now
            alone = first and config.subgraph != "one_hop"  # the first run: the graph is all there is
            if alone and config.algorithm != "hash_min":  # and all nodes have a component
                nodes, sub = None, edges
            elif alone:
                nodes, seen = keep.counted(touched)
                sub = edges
            else:
                nodes, seen = keep.counted(E.one_hop(touched, edges) if config.subgraph == "one_hop" else E.closure(touched, before))
                sub = E.induced(edges, nodes)
            clear = keep.since()
            labels, result.lp_iterations, result.converged = labels_of(nodes, sub, config, keep)
            if first:
                members, seen = keep.counted(C.labelled(labels).withColumn("updated_ts", ts), None if config.dry_run else MEMBERS)
                labels = members.select("entity_key", F.col("resolved_id").alias("label"))
                clear(members)
            s["rows_out"] = seen["rows"]
            if not result.converged:
                if config.on_nonconverged == "raise":
                    raise RuntimeError(f"labels still change after {result.lp_iterations} rounds")
                result.warnings.append(f"labels still change after {result.lp_iterations} rounds")
        with stage("output_generation") as s:
            fresh = delta if first or config.subgraph == "one_hop" else delta.join(before.join(nodes, "entity_key", "left_anti"), "entity_key", "left_anti")
            if first:
                lone, _ = keep.counted(C.lone(labels, fresh).withColumn("updated_ts", ts), None if config.dry_run else MEMBERS)
                update = members.unionByName(lone)
            else:
                update = keep(C.membership(labels, fresh).withColumn("updated_ts", ts))
            large = F.count_if(F.col("cluster_size") >= config.large_cluster_threshold)
            if first:  # every cluster is new
                members, impacted = update, None
            else:
                members = upserted(before, update, ["entity_key"])
                ids_new = update.select("resolved_id").distinct()
                left = before.join(update.select("entity_key"), "entity_key", "left_semi").select("resolved_id").distinct()
                impacted = keep(ids_new if config.keep_orphans else ids_new.union(left).distinct())
            sizes, seen = keep.counted(C.cluster_sizes(members, impacted), large=large)
            result.counts["clusters"], result.counts["large"] = seen["rows"], seen["large"]
            if config.dry_run:
                d = keep(dryrun.diff(members, before, sizes.unionByName(store.read(CLUSTERS, now).select("resolved_id", "cluster_size").join(sizes, "resolved_id", "left_anti")), store.read(CLUSTERS, now), delta, run_id, ts))
                row = dryrun.summary(d).first().asDict()
                result.summary = row | {"edges_would_create": result.counts["edges"], "groups_would_skip": result.counts["skipped"], "values_would_exclude": result.counts["excluded"]}
                result.summary |= dryrun.reshaped(members, before).first().asDict()
                total = {"run_id": run_id, "execution_time_seconds": (datetime.now(UTC) - began).total_seconds(), "created_at": datetime.fromisoformat(run_ts)} | result.summary
                store.append("dry_run_results", d)
                store.append("dry_run_summary", spark.createDataFrame([total], SCHEMAS["dry_run_summary"]))
            else:
                touched_of = lambda df, how: df if impacted is None else df.join(impacted, "resolved_id", how)
                inside = members if impacted is None else keep(touched_of(members, "left_semi"))
                stats = C.edge_stats(inside, edges, config.edge_count, whole=first and result.converged)
                scored = C.confidence(sizes, stats, config.reasons).drop("edge_count").withColumn("updated_ts", ts)
                meta_a = extract.probed_attributes(frames, meta)
                names = tuple(dict.fromkeys([r.attribute for r in meta.survivorship] or [a.name for a in meta_a.attributes if a.name != "record_updated_at"]))
                golden = C.golden_profiles(inside, extract.attributes(spark, frames, meta_a, names), C.survivorship_of(meta, names)).withColumn("updated_ts", ts)
                at = delta.groupBy("table_id").agg(F.max("watermark_value").alias("last_watermark_value")).where("last_watermark_value IS NOT NULL")
                marks_new = keep(at.select("table_id", "last_watermark_value", F.lit(run_id).alias("last_run_id"), ts.alias("last_run_ts")))
                result.counts["watermarks"] = {r["table_id"]: str(r["last_watermark_value"]) for r in marks_new.collect()}
                audit = new.groupBy("rule_id").agg(F.count("*").alias("edges_created")).select(F.lit(run_id).alias("run_id"), "rule_id", "edges_created", ts.alias("started_at"), ts.alias("ended_at"))
                resolved = sizes.select("resolved_id") if impacted is None else impacted
                merged = {
                    EDGES: (seen_edges, seen_edges.select(*E.EDGE)), MEMBERS: (update, update.select("entity_key")), CLUSTERS: (scored, resolved), GOLDEN: (golden, resolved),
                    "run_state": (marks_new, marks_new.select("table_id")),
                }
                more = {"rule_match_audit_current": audit, "skipped_identifier_groups": skipped}
                values = {"entities_processed": result.counts["entities"], "edges_created": result.counts["edges"], "clusters_impacted": result.counts["clusters"], "lp_iterations": result.lp_iterations,
                          "groups_skipped": result.counts["skipped"], "values_excluded": result.counts["excluded"], "large_clusters": result.counts["large"]}
                rows = [(str(uuid.uuid4()), run_id, "idr_" + k, float(v), "gauge" if k in ("large_clusters", "lp_iterations") else "counter", json.dumps({"mode": config.mode}), datetime.fromisoformat(run_ts), None) for k, v in values.items()]
                more["metrics_export"] = spark.createDataFrame(rows, SCHEMAS["metrics_export"])
                parts = {name: store.stage_merge(name, df, keys, now) for name, (df, keys) in merged.items() if name not in keep.placed}
                if known is not None:
                    parts[IDENTIFIERS] = store.stage_merge(IDENTIFIERS, flagged, changed, now)
                parts |= {name: ("parts", placed) for name, placed in keep.placed.items()}
                store.commit(parts | {name: ("append", store.stage(name, df)) for name, df in more.items()}, now)
                keep.committed = True
            s["rows_out"] = result.counts["clusters"]
        if result.counts["skipped"]:
            result.warnings.append(f"{result.counts['skipped']} groups skipped")
        if result.counts["large"]:
            result.warnings.append(f"{result.counts['large']} large clusters")
        if result.counts["excluded"]:
            result.warnings.append(f"{result.counts['excluded']} values excluded")
        finish("DRY_RUN_COMPLETE" if config.dry_run else "SUCCESS_WITH_WARNINGS" if result.warnings else "SUCCESS")
        return result
    except Exception as e:
        warnings.warn(f"run {run_id} failed in {where[0]}", stacklevel=2)
        finish("FAILED", str(e)[:2000])
        raise
    finally:
        keep.end()
