"""Metadata from dictionaries, YAML, CSV files or tables, and its validation."""

from __future__ import annotations

from collections.abc import Mapping as Dict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CANONICAL
from ..model import Attribute, Exclusion, Mapping, Metadata, Rule, Source, Survivorship


def _flag(x, default: bool = True) -> bool:
    return default if x is None or x == "" else str(x).strip().lower() in ("true", "1", "yes", "t")


def _priority(x) -> tuple[str, ...]:
    if not x:
        return ()
    return tuple(x) if isinstance(x, (list, tuple)) else tuple(p.strip() for p in str(x).replace(">", ",").split(",") if p.strip())


def from_rows(tables: Dict[str, list[dict]]) -> Metadata:
    """tables: source_table, source, rule, identifier_mapping, identifier_exclusion, entity_attribute_mapping, survivorship_rule."""
    get = lambda name: tables.get(name) or []
    trust = {r["table_id"]: r for r in get("source")}
    sources = tuple(
        Source(
            r["table_id"], r.get("table_fqn") or r["table_id"], r["entity_key_expr"], r.get("watermark_column") or None, int(r.get("watermark_lookback_minutes") or 0),
            r.get("entity_type") or "PERSON", _flag(r.get("is_active")), trust.get(r["table_id"], {}).get("source_name"), int(trust.get(r["table_id"], {}).get("trust_rank") or 99),
        )
        for r in get("source_table")
    )
    rules = tuple(
        Rule(
            r["rule_id"], r["identifier_type"], (r.get("canonicalize") or "NONE").upper(), int(r.get("max_group_size") or 10_000), _flag(r.get("is_active")), int(r.get("priority") or 100),
            _flag(r.get("require_non_null")), _flag(r.get("allow_hashed")), r.get("rule_name"),
        )
        for r in get("rule")
    )
    return Metadata(
        sources, rules,
        tuple(Mapping(r["table_id"], r["identifier_type"], r["identifier_value_expr"], _flag(r.get("is_hashed"), False)) for r in get("identifier_mapping")),
        tuple(Exclusion(r["identifier_type"], r["identifier_value_pattern"], (r.get("match_type") or "EXACT").upper(), r.get("reason")) for r in get("identifier_exclusion")),
        tuple(Attribute(r["table_id"], r["attribute_name"], r["attribute_expr"]) for r in get("entity_attribute_mapping")),
        tuple(Survivorship(r["attribute_name"], r.get("strategy") or "MOST_RECENT", _priority(r.get("source_priority_list")), r.get("recency_field")) for r in get("survivorship_rule")),
    )


def from_yaml(text: str) -> Metadata:
    """Sections rules, sources (with identifiers and attributes), survivorship and exclusions."""
    import yaml

    doc = yaml.safe_load(text) or {}
    out: dict[str, list[dict]] = {k: [] for k in ("source_table", "source", "rule", "identifier_mapping", "identifier_exclusion", "entity_attribute_mapping", "survivorship_rule")}
    for r in doc.get("rules", []):
        kind = r.get("identifier_type") or r.get("type")
        out["rule"].append({**r, "identifier_type": kind, "rule_id": r.get("rule_id") or r.get("id") or f"rule_{kind}"})
    for s in doc.get("sources", []):
        tid = s.get("table_id") or s.get("id") or s["name"]
        out["source_table"].append({
            "table_id": tid, "table_fqn": s.get("table_fqn") or s.get("table") or tid, "entity_type": s.get("entity_type"), "entity_key_expr": s.get("entity_key_expr") or s.get("entity_key"),
            "watermark_column": s.get("watermark_column") or s.get("watermark"), "watermark_lookback_minutes": s.get("watermark_lookback_minutes") or s.get("lookback_minutes"), "is_active": s.get("is_active"),
        })
        out["source"].append({"table_id": tid, "source_name": s.get("name"), "trust_rank": s.get("trust_rank")})
        for m in s.get("identifiers", []):
            out["identifier_mapping"].append({"table_id": tid, "identifier_type": m.get("identifier_type") or m.get("type"), "identifier_value_expr": m.get("expr") or m.get("column"), "is_hashed": m.get("is_hashed")})
        for a in s.get("attributes", []):
            out["entity_attribute_mapping"].append({"table_id": tid, "attribute_name": a["name"], "attribute_expr": a.get("expr") or a.get("column")})
    for s in doc.get("survivorship", []):
        out["survivorship_rule"].append({"attribute_name": s.get("attribute_name") or s.get("attribute"), "strategy": s.get("strategy"), "source_priority_list": s.get("source_priority_list") or s.get("source_priority"), "recency_field": s.get("recency_field")})
    for e in doc.get("exclusions", []):
        out["identifier_exclusion"].append({"identifier_type": e.get("identifier_type") or e.get("type"), "identifier_value_pattern": e.get("identifier_value_pattern") or e.get("pattern") or e.get("value"), "match_type": e.get("match_type") or e.get("match"), "reason": e.get("reason")})
    return from_rows(out)


def from_tables(frames: Dict[str, DataFrame]) -> Metadata:
    """Metadata tables are configuration of a few rows and are read to the driver."""
    return from_rows({name: [r.asDict() for r in df.collect()] for name, df in frames.items()})


def from_csv(spark: SparkSession, paths: Dict[str, str]) -> Metadata:
    return from_tables({name: spark.read.option("header", True).csv(p) for name, p in paths.items()})


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def validate(meta: Metadata, frames: Dict[str, DataFrame] | None = None) -> Report:
    """Errors stop a run. Expressions are analysed against their table; no job runs."""
    r = Report()
    active = {s.table_id for s in meta.active_sources()}
    ruled = {x.identifier_type for x in meta.active_rules()}
    if not active:
        r.errors.append("no active source")
    if not ruled:
        r.errors.append("no active rule")
    ids = [s.table_id for s in meta.sources]
    r.errors += [f"source {t} is there twice" for t in sorted({t for t in ids if ids.count(t) > 1})]
    for x in meta.rules:
        if x.canonicalize.upper() not in CANONICAL:
            r.errors.append(f"rule {x.rule_id}: no canonical form {x.canonicalize}")
        if x.max_group_size < 1:
            r.errors.append(f"rule {x.rule_id}: max_group_size {x.max_group_size}")
    kinds = [x.identifier_type for x in meta.active_rules()]
    r.warnings += [f"{k} has several active rules; groups are built for each" for k in sorted({k for k in kinds if kinds.count(k) > 1})]
    mapped = set()
    for m in meta.mappings:
        if m.table_id not in active:
            r.warnings.append(f"mapping of {m.identifier_type} on {m.table_id}: no such active source")
        elif m.identifier_type not in ruled:
            r.errors.append(f"mapping of {m.identifier_type} on {m.table_id}: no active rule of that type")
        mapped.add((m.table_id, m.identifier_type))
    r.warnings += [f"source {t} has no identifier mapping" for t in sorted(active) if not any(t == a for a, _ in mapped)]
    r.warnings += [f"rule type {k} is mapped nowhere" for k in sorted(ruled) if not any(k == b for _, b in mapped)]
    for e in meta.exclusions:
        if e.match_type.upper() not in ("EXACT", "LIKE"):
            r.errors.append(f"exclusion {e.pattern}: no match type {e.match_type}")
    if frames is not None:
        for s in meta.active_sources():
            df = frames.get(s.table_id)
            if df is None:
                r.errors.append(f"source {s.table_id}: no table {s.table}")
                continue
            for what, expr in [("key", s.entity_key_expr), *([("watermark", s.watermark_column)] if s.watermark_column else []), *((m.identifier_type, m.expr) for m in meta.mappings_of(s.table_id)), *((a.name, a.expr) for a in meta.attributes if a.table_id == s.table_id)]:
                try:
                    _ = df.select(F.expr(expr)).schema
                except Exception as e:  # whatever the parser or the analyser says of a user's expression
                    r.errors.append(f"source {s.table_id}, {what}: {expr!r}: {str(e).splitlines()[0][:200]}")
    return r
