"""Metadata of a resolution run, as plain values on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Source:
    table_id: str
    table: str
    entity_key_expr: str
    watermark_column: str | None = None
    lookback_minutes: int = 0
    entity_type: str = "PERSON"
    is_active: bool = True
    source_name: str | None = None
    trust_rank: int = 99


@dataclass(frozen=True)
class Rule:
    rule_id: str
    identifier_type: str
    canonicalize: str = "NONE"
    max_group_size: int = 10_000
    is_active: bool = True
    priority: int = 100
    require_non_null: bool = True
    allow_hashed: bool = True
    rule_name: str | None = None


@dataclass(frozen=True)
class Mapping:
    table_id: str
    identifier_type: str
    expr: str
    is_hashed: bool = False


@dataclass(frozen=True)
class Exclusion:
    identifier_type: str
    pattern: str
    match_type: str = "EXACT"
    reason: str | None = None


@dataclass(frozen=True)
class Attribute:
    table_id: str
    name: str
    expr: str


@dataclass(frozen=True)
class Survivorship:
    """strategy: MOST_RECENT, SOURCE_PRIORITY, or both joined by ` + `. source_priority: table ids or source names, best first."""

    attribute: str
    strategy: str = "MOST_RECENT"
    source_priority: tuple[str, ...] = ()
    recency_field: str | None = None


@dataclass(frozen=True)
class Metadata:
    sources: tuple[Source, ...]
    rules: tuple[Rule, ...]
    mappings: tuple[Mapping, ...]
    exclusions: tuple[Exclusion, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    survivorship: tuple[Survivorship, ...] = ()

    def active_sources(self) -> list[Source]:
        return [s for s in self.sources if s.is_active]

    def active_rules(self, identifier_type: str | None = None) -> list[Rule]:
        return [r for r in self.rules if r.is_active and identifier_type in (None, r.identifier_type)]

    def mappings_of(self, table_id: str) -> list[Mapping]:
        return [m for m in self.mappings if m.table_id == table_id]


@dataclass(frozen=True)
class RunConfig:
    """subgraph: `exact` takes in the whole clusters that are touched, `one_hop` only neighbours. algorithm: `hash_min`
    counts rounds of label propagation, `alternating` uses star steps. on_nonconverged: `warn` or `raise`.
    reasons: `short` or `detailed`. edge_count: `doubled` counts each edge at both ends, `unique` once."""

    mode: str = "FULL"
    dry_run: bool = False
    max_iters: int = 30
    subgraph: str = "exact"
    algorithm: str = "hash_min"
    on_nonconverged: str = "warn"
    dedup_edges: bool = True
    keep_orphans: bool = False
    reasons: str = "short"
    edge_count: str = "doubled"
    large_cluster_threshold: int = 1000
    extra: dict = field(default_factory=dict, hash=False, compare=False)
