"""The engine on small examples, with values worked out by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinfold.model import Attribute, Exclusion, Mapping, Metadata, Rule, RunConfig, Source, Survivorship
from kinfold.operators import extract
from kinfold.operators.components import components
from kinfold.plans.resolution import CLUSTERS, EDGES, GOLDEN, MEMBERS, run
from kinfold.sources.metadata import from_yaml, validate
from kinfold.sources.state import StateStore

COLUMNS = "entity_id string, email string, phone string, updated_at string"


def meta(*tables: str, email: int = 10_000, exclusions=(), lookback: int = 0) -> Metadata:
    return Metadata(
        tuple(Source(x, x, "entity_id", "updated_at", lookback) for x in tables),
        (Rule("r_email", "EMAIL", "LOWERCASE", email), Rule("r_phone", "PHONE")),
        tuple(Mapping(x, k.upper(), k) for x in tables for k in ("email", "phone")),
        tuple(exclusions),
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "2024-01-01 00:00:00")[:4] if len(r) < 4 else r for r in rows], COLUMNS).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, (tmp_path / "state").as_uri())


def clusters(store) -> dict[str, str]:
    return {r["entity_key"]: r["resolved_id"] for r in store.read(MEMBERS).collect()}


def test_shared_email_any_case_and_chain_and_single(spark, store):
    rows = [("1", "A@x.com", None), ("2", "a@X.com", "555"), ("3", None, "555"), ("4", "other@x.com", None), ("5", None, None)]
    r = run(spark, meta("t"), {"t": frame(spark, rows)}, store, run_ts="2024-02-01 00:00:00")
    assert r.status == "SUCCESS" and r.counts["edges"] == 2
    assert clusters(store) == {"t:1": "t:1", "t:2": "t:1", "t:3": "t:1", "t:4": "t:4", "t:5": "t:5"}
    got = {x["resolved_id"]: x for x in store.read(CLUSTERS).collect()}
    assert got["t:4"]["confidence_score"] == 1.0 and got["t:4"]["primary_reason"] == "SINGLETON_NO_MATCH_REQUIRED"
    assert got["t:1"]["cluster_size"] == 3 and got["t:1"]["edge_diversity"] == 2
    assert {e["identifier_value_norm"] for e in store.read(EDGES).collect()} == {"a@x.com", "555"}


def test_group_above_its_size_is_skipped_and_reported(spark, store):
    rows = [(str(k), "same@x.com", "9" if k < 2 else None) for k in range(5)]
    r = run(spark, meta("t", email=2), {"t": frame(spark, rows)}, store)
    assert r.counts["skipped"] == 1 and len(set(clusters(store).values())) == 4
    s = store.read("skipped_identifier_groups").first()
    assert (s["group_size"], s["max_allowed"], s["reason"]) == (5, 2, "EXCEEDED_MAX_GROUP_SIZE") and s["sample_entity_keys"] == '["t:0","t:1","t:2","t:3","t:4"]'


def test_exclusions_exact_and_like(spark, store):
    rows = [("1", "test@test.com", None), ("2", "TEST@test.com", None), ("3", "a@example.invalid", None), ("4", "a@example.invalid", None), ("5", "v@real.com", None), ("6", "v@real.com", None)]
    m = meta("t", exclusions=(Exclusion("EMAIL", "test@test.com"), Exclusion("EMAIL", "%@example.invalid", "LIKE")))
    r = run(spark, m, {"t": frame(spark, rows)}, store)
    assert r.counts["excluded"] == 4 and r.status == "SUCCESS_WITH_WARNINGS"
    assert len(set(clusters(store).values())) == 5


def test_long_exact_list_is_joined(spark):
    ids = extract.identifiers(spark, {"t": frame(spark, [("1", "a@x", None), ("2", "b@x", None)])}, meta("t"))
    out = extract.without_excluded(ids, tuple(Exclusion("EMAIL", f"{c}@x") for c in "ac"), most_inline=1)
    assert [r["identifier_value_norm"] for r in out.collect()] == ["b@x"] and out.columns == ids.columns


def test_null_keys_values_and_repeated_rows(spark, store):
    rows = [(None, "a@x.com", None), ("1", "a@x.com", None), ("1", "a@x.com", None), ("2", None, "")]
    run(spark, meta("t"), {"t": frame(spark, rows)}, store)
    assert clusters(store) == {"t:1": "t:1", "t:2": "t:2"}


def test_empty_table(spark, store):
    r = run(spark, meta("t"), {"t": frame(spark, [])}, store)
    assert r.lp_iterations == 1 and r.converged and store.read(CLUSTERS).count() == 0


def test_late_link_joins_the_whole_cluster(spark, store):
    """a-b, b-c are one cluster; d then links to c. The exact closure keeps a in; one hop loses it."""
    first = [(k, e, p, f"2024-01-0{d} 00:00:00") for k, e, p, d in (("a", "1@x", None, 1), ("b", "1@x", "5", 1), ("c", "2@x", "5", 1), ("z", None, None, 2))]
    later = [*first, ("d", "2@x", None, "2024-03-01 00:00:00")]
    for how, want in (("exact", {"t:a", "t:z"}), ("one_hop", {"t:a", "t:b", "t:z"})):
        s = StateStore(spark, store.root + how)
        run(spark, meta("t"), {"t": frame(spark, first)}, s, RunConfig(), run_ts="2024-02-01 00:00:00")
        run(spark, meta("t"), {"t": frame(spark, later)}, s, RunConfig(mode="INCR", subgraph=how), run_ts="2024-03-02 00:00:00")
        assert set(clusters(s).values()) == want
        seen = {(e["identifier_value_norm"]): (str(e["first_seen_ts"]), str(e["last_seen_ts"])) for e in s.read(EDGES).collect()}
        assert seen["5"][0].startswith("2024-02-01")
    sizes = {r["resolved_id"]: r["cluster_size"] for r in StateStore(spark, store.root + "exact").read(CLUSTERS).collect()}
    assert sizes == {"t:a": 4, "t:z": 1}


def test_clusters_that_lose_all_entities_go(spark, store):
    run(spark, meta("t"), {"t": frame(spark, [("b", "1@x", None), ("c", "1@x", None)])}, store, run_ts="2024-02-01 00:00:00")
    run(spark, meta("t"), {"t": frame(spark, [("a", "1@x", None), ("b", "1@x", None), ("c", "1@x", None)])}, store, run_ts="2024-02-02 00:00:00")
    assert [r["resolved_id"] for r in store.read(CLUSTERS).collect()] == ["t:a"]


def test_dry_run_leaves_the_state_alone(spark, store):
    run(spark, meta("t"), {"t": frame(spark, [("1", "a@x", None)])}, store)
    before = {k: v for k, v in store.pointer().items() if k in (EDGES, MEMBERS, CLUSTERS, GOLDEN, "run_state", "metrics_export")}
    r = run(spark, meta("t"), {"t": frame(spark, [("1", "a@x", None), ("2", "a@x", None)])}, store, RunConfig(dry_run=True))
    assert r.status == "DRY_RUN_COMPLETE" and {k: v for k, v in store.pointer().items() if k in before} == before
    assert (r.summary["total_entities"], r.summary["new_entities"], r.summary["moved_entities"], r.summary["edges_would_create"]) == (2, 1, 0, 1)
    assert {x["entity_key"]: x["change_type"] for x in store.read("dry_run_results").collect()} == {"t:1": "UNCHANGED", "t:2": "NEW"}


def test_a_failed_run_is_recorded(spark, store):
    bad = Metadata((Source("t", "t", "no_such_column"),), (Rule("r", "EMAIL"),), (Mapping("t", "EMAIL", "email"),))
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no_such_column"):
        run(spark, bad, {"t": frame(spark, [])}, store)
    h = store.read("run_history").first()
    assert h["status"] == "FAILED" and h["error_stage"] == "preflight"


def test_watermark_and_lookback(spark):
    rows = [("1", None, None, "2024-01-01 00:00:00"), ("2", None, None, "2024-01-01 00:30:00"), ("3", None, None, "2024-01-01 01:00:00")]
    of = lambda lb: [r["entity_key"] for r in extract.entities(spark, {"t": frame(spark, rows)}, meta("t", lookback=lb), mode="INCR", marks={"t": "2024-01-01 01:00:00"}).collect()]
    assert of(0) == ["t:3"] and sorted(of(30)) == ["t:2", "t:3"]


def test_golden_profiles_by_strategy(spark, store):
    a = frame(spark, [("1", "old@x", "5", "2024-01-01 00:00:00"), ("2", None, "5", "2024-03-01 00:00:00")])
    b = frame(spark, [("1", "new@x", "5", "2024-02-01 00:00:00")])
    base = meta("a", "b")
    from dataclasses import replace

    m = replace(base, sources=(replace(base.sources[0], trust_rank=1), replace(base.sources[1], trust_rank=2)), attributes=tuple(Attribute(x, "email", "email") for x in "ab"))
    for strategy, want in (("MOST_RECENT", "new@x"), ("SOURCE_PRIORITY", "old@x"), ("SOURCE_PRIORITY + MOST_RECENT", "old@x")):
        s = StateStore(spark, store.root + strategy.replace(" ", "").replace("+", "_"))
        run(spark, replace(m, survivorship=(Survivorship("email", strategy),)), {"a": a, "b": b}, s)
        assert s.read(GOLDEN).first()["email_primary"] == want


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, store, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    n = [0]

    def keep(d):
        n[0] += 1
        d.write.parquet(f"{store.root}/k{n[0]}")
        return spark.read.parquet(f"{store.root}/k{n[0]}")

    got, _, converged = components(df, "a", "b", keep)
    assert converged and {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}


def test_state_store(spark, store):
    d = lambda *rows: spark.createDataFrame(rows, "table_id string, last_watermark_value timestamp, last_run_id string, last_run_ts timestamp")
    store.append("run_state", d(("a", None, "1", None), ("b", None, "1", None)))
    store.snapshot("one")
    store.upsert("run_state", d(("b", None, "2", None)), ["table_id"])
    get = lambda: sorted((r["table_id"], r["last_run_id"]) for r in store.read("run_state").collect())
    assert get() == [("a", "1"), ("b", "2")]
    store.restore("one")
    assert get() == [("a", "1"), ("b", "1")]
    store.reset()
    assert get() == []


def test_validation_and_yaml(spark):
    m = from_yaml("""
rules: [{type: EMAIL, canonicalize: lowercase}, {type: PHONE, max_group_size: 7}]
sources:
  - {id: t, table: t, entity_key: entity_id, watermark: updated_at, identifiers: [{type: EMAIL, column: email}, {type: SSN, column: ssn}]}
exclusions: [{type: EMAIL, pattern: "x@%", match: LIKE}]
survivorship: [{attribute: email, strategy: SOURCE_PRIORITY, source_priority: "a > b"}]
""")
    assert (m.rules[1].max_group_size, m.rules[0].canonicalize, m.survivorship[0].source_priority, m.exclusions[0].match_type) == (7, "LOWERCASE", ("a", "b"), "LIKE")
    r = validate(m, {"t": frame(spark, [])})
    assert not r.ok and any("SSN" in e for e in r.errors) and any("ssn" in e for e in r.errors) and any("PHONE" in w for w in r.warnings)
