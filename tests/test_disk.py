"""What whole-cluster queries leave on disk while they run: work tables that are still read, and no shuffle files."""

from __future__ import annotations

import random
import time
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from kinfold import queries as Q
from kinfold.model import Survivorship
from kinfold.operators import clusters as C
from kinfold.operators.components import component_sizes, components
from kinfold.plans.resolution import run
from kinfold.sources import scratch
from kinfold.sources.state import StateStore

SF = "/root/testdata/sf0.001"


def shuffle_files(spark) -> set:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def none_since(spark, left: set) -> bool:
    """Whether there are no other shuffle files than these; Spark removes them beside what the driver does next."""
    for _ in range(50):
        if not shuffle_files(spark) - left:
            return True
        time.sleep(0.1)
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_string_components_equal_union_find(spark, tmp_path, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(60)}") for _ in range(45)] + [(None, "n1"), ("n2", None)]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x and y and x != y:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    keep = scratch.Scratch(spark, tmp_path.as_uri())
    got, _, converged = components(keep(spark.createDataFrame(edges, "a string, b string")), "a", "b", keep)
    rows = got.collect()
    assert converged and len(rows) == len(parent) and {r["node"]: r["component"] for r in rows} == {x: find(x) for x in parent}


def test_rounds_join_anchors_only_and_their_tables_go(spark, tmp_path):
    """40 stars of 20, chained by one member each; the rounds have 39 edges, not 800."""
    edges = [(f"a{k:02}", f"m{k:02}-{j:02}") for k in range(40) for j in range(20)] + [(f"a{k:02}", f"m{k + 1:02}-00") for k in range(39)]
    keep, rows = scratch.Scratch(spark, tmp_path.as_uri()), []

    class Counting:
        def __call__(self, df):
            rows.append((df.columns, len((df := keep(df)).collect())))
            return df

        drop = keep.drop

    left = shuffle_files(spark)
    got, _, _ = components(keep(spark.createDataFrame(edges, "a string, b string")), "a", "b", Counting())
    assert none_since(spark, left)
    assert [n for c, n in rows if c == ["u", "v"]] and max(n for c, n in rows if c == ["u", "v"]) == 39
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 3  # the edges, the nodes' anchors and the anchors' labels
    assert {r["component"] for r in got.collect()} == {"a00"} and got.count() == 840


def test_full_run_writes_state_once(spark, tmp_path, monkeypatch):
    """identifiers, edges and members are written where they stay, and not as work tables too."""
    written = []
    first = scratch.put
    put = lambda df, path: written.append((path, sorted(df.columns))) or first(df, path)
    for m in ("kinfold.sources.scratch", "kinfold.sources.state", "kinfold.plans.resolution"):
        monkeypatch.setattr(f"{m}.put", put)
    store, left = StateStore(spark, tmp_path.as_uri()), shuffle_files(spark)
    run(spark, Q.META, Q.frames(spark, SF), store, Q.RunConfig(algorithm="alternating"))
    columns = [c for _, c in written]
    for table in ("identifiers_current", "identity_edges_current"):
        assert columns.count(sorted(store.read(table).columns)) == 1
    assert sum("updated_ts" in c and "entity_key" in c for c in columns) == 2  # labelled nodes, lone entities
    assert none_since(spark, left) and not list((tmp_path / "_work").iterdir())
    s = store.read("identity_clusters_current").agg(F.sum("cluster_size")).first()[0]
    assert s == store.read(Q.MEMBERS).count() == store.read(Q.MEMBERS).select("entity_key").distinct().count()


def test_failed_run_leaves_no_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("kinfold.plans.resolution.components", lambda *a: 1 / 0)
    store = StateStore(spark, tmp_path.as_uri())
    with pytest.raises(ZeroDivisionError):
        run(spark, Q.META, Q.frames(spark, SF), store, Q.RunConfig(algorithm="alternating"))
    assert Q.EDGES not in store.pointer() and not list((tmp_path / Q.EDGES).glob("v-*"))


def test_golden_profiles_shuffle_only_rows_with_an_attribute(spark):
    """rows without any attribute are left out before the join, clusters without such rows stay."""
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "entity_key string, resolved_id string")
    rows = [("a", "t", 1, "s1"), ("b", "t", 1, None), ("c", "t", 1, None)]
    attributes = spark.createDataFrame(rows, "entity_key string, table_id string, trust_rank int, segment string").withColumn("recency", F.lit("2024-01-01").cast("timestamp"))
    got = C.golden_profiles(members, attributes.repartition(2), (Survivorship("segment", "SOURCE_PRIORITY + MOST_RECENT"),))
    assert sorted(map(tuple, got.collect())) == [("x", "s1"), ("y", None)]
    assert "isnotnull(segment" in got._jdf.queryExecution().optimizedPlan().toString()


def test_edge_stats_of_whole_clusters(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "entity_key string, resolved_id string")
    edges = spark.createDataFrame([("a", "b", "E"), ("b", "c", "P"), ("a", "c", "E")], "left_entity_key string, right_entity_key string, identifier_type string")
    for count in ("doubled", "unique"):
        assert C.edge_stats(members, edges, count, whole=True).collect() == C.edge_stats(members, edges, count).collect()


def test_cluster_sizes_read_two_tables(spark):
    """when the members are there, edges and the tables of the rounds are gone."""
    before = len(scratch._made)
    Q.members_of(spark, SF)
    (_, path), = scratch._made[before:]
    assert len([p for p in Path(urlparse(path).path).iterdir() if p.is_dir()]) == 2


@pytest.mark.parametrize("seed, passes", [(1, 1), (2, 3)])
def test_component_sizes_equal_union_find(spark, tmp_path, seed, passes):
    """nodes of several anchors, edges that repeat or go both ways, and null ends count once."""
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(50)}", f"n{rnd.randrange(90)}") for _ in range(60)]
    edges += edges[:20] + [(y, x) for x, y in edges[10:30]] + [(None, "n1"), ("n2", None), ("self", "self")]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x and y and x != y:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    keep = scratch.Scratch(spark, tmp_path.as_uri())
    got, _, converged = component_sizes(keep(spark.createDataFrame(edges, "a string, b string")), "a", "b", keep, passes)
    assert converged and sorted(map(tuple, got.collect())) == sorted(Counter(map(find, list(parent))).items())


def test_cluster_sizes_write_no_row_for_a_member(spark, monkeypatch):
    """beside edges and lone entities there are rows for anchors and links only, and no shuffle files are left."""
    rows, first = {}, scratch.put

    def put(df, path, *more):
        left = shuffle_files(spark)
        df = first(df, path, *more)
        rows.setdefault(tuple(df.columns), []).append(len(df.collect()))
        assert none_since(spark, left)
        return df

    monkeypatch.setattr("kinfold.sources.scratch.put", put)
    before = len(scratch._made)
    got = sorted(map(tuple, Q.p31_cluster_sizes(spark, SF).collect()))
    (_, path), = scratch._made[before:]
    assert len([p for p in Path(urlparse(path).path).iterdir() if p.is_dir()]) == 3  # anchors' counts and labels, lone entities
    entities = sum(size for _, size in got)
    edges = rows.pop(("left_entity_key", "right_entity_key"))[0]
    assert max(max(x) for x in rows.values()) < min(edges, entities) / 2
    assert sorted(map(tuple, Q.sizes_of(spark, SF, 3).collect())) == got
    assert sorted(map(tuple, C.cluster_sizes(Q.members_of(spark, SF)).collect())) == got


def test_shares_have_each_row_once_and_keys_together(spark):
    rows = spark.createDataFrame([(k % 7, str(k % 7), k) for k in range(100)] + [(None, None, 100)], "a long, b string, c long")
    parts = [{tuple(r) for r in scratch.share(rows, k, 3, "a", "b").collect()} for k in range(3)]
    assert sum(map(len, parts)) == 101 == len(set().union(*parts)) and all(not {x[:2] for x in p} & {x[:2] for x in q} for p in parts for q in parts if p is not q)
    assert scratch.passes([Q.t(spark, SF, "lineitem")]) == 1 and scratch.passes([Q.t(spark, SF, "lineitem")] * 2, each=100_000, most=2) == 2
