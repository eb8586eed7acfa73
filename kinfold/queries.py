"""Queries over the driver's tables: one for each operator, with its SQL for DuckDB where SQL can express it.

Names begin with the operator's id in the survey. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import checks as K
from .functions import scalars as S
from .functions import transforms as T
from .model import Attribute, Exclusion, Mapping, Metadata, Rule, RunConfig, Source, Survivorship
from .operators import clusters as C
from .operators import dryrun as D
from .operators import edges as E
from .operators import extract as X
from .operators import reports as R
from .operators.components import component_sizes, components
from .plans.resolution import CLUSTERS, EDGES, GOLDEN, MEMBERS, run
from .sources.scratch import Scratch, folder, passes, share
from .sources.state import SCHEMAS, StateStore, upserted, upserted_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


META = Metadata(
    (Source("cust", "customer", "c_custkey", None, trust_rank=1), Source("ord", "orders", "o_orderkey", "o_orderdate", trust_rank=2),
     Source("li", "lineitem", "concat_ws('-', l_orderkey, l_linenumber)", "l_shipdate", trust_rank=3), Source("ev", "events", "event_id", "ts", 60, trust_rank=4)),
    (Rule("r_cust", "CUST"), Rule("r_order", "ORDER")),
    (Mapping("cust", "CUST", "c_custkey"), Mapping("ord", "CUST", "o_custkey"), Mapping("ord", "ORDER", "o_orderkey"), Mapping("li", "ORDER", "l_orderkey"), Mapping("ev", "CUST", "user_id")),
    attributes=(Attribute("cust", "name", "c_name"), Attribute("cust", "segment", "c_mktsegment"), Attribute("ord", "segment", "o_orderpriority"), Attribute("ev", "segment", "event_type")),
    survivorship=(Survivorship("name"), Survivorship("segment")),
)


def frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {s.table_id: t(spark, sf, s.table) for s in META.sources}


def nation_meta(max_size: int) -> Metadata:
    return Metadata((Source("cust", "customer", "c_custkey"),), (Rule("r_nation", "NATION", max_group_size=max_size), Rule("r_segment", "SEG", "LOWERCASE", max_group_size=10)),
                    (Mapping("cust", "NATION", "c_nationkey"), Mapping("cust", "SEG", "c_mktsegment")))


def ids_of(spark: SparkSession, sf: str) -> DataFrame:
    return X.identifiers(spark, frames(spark, sf), META)


def edges_of(spark: SparkSession, sf: str, k: int = 0, n: int = 1) -> DataFrame:
    ids = share(ids_of(spark, sf), k, n, *E.GROUP)
    return E.star_edges(ids, E.group_sizes(ids), META)


def _keep(spark: SparkSession) -> Scratch:
    return Scratch(spark, folder(spark, "query"))


def _labels_of(edges: DataFrame, keep: Scratch) -> DataFrame:
    comps, rounds, converged = components(edges, "left_entity_key", "right_entity_key", keep)
    if not converged:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return comps.select(F.col("node").alias("entity_key"), F.col("component").alias("label"))


def _members_of(spark: SparkSession, sf: str, edges: DataFrame, keep: Scratch, last: bool) -> DataFrame:
    """Members whose labels and lone entities are tables. last: nothing reads the edges after this."""
    clear = keep.since()
    comps = _labels_of(edges, keep)
    if last:
        keep.drop(edges)
    labels = keep(comps)
    clear(labels)
    lone = keep(C.lone(labels, X.entities(spark, frames(spark, sf), META)))
    return C.labelled(labels).unionByName(lone)


def graph_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(edges, members), written once for all that reads them."""
    keep = _keep(spark)
    edges = keep(edges_of(spark, sf))
    return edges, _members_of(spark, sf, edges, keep, last=False)


def members_of(spark: SparkSession, sf: str) -> DataFrame:
    keep = _keep(spark)
    return _members_of(spark, sf, keep(edges_of(spark, sf).select("left_entity_key", "right_entity_key")), keep, last=True)


def sizes_of(spark: SparkSession, sf: str, n: int | None = None) -> DataFrame:
    """(resolved_id, cluster_size) without members. The sources are read in n passes, by their size if it is not given."""
    keep, sources = _keep(spark), frames(spark, sf)
    n = n or passes(sources.values())
    edges = keep(*(edges_of(spark, sf, k, n).select("left_entity_key", "right_entity_key") for k in range(n)))
    linked = edges.select(F.col("right_entity_key").alias("entity_key")).union(edges.select("left_entity_key").distinct())
    every = X.entities(spark, sources, META)
    lone = keep(*(C.lone(share(linked, k, n, "entity_key"), share(every, k, n, "entity_key")) for k in range(n)))
    sizes, rounds, converged = component_sizes(edges, "left_entity_key", "right_entity_key", keep, n)
    if not converged:
        raise RuntimeError(f"components still change after {rounds} rounds")
    sizes = sizes.select(F.col("component").alias("resolved_id"), F.col("size").alias("cluster_size"))
    return sizes.unionByName(C.cluster_sizes(lone))


IDS = """ids AS (
  SELECT 'cust' AS table_id, 'cust:' || c_custkey AS k, 'r_cust' AS rule_id, 'CUST' AS ty, c_custkey::VARCHAR AS v FROM customer
  UNION ALL SELECT 'ord', 'ord:' || o_orderkey, 'r_cust', 'CUST', o_custkey::VARCHAR FROM orders
  UNION ALL SELECT 'ord', 'ord:' || o_orderkey, 'r_order', 'ORDER', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'li', 'li:' || l_orderkey || '-' || l_linenumber, 'r_order', 'ORDER', l_orderkey::VARCHAR FROM lineitem
  UNION ALL SELECT 'ev', 'ev:' || event_id, 'r_cust', 'CUST', user_id::VARCHAR FROM events)"""
ENT = """ent AS (
  SELECT 'cust' AS table_id, 'cust:' || c_custkey AS k, NULL::TIMESTAMP AS wm FROM customer UNION ALL SELECT 'ord', 'ord:' || o_orderkey, o_orderdate FROM orders
  UNION ALL SELECT 'li', 'li:' || l_orderkey || '-' || l_linenumber, l_shipdate FROM lineitem UNION ALL SELECT 'ev', 'ev:' || event_id, ts FROM events)"""
GRP = "g AS (SELECT rule_id, ty, v, count(*) AS n, min(k) AS a FROM ids GROUP BY ALL)"
EDG = "e AS (SELECT DISTINCT ids.rule_id, a AS l, k AS r, ids.ty, ids.v FROM g JOIN ids USING (rule_id, ty, v) WHERE n <= 10000 AND k <> a)"
CC = """u(s, d) AS (SELECT DISTINCT l, r FROM e UNION SELECT r, l FROM e),
cc(n, l) AS (SELECT DISTINCT s, s FROM u UNION SELECT u.d, cc.l FROM cc JOIN u ON u.s = cc.n WHERE cc.l < u.d),
lab AS (SELECT n AS k, min(l) AS c FROM cc GROUP BY n),
mem AS (SELECT k, c FROM lab UNION ALL SELECT DISTINCT k, k FROM ent WHERE k NOT IN (SELECT k FROM lab))"""
BASE = f"WITH RECURSIVE {IDS}, {ENT}, {GRP}, {EDG}, {CC}"


# ---- sources and sinks -------------------------------------------------------------------------------------------
@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s02_parquet_read(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("SELECT p_partkey, p_size::INTEGER AS p_size FROM part")
def s03_csv_round_trip(spark, sf):
    path = folder(spark, "csv")
    t(spark, sf, "part").select("p_partkey", "p_size").write.option("header", True).csv(path)
    return spark.read.option("header", True).csv(path).selectExpr("CAST(p_partkey AS bigint) AS p_partkey", "CAST(p_size AS int) AS p_size")


@query("SELECT * FROM (VALUES (1::INTEGER, 'a'), (2, NULL)) x(i, s)")
def s07_inline_rows(spark, sf):
    return spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")


@query("SELECT range AS generated_number FROM range(1, 1001)")
def s08_row_generator(spark, sf):
    return T.generate_series(spark, 1000)


@query("SELECT c_custkey, c_name FROM customer")
def k10_parquet_export(spark, sf):
    path = folder(spark, "export")
    t(spark, sf, "customer").select("c_custkey", "c_name").write.option("compression", "snappy").parquet(path)
    return spark.read.parquet(path)


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN -1.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT -1, 0.0")
def k04_upsert(spark, sf):
    cur = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    upd = cur.where("s_nationkey < 5").select("s_suppkey", F.lit(-1.0).alias("s_acctbal")).union(spark.createDataFrame([(-1, 0.0)], "s_suppkey long, s_acctbal double"))
    return upserted(cur.drop("s_nationkey"), upd, ["s_suppkey"])


@query("SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 10 THEN 1 ELSE 2 END AS first_seen, CASE WHEN n_nationkey < 5 THEN 1 ELSE 2 END AS last_seen FROM nation")
def k05_edge_upsert_first_last_seen(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    of = lambda df, d: df.withColumns({"first_seen_ts": day(d), "last_seen_ts": day(d)})
    return upserted_edges(of(n.where("k < 10"), 1), of(n.where("k >= 5"), 2), ["k"]).select("k", F.dayofmonth("first_seen_ts").alias("first_seen"), F.dayofmonth("last_seen_ts").alias("last_seen"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY 1")
def k08_retention(spark, sf):
    ev, store = t(spark, sf, "events"), StateStore(spark, folder(spark, "state"))
    store.replace("events", ev.select("event_id", "ts", "event_type"))
    bound = ev.agg((F.max("ts") - F.expr("INTERVAL 5 DAY")).alias("b")).first()["b"]
    store.purge("events", "ts", str(bound))
    return store.read("events").groupBy("event_type").agg(F.count("*").alias("n"))


# ---- the pipeline ------------------------------------------------------------------------------------------------
@query("SELECT 'ev:' || event_id AS entity_key, ts AS watermark_value FROM events WHERE ts >= (TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 60 MINUTE)")
def p05_watermark_predicate(spark, sf):
    from dataclasses import replace

    only = replace(META, sources=(META.sources[3],))
    return X.entities(spark, frames(spark, sf), only, mode="INCR", marks={"ev": "2024-01-10 00:00:00"}).select("entity_key", "watermark_value")


@query(f"WITH {ENT} SELECT table_id, k AS entity_key, wm AS watermark_value FROM ent")
def p06_entities(spark, sf):
    return X.entities(spark, frames(spark, sf), META).select("table_id", "entity_key", "watermark_value")


@query(f"WITH {IDS} SELECT table_id, k AS entity_key, ty AS identifier_type, v AS identifier_value_norm FROM ids")
def p07_identifiers(spark, sf):
    return ids_of(spark, sf).select("table_id", "entity_key", "identifier_type", "identifier_value_norm")


@query("SELECT 'cust:' || c_custkey AS entity_key, lower(c_mktsegment) AS identifier_value_norm FROM customer WHERE c_mktsegment IS NOT NULL")
def p08_canonicalize(spark, sf):
    return X.identifiers(spark, frames(spark, sf), nation_meta(10)).where("identifier_type = 'SEG'").select("entity_key", "identifier_value_norm")


EXCL = (Exclusion("CUST", "7"), Exclusion("CUST", "1%", "LIKE"), Exclusion("ORDER", "_3", "LIKE"))
NOT_EXCL = "NOT (ty = 'CUST' AND (v = '7' OR v LIKE '1%')) AND NOT (ty = 'ORDER' AND v LIKE '_3')"


@query(f"WITH {IDS} SELECT ty AS identifier_type, count(*) AS n, count(DISTINCT v) AS n_values FROM ids WHERE {NOT_EXCL} GROUP BY 1")
def p10_exclusions(spark, sf):
    return X.without_excluded(ids_of(spark, sf), EXCL).groupBy("identifier_type").agg(F.count("*").alias("n"), F.countDistinct("identifier_value_norm").alias("n_values"))


@query(f"WITH {IDS} SELECT count(*) FILTER (NOT ({NOT_EXCL})) AS excluded FROM ids")
def p11_excluded_count(spark, sf):
    i = ids_of(spark, sf)
    return i.agg(F.count_if(X.excluded(i, EXCL)).alias("excluded"))


@query(f"WITH {IDS} SELECT DISTINCT ty AS identifier_type, v AS identifier_value_norm FROM ids WHERE k LIKE 'ev:%'")
def p12_delta_values(spark, sf):
    ids = ids_of(spark, sf)
    return E.delta_values(ids, ids.where("table_id = 'ev'"))


@query(f"WITH {IDS} SELECT k AS entity_key, ty AS identifier_type, v AS identifier_value_norm FROM ids JOIN (SELECT DISTINCT ty, v FROM ids WHERE table_id = 'ev') USING (ty, v)")
def p13_members_for_delta(spark, sf):
    ids = ids_of(spark, sf)
    return E.members(ids, E.delta_values(ids, ids.where("table_id = 'ev'"))).select("entity_key", "identifier_type", "identifier_value_norm")


@query(f"WITH {IDS}, {GRP} SELECT rule_id, ty AS identifier_type, v AS identifier_value_norm, n AS group_size, a AS anchor FROM g")
def p14_group_sizes(spark, sf):
    return E.group_sizes(ids_of(spark, sf))


NAT = """i AS (SELECT 'cust:' || c_custkey AS k, c_nationkey::VARCHAR AS v FROM customer WHERE c_nationkey IS NOT NULL),
s AS (SELECT v, count(*) AS n, list_slice(list_sort(list(k)), 1, 5) AS ks FROM i GROUP BY v HAVING count(*) > 40)"""


@query(f"WITH {NAT} SELECT v AS identifier_value_norm, n AS group_size, 40::BIGINT AS max_allowed, '[' || array_to_string(list_transform(ks, lambda x: '\"' || x || '\"'), ',') || ']' AS sample_entity_keys, 'EXCEEDED_MAX_GROUP_SIZE' AS reason FROM s")
def p15_oversized_groups(spark, sf):
    ids = X.identifiers(spark, frames(spark, sf), nation_meta(40)).where("identifier_type = 'NATION'")
    big = E.oversized(ids, E.group_sizes(ids), nation_meta(40))
    return big.select("identifier_value_norm", "group_size", F.col("max_allowed").cast("long").alias("max_allowed"), "sample_entity_keys", "reason")


@query(f"WITH {NAT} SELECT v AS identifier_value_norm, n AS group_size FROM s ORDER BY n DESC, v LIMIT 3")
def p16_top_offenders(spark, sf):
    ids = X.identifiers(spark, frames(spark, sf), nation_meta(40)).where("identifier_type = 'NATION'")
    return E.top_offenders(E.oversized(ids, E.group_sizes(ids), nation_meta(40))).select("identifier_value_norm", "group_size")


@query(f"WITH {IDS}, {GRP}, {EDG} SELECT rule_id, l AS left_entity_key, r AS right_entity_key, ty AS identifier_type, v AS identifier_value_norm FROM e")
def p18_star_edges(spark, sf):
    return edges_of(spark, sf)


@query(f"WITH {IDS}, {GRP}, {EDG} SELECT l AS entity_key FROM e UNION SELECT r FROM e")
def p20_impacted_nodes(spark, sf):
    return E.impacted_nodes(edges_of(spark, sf))


@query(f"WITH {IDS}, {GRP}, {EDG}, s AS (SELECT k FROM ids WHERE table_id = 'cust') SELECT k AS entity_key FROM s UNION SELECT r FROM e WHERE l IN (SELECT k FROM s) UNION SELECT l FROM e WHERE r IN (SELECT k FROM s)")
def p21_one_hop(spark, sf):
    return E.one_hop(ids_of(spark, sf).where("table_id = 'cust'").select("entity_key").distinct(), edges_of(spark, sf))


@query(f"WITH {IDS}, {GRP}, {EDG}, s AS (SELECT k FROM ids WHERE table_id IN ('cust', 'ord')) SELECT l AS left_entity_key, r AS right_entity_key FROM e WHERE l IN (SELECT k FROM s) AND r IN (SELECT k FROM s)")
def p22_induced_edges(spark, sf):
    nodes = ids_of(spark, sf).where("table_id IN ('cust', 'ord')").select("entity_key").distinct()
    return E.induced(edges_of(spark, sf), nodes).select("left_entity_key", "right_entity_key")


@query(f"""WITH {IDS}, {GRP}, {EDG}, n AS (SELECT l AS k, l AS o FROM e UNION SELECT r, r FROM e UNION SELECT l, r FROM e UNION SELECT r, l FROM e)
SELECT k AS entity_key, min(o) AS label FROM n GROUP BY k""")
def p24_label_round(spark, sf):
    e = edges_of(spark, sf)
    return E.propagate(E.impacted_nodes(e).select("entity_key", F.col("entity_key").alias("label")), e)


@query(f"{BASE} SELECT k AS entity_key, c AS label FROM lab")
def p25_hash_min(spark, sf):
    keep = _keep(spark)
    e = keep(edges_of(spark, sf))
    return E.hash_min(E.impacted_nodes(e), e, keep)[0]


@query(f"{BASE} SELECT k AS entity_key, c AS label FROM lab")
def p25_star_components(spark, sf):
    keep = _keep(spark)
    edges = keep(edges_of(spark, sf).select("left_entity_key", "right_entity_key"))
    labels = _labels_of(edges, keep)
    keep.drop(edges)
    return labels


@query(f"{BASE} SELECT k AS entity_key, c AS resolved_id FROM mem")
def p28_membership(spark, sf):
    return members_of(spark, sf)


@query(f"{BASE} SELECT c AS resolved_id, count(*) AS cluster_size FROM mem GROUP BY c")
def p31_cluster_sizes(spark, sf):
    return sizes_of(spark, sf)


STATS = "st AS (SELECT c, count(DISTINCT ty) AS div, count(*) AS ec FROM (SELECT l AS k, ty FROM e UNION ALL SELECT r, ty FROM e) JOIN mem USING (k) GROUP BY c), sz AS (SELECT c, count(*) AS n FROM mem GROUP BY c)"


@query(f"{BASE}, {STATS} SELECT c AS resolved_id, div AS edge_diversity, ec AS edge_count FROM st")
def p32_edge_stats(spark, sf):
    edges, members = graph_of(spark, sf)
    return C.edge_stats(members, edges)


CONF = "cf AS (SELECT c, n, coalesce(div, 0) AS div, CASE WHEN n <= 1 THEN 1.0 ELSE least(1.0, coalesce(ec, 0) / (n - 1)) END::DOUBLE AS den, (SELECT greatest(1, max(div)) FROM st) AS top FROM sz LEFT JOIN st USING (c))"


@query(f"""{BASE}, {STATS}, {CONF} SELECT c AS resolved_id, n AS cluster_size, div AS edge_diversity, den AS match_density,
CASE WHEN n = 1 THEN 1.0 ELSE round(0.5::DOUBLE * div / top + 0.35::DOUBLE * den + 0.15::DOUBLE, 3) END::DOUBLE AS confidence_score,
CASE WHEN n = 1 THEN 'SINGLETON_NO_MATCH_REQUIRED' WHEN div >= 2 THEN div || ' identifier types' ELSE 'Single identifier type' END AS primary_reason FROM cf""")
def p34_confidence(spark, sf):
    edges, m = graph_of(spark, sf)
    return C.confidence(C.cluster_sizes(m), C.edge_stats(m, edges)).drop("edge_count")


@query(f"""{BASE}, {STATS}, {CONF} SELECT c AS resolved_id,
CASE WHEN n = 1 THEN 'SINGLETON_NO_MATCH_REQUIRED' WHEN div >= 3 AND den >= 0.8 THEN div || ' identifier types, high density' WHEN div >= 2 AND den >= 0.5 THEN div || ' identifier types, moderate density'
WHEN div = 1 AND den >= 0.8 THEN 'Single identifier type, high density' WHEN div = 1 AND den < 0.5 THEN 'Single identifier type, chain pattern'
ELSE div || ' identifier type(s), ' || CASE WHEN den >= 0.5 THEN 'moderate' ELSE 'low' END || ' density' END AS primary_reason FROM cf""")
def p36_detailed_reason(spark, sf):
    edges, m = graph_of(spark, sf)
    return C.confidence(C.cluster_sizes(m), C.edge_stats(m, edges), reasons="detailed").select("resolved_id", "primary_reason")


ATTR = """attr AS (SELECT 'cust:' || c_custkey AS k, 1 AS tr, TIMESTAMP '1900-01-01' AS ru, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'ord:' || o_orderkey, 2, o_orderdate, NULL, o_orderpriority FROM orders UNION ALL SELECT 'li:' || l_orderkey || '-' || l_linenumber, 3, l_shipdate, NULL, NULL FROM lineitem
UNION ALL SELECT 'ev:' || event_id, 4, ts, NULL, event_type FROM events)"""


@query(f"""{BASE}, {ATTR}, x AS (SELECT c, attr.* FROM attr JOIN mem USING (k)),
a AS (SELECT c, name FROM x WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY ru DESC, k) = 1), b AS (SELECT c, segment FROM x WHERE segment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY ru DESC, k) = 1)
SELECT m.c AS resolved_id, a.name AS name_primary, b.segment AS segment_primary FROM (SELECT DISTINCT c FROM mem) m LEFT JOIN a USING (c) LEFT JOIN b USING (c)""")
def p40_golden_recency(spark, sf):
    return C.golden_profiles(members_of(spark, sf), X.attributes(spark, frames(spark, sf), META, ("name", "segment")), META.survivorship)


@query(f"""{BASE}, {ATTR}, x AS (SELECT c, attr.* FROM attr JOIN mem USING (k)),
b AS (SELECT c, segment FROM x WHERE segment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY tr, ru DESC, k) = 1)
SELECT m.c AS resolved_id, b.segment AS segment_primary FROM (SELECT DISTINCT c FROM mem) m LEFT JOIN b USING (c)""")
def p41_golden_trust_recency(spark, sf):
    return C.golden_profiles(members_of(spark, sf), X.attributes(spark, frames(spark, sf), META, ("segment",)), (Survivorship("segment", "SOURCE_PRIORITY + MOST_RECENT"),))


@query(f"WITH {ENT} SELECT table_id, max(wm) AS last_watermark_value FROM ent GROUP BY 1 HAVING max(wm) IS NOT NULL")
def p42_watermarks(spark, sf):
    return X.entities(spark, frames(spark, sf), META).groupBy("table_id").agg(F.max("watermark_value").alias("last_watermark_value")).where("last_watermark_value IS NOT NULL")


@query(f"WITH {IDS}, {GRP}, {EDG} SELECT rule_id, count(*) AS edges_created FROM e GROUP BY 1")
def p43_rule_audit(spark, sf):
    return edges_of(spark, sf).groupBy("rule_id").agg(F.count("*").alias("edges_created"))


P44 = "cur AS (SELECT DISTINCT 'cust:' || o_custkey AS k, 'cust:' || (o_custkey - o_custkey % 3) AS c FROM orders UNION ALL SELECT 'sup:' || s_suppkey, 'sup:' || s_nationkey FROM supplier), pro AS (SELECT 'cust:' || c_custkey AS k, 'cust:' || (c_custkey - c_custkey % 2) AS c FROM customer)"


def _two_states(spark, sf):
    """Proposed: all customers. Current: those who ordered, in other clusters, and the suppliers, who are gone."""
    of = lambda df, kind, key, cluster: df.selectExpr(f"concat('{kind}:', {key}) AS entity_key", f"concat('{kind}:', {cluster}) AS resolved_id")
    pro = of(t(spark, sf, "customer"), "cust", "c_custkey", "c_custkey - c_custkey % 2")
    cur = of(t(spark, sf, "orders"), "cust", "o_custkey", "o_custkey - o_custkey % 3").distinct()
    return pro, cur.unionByName(of(t(spark, sf, "supplier"), "sup", "s_suppkey", "s_nationkey"))


@query(f"""WITH {P44}, ps AS (SELECT c, count(*) AS n FROM pro GROUP BY c), cs AS (SELECT c, count(*) AS n FROM cur GROUP BY c)
SELECT pro.k AS entity_key, cur.c AS current_resolved_id, pro.c AS proposed_resolved_id, CASE WHEN cur.c IS NULL THEN 'NEW' WHEN cur.c = pro.c THEN 'UNCHANGED' ELSE 'MOVED' END AS change_type, coalesce(cs.n, 0) AS current_cluster_size, ps.n AS proposed_cluster_size
FROM pro LEFT JOIN cur ON pro.k = cur.k LEFT JOIN ps ON ps.c = pro.c LEFT JOIN cs ON cs.c = cur.c""")
def p44_dry_run_diff(spark, sf):
    pro, cur = _two_states(spark, sf)
    d = D.diff(pro, cur, C.cluster_sizes(pro), C.cluster_sizes(cur))
    return d.drop("run_id", "created_at").withColumn("current_cluster_size", F.coalesce("current_cluster_size", F.lit(0)))


@query(f"""WITH {P44} SELECT coalesce(pro.k, cur.k) AS entity_key, cur.c AS current_resolved_id, pro.c AS proposed_resolved_id, CASE WHEN cur.c IS NULL THEN 'NEW' WHEN pro.c IS NULL THEN 'REMOVED' ELSE 'MOVED' END AS change_type
FROM pro FULL JOIN cur ON pro.k = cur.k WHERE cur.c IS DISTINCT FROM pro.c""")
def p45_changes_full_outer(spark, sf):
    return D.changes(*_two_states(spark, sf)).select("entity_key", "current_resolved_id", "proposed_resolved_id", "change_type")


@query(f"""WITH {P44}, ps AS (SELECT c, count(*) AS n FROM pro GROUP BY c)
SELECT count(*) AS total_entities, count(*) FILTER (cur.c IS NULL) AS new_entities, count(*) FILTER (cur.c <> pro.c) AS moved_entities, count(*) FILTER (cur.c = pro.c) AS unchanged_entities, max(ps.n) AS largest_proposed_cluster
FROM pro LEFT JOIN cur ON pro.k = cur.k LEFT JOIN ps ON ps.c = pro.c""")
def p46_dry_run_summary(spark, sf):
    pro, cur = _two_states(spark, sf)
    return D.summary(D.diff(pro, cur, C.cluster_sizes(pro), C.cluster_sizes(cur)))


def _full_run(spark, sf, config=RunConfig(algorithm="alternating")):
    store = StateStore(spark, folder(spark, "state"))
    run(spark, META, frames(spark, sf), store, config, run_ts="2024-06-01 00:00:00")
    return store


@query(f"{BASE} SELECT c AS resolved_id, count(*) AS cluster_size FROM mem GROUP BY c")
def run_full_clusters(spark, sf):
    return _full_run(spark, sf).read(CLUSTERS).select("resolved_id", "cluster_size")


@query(f"{BASE} SELECT k AS entity_key, c AS resolved_id FROM mem")
def run_incremental_equals_full(spark, sf):
    """Three slices of time: a full run over the first, and incremental runs that start from the marks of the run before."""
    store, f = StateStore(spark, folder(spark, "state")), frames(spark, sf)
    until = {"ord": ("o_orderdate", "1997-01-01", "1999-06-01"), "li": ("l_shipdate", "1997-03-01", "1999-03-01"), "ev": ("ts", "2024-01-10", "2024-01-20")}
    for k in (1, 2, 3):
        seen = {x: df.where(F.col(until[x][0]) < F.lit(until[x][k]).cast("timestamp")) if x in until and k < 3 else df for x, df in f.items()}
        run(spark, META, seen, store, RunConfig(mode="FULL" if k == 1 else "INCR", algorithm="alternating"), run_ts=f"2024-06-0{k} 00:00:00")
    return store.read(MEMBERS).select("entity_key", "resolved_id")


@query(f"{BASE} SELECT count(*) AS total_entities, count(*) AS new_entities, 0::BIGINT AS moved_entities, (SELECT max(n) FROM (SELECT count(*) AS n FROM mem GROUP BY c)) AS largest_proposed_cluster FROM (SELECT DISTINCT k FROM ent)")
def run_dry(spark, sf):
    store = _full_run(spark, sf, RunConfig(dry_run=True, algorithm="alternating"))
    return store.read("dry_run_summary").select("total_entities", "new_entities", "moved_entities", "largest_proposed_cluster")


# ---- filters, joins, aggregates, windows, sorts, set operations ---------------------------------------------------
@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'big' WHEN o_totalprice < 50000 THEN 'small' ELSE 'mid' END AS size FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT (o_totalprice BETWEEN 1000 AND 2000) AND o_orderpriority IS NOT NULL")
def f04_predicates_case(spark, sf):
    p = F.col("o_totalprice")
    return t(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O") & ~p.between(1000, 2000) & F.col("o_orderpriority").isNotNull()).select("o_orderkey", F.when(p >= 100000, "big").when(p < 50000, "small").otherwise("mid").alias("size"))


@query("SELECT n_name FROM nation WHERE n_name LIKE '%1%' OR n_name ILIKE '%A%'")
def f07_like_ilike(spark, sf):
    c = F.col("n_name")
    return t(spark, sf, "nation").where(c.like("%1%") | c.ilike("%A%")).select(c)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def f10_in_subquery(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IS NOT NULL)")
def f11_not_in(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 100000 AND o_custkey IS NOT NULL").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def f15_having(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_inner(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def j02_inner_composite(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return li.join(li.withColumn("x", F.lit(1)), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1")
def j06_left_with_predicate(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 100000")
    return t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT coalesce(s.k, c.k) AS k, s.n AS n_s, c.n AS n_c FROM (SELECT s_nationkey::BIGINT AS k, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) s FULL JOIN (SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM customer WHERE c_nationkey > 5 GROUP BY 1) c ON s.k = c.k WHERE s.n IS NOT NULL AND c.n IS NOT NULL OR coalesce(s.k, c.k) < 0")
def j07_full_outer(spark, sf):
    s = t(spark, sf, "supplier").where("s_nationkey < 20").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n_s"))
    c = t(spark, sf, "customer").where("c_nationkey > 5").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n_c"))
    return s.join(c, "k", "full_outer").where("n_s IS NOT NULL AND n_c IS NOT NULL")


@query(f"WITH {IDS} SELECT ty AS identifier_type, count(*) AS n FROM ids WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('CUST', '1%'), ('ORDER', '%77%')) x(t2, p) WHERE t2 = ty AND v LIKE p) GROUP BY 1")
def j10_anti_like(spark, sf):
    return X.without_excluded(ids_of(spark, sf), (Exclusion("CUST", "1%", "LIKE"), Exclusion("ORDER", "%77%", "LIKE"))).groupBy("identifier_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey OR c_custkey = o_orderkey GROUP BY 1")
def j11_or_join(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    a = c.join(o, c.c_custkey == o.o_custkey)
    b = c.join(o.where("o_custkey IS NULL OR o_custkey <> o_orderkey"), c.c_custkey == o.o_orderkey)
    return a.select("c_custkey").union(b.select("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_acctbal > a AS above FROM supplier, (SELECT avg(s_acctbal) AS a FROM supplier)")
def j12_cross_one_row(spark, sf):
    s = t(spark, sf, "supplier")
    return s.crossJoin(F.broadcast(s.agg(F.avg("s_acctbal").alias("a")))).select("s_suppkey", (F.col("s_acctbal") > F.col("a")).alias("above"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_shipdate) AS n_ship, count(DISTINCT l_suppkey) AS n_supp, min(l_shipdate) AS first_ship, max(l_quantity) AS max_q, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted, round(avg(l_quantity), 4) AS avg_q FROM lineitem GROUP BY ALL")
def a01_aggregates(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count("l_shipdate").alias("n_ship"), F.countDistinct("l_suppkey").alias("n_supp"), F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("max_q"),
        F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"), F.round(F.avg("l_quantity"), 4).alias("avg_q"),
    )


@query("SELECT o_custkey, array_to_string(list_slice(list_sort(list(o_orderkey::VARCHAR)), 1, 5), ',') AS keys FROM orders GROUP BY 1")
def a07_bounded_list(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("k")
    o = t(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k")).withColumn("n", F.row_number().over(w)).where("n <= 5")
    return o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("keys"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1")
def a08_sets_and_first(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def w01_row_number_first(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return t(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select("o_orderkey", "o_custkey")


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_id) OVER w IS NOT NULL AND lead(event_id) OVER w IS NOT NULL")
def w04_lag_lead_first(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.first("event_id").over(w).alias("first"))
    return e.where("before IS NOT NULL AND after IS NOT NULL")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o01_top_k(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(10)


@query("SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02_union_distinct(spark, sf):
    c, s = t(spark, sf, "customer"), t(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").cast("long").alias("k")).union(s.select(F.col("s_nationkey").cast("long"))).distinct()


@query("WITH RECURSIVE r(n) AS (SELECT 1::BIGINT UNION ALL SELECT n * 2 FROM r WHERE n < 1000) SELECT n FROM r")
def u03_recursive(spark, sf):
    return spark.sql("WITH RECURSIVE r(n) AS (SELECT CAST(1 AS bigint) UNION ALL SELECT n * 2 FROM r WHERE n < 1000) SELECT n FROM r")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04_except(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, sf, "orders").select("o_custkey"))


@query("SELECT n_name AS name, n_regionkey::BIGINT AS n_regionkey, 'nation' AS _source FROM nation UNION ALL SELECT r_name, -1, 'region' FROM region")
def u05_union_superset(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    both = T.union_relations({"nation": n.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("n_regionkey")), "region": r.select(F.col("r_name").alias("name"))}, source_column="_source")
    return both.withColumn("n_regionkey", F.coalesce("n_regionkey", F.lit(-1)))


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS lo, trim('  ' || c_name || ' ') AS tr, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, split_part(c_name, '#', 2) AS part, right(c_name, 3) AS r3, replace(c_name, '0', 'o') AS rep,
length(c_name) AS len, lpad(c_custkey::VARCHAR, 8, '0') AS padded, substr(c_name, 2, 4) AS sub, nullif(c_mktsegment, '') AS ni, md5(c_name) AS h, sha256(c_name) AS h2, coalesce(NULL, c_name) AS co, least(c_custkey, 5) AS le, greatest(c_custkey, 5) AS gr, TRY_CAST(c_name AS INTEGER) IS NULL AS bad,
c_custkey % 7 AS md, floor(c_acctbal)::BIGINT AS fl, ceil(c_acctbal)::BIGINT AS ce, round(sqrt(abs(c_acctbal)), 6) AS sq FROM customer""")
def scalar_strings_and_math(spark, sf):
    n, k, a = F.col("c_name"), F.col("c_custkey"), F.col("c_acctbal")
    return t(spark, sf, "customer").select(
        k, F.upper(n).alias("up"), F.lower("c_mktsegment").alias("lo"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), F.regexp_replace(n, "[^0-9]", "").alias("digits"), F.split_part(n, F.lit("#"), F.lit(2)).alias("part"),
        F.right(n, F.lit(3)).alias("r3"), F.replace(n, F.lit("0"), F.lit("o")).alias("rep"), F.length(n).cast("long").alias("len"), F.lpad(k.cast("string"), 8, "0").alias("padded"), F.substring(n, 2, 4).alias("sub"),
        F.nullif(F.col("c_mktsegment"), F.lit("")).alias("ni"), F.md5(n).alias("h"), F.sha2(n, 256).alias("h2"), F.coalesce(F.lit(None), n).alias("co"), F.least(k, F.lit(5)).alias("le"), F.greatest(k, F.lit(5)).alias("gr"), n.try_cast("int").isNull().alias("bad"),
        (k % 7).alias("md"), F.floor(a).alias("fl"), F.ceil(a).alias("ce"), F.round(F.sqrt(F.abs(a)), 6).alias("sq"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate + INTERVAL 90 MINUTE AS later, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, epoch(o_orderdate)::BIGINT AS secs FROM orders")
def scalar_dates(spark, sf):
    d = F.col("o_orderdate")
    return t(spark, sf, "orders").select("o_orderkey", F.to_date(d).cast("string").alias("d"), (d + F.expr("INTERVAL 90 MINUTE")).alias("later"), F.datediff(F.to_date(d), F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.unix_timestamp(d).alias("secs"))


# ---- macro library -----------------------------------------------------------------------------------------------
@query("SELECT range AS date_day FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)")
def v01_date_spine(spark, sf):
    return T.date_spine(spark, "day", "2024-01-01", "2024-03-01")


@query("SELECT o_orderkey, date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate) AS hours FROM orders")
def v02_intervals_between(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", T.intervals_between(F.lit("1992-01-01").cast("timestamp"), F.col("o_orderdate"), "hour").alias("hours"))


@query("SELECT range AS generated_number FROM range(1, 101)")
def v03_generate_series(spark, sf):
    return T.generate_series(spark, 100)


@query("SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def v04_deduplicate(spark, sf):
    return T.deduplicate(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice")]).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("SELECT c_custkey, md5(coalesce(c_name, '_dbt_utils_surrogate_key_null_') || '-' || coalesce(c_nationkey::VARCHAR, '_dbt_utils_surrogate_key_null_')) AS k FROM customer")
def v05_surrogate_key(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", S.surrogate_key(F.col("c_name"), F.col("c_nationkey")).alias("k"))


@query("SELECT event_type AS value FROM events GROUP BY 1 ORDER BY count(*) DESC, 1")
def v07_column_values(spark, sf):
    return spark.createDataFrame([(v,) for v in T.column_values(t(spark, sf, "events"), "event_type")], "value string")


@query("SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS n_A, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS n_N, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_R FROM lineitem GROUP BY 1")
def v08_pivot(spark, sf):
    return T.pivot(t(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N", "R"], prefix="n_")


@query("SELECT n_nationkey, 'n_name' AS field_name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def v09_unpivot(spark, sf):
    return T.unpivot(t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("SELECT p_partkey AS x_p_partkey FROM part")
def v11_star(spark, sf):
    p = t(spark, sf, "part")
    return T.star(p, [c for c in p.columns if c != "p_partkey"], prefix="x_")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def v13_group_by_first(spark, sf):
    return T.group_by_first(t(spark, sf, "customer").select("c_nationkey", "c_custkey"), 1, F.count("*").alias("n"))


@query("SELECT c_custkey, nullif(c_mktsegment, '') AS c_mktsegment FROM customer")
def v14_nullcheck(spark, sf):
    return T.nullcheck_table(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"))


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 0), 0) + coalesce(c_custkey, 0) AS plus, coalesce(c_custkey, 0) - coalesce(nullif(c_nationkey, 0), 0) AS minus, c_custkey / nullif(c_nationkey, 0) AS ratio FROM customer WHERE c_nationkey <> 0 OR c_custkey < 0")
def v15_safe_arithmetic(spark, sf):
    n, k = F.nullif(F.col("c_nationkey"), F.lit(0)), F.col("c_custkey")
    return t(spark, sf, "customer").where("c_nationkey <> 0").select("c_custkey", S.safe_add(n, k).alias("plus"), S.safe_subtract(k, n).alias("minus"), S.safe_divide(k, F.col("c_nationkey")).alias("ratio"))


@query("SELECT s_suppkey, round(2 * 3961 * asin(sqrt(pow(sin(radians(s_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(s_nationkey)) * pow(sin(radians(s_nationkey - 5) / 2), 2))) * 1.60934, 3) AS km FROM supplier")
def v17_haversine(spark, sf):
    n = F.col("s_nationkey").cast("double")
    return t(spark, sf, "supplier").select("s_suppkey", F.round(S.haversine(F.lit(10.0), F.lit(5.0), n, n, "km"), 3).alias("km"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 8000 THEN 5 ELSE floor(c_acctbal / 2000)::INTEGER + 1 END AS b FROM customer")
def v18_width_bucket(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", S.width_bucket(F.col("c_acctbal"), 0, 8000, 4).alias("b"))


URL = "replace(replace(url, 'http://', ''), 'https://', '')"


@query(f"""SELECT page_id, split_part(split_part(replace({URL}, 'android-app://', ''), '/', 1), '?', 1) AS host,
CASE WHEN instr({URL}, '/') = 0 THEN '' ELSE split_part(substr({URL}, instr({URL}, '/') + 1), '?', 1) END AS path, nullif(split_part(split_part(url, 'page=', 2), '&', 1), '') AS page FROM pages""")
def v19_url_parts(spark, sf):
    u = F.col("url")
    return t(spark, sf, "pages").select("page_id", S.url_host(u).alias("host"), S.url_path(u).alias("path"), S.url_parameter(u, "page").alias("page"))


@query("SELECT count(*)::VARCHAR AS n FROM customer")
def v20_single_value(spark, sf):
    return spark.createDataFrame([(str(T.single_value(t(spark, sf, "customer").agg(F.count("*")))),)], "n string")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0 AND c_acctbal <= 5000)")
def v23_accepted_range(spark, sf):
    return K.accepted_range(t(spark, sf, "customer"), "c_acctbal", 0, 5000).select("c_custkey")


@query("SELECT c_nationkey, count(nullif(c_nationkey, 3)) AS filled FROM customer GROUP BY 1 HAVING count(nullif(c_nationkey, 3)) = 0")
def v24_at_least_one(spark, sf):
    return K.at_least_one(t(spark, sf, "customer").withColumn("x", F.nullif(F.col("c_nationkey"), F.lit(3))), "x", ["c_nationkey"])


@query("WITH a AS (SELECT c_nationkey::BIGINT AS value, count(*) AS num_rows FROM customer GROUP BY 1), b AS (SELECT s_nationkey::BIGINT AS value, count(*) AS num_rows FROM supplier GROUP BY 1) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def v25_cardinality_equality(spark, sf):
    c, s = (t(spark, sf, x).withColumn("k", F.col(k).cast("long")) for x, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return K.cardinality_equality(c, "k", s, "k")


@query("SELECT (SELECT count(*) FROM customer) AS count_a, (SELECT count(*) FROM supplier) AS count_b, (SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier) AS diff")
def v26_equal_rowcount(spark, sf):
    return K.equal_rowcount(t(spark, sf, "customer"), t(spark, sf, "supplier"))


@query("SELECT (SELECT count(*) FROM customer) AS count_a, (SELECT count(*) FROM supplier) AS count_b, (SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier) + 1 AS row_count_delta")
def v26_fewer_rows_than(spark, sf):
    return K.fewer_rows_than(t(spark, sf, "customer"), t(spark, sf, "supplier"))


@query("SELECT n_nationkey, n_name, 'a_minus_b' AS which_diff FROM nation WHERE n_nationkey % 2 = 1")
def v27_equality(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    return K.equality(n, n.where("n_nationkey % 2 = 0"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 1000)")
def v28_expression_is_true(spark, sf):
    return K.expression_is_true(t(spark, sf, "orders"), "o_totalprice > 1000").select("o_orderkey")


@query("SELECT event_id FROM (SELECT event_id, ts AS a, ts + INTERVAL 6 HOUR AS b, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, ts + INTERVAL 6 HOUR, event_id) AS n FROM events) WHERE NOT (a < b AND coalesce(b <= n, true))")
def v29_mutually_exclusive_ranges(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("b"))
    return K.mutually_exclusive_ranges(e, "a", "b", ["user_id"]).select("event_id")


@query("SELECT DISTINCT event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def v30_not_accepted_values(spark, sf):
    return K.not_accepted_values(t(spark, sf, "events"), "event_type", ["click", "view", "purchase"])


@query("SELECT s_nationkey, count(DISTINCT s_suppkey) AS filled FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1")
def v30_not_constant(spark, sf):
    return K.not_constant(t(spark, sf, "supplier"), "s_suppkey", ["s_nationkey"])


@query("SELECT c_nationkey, avg(CASE WHEN nullif(c_custkey % 3, 0) IS NULL THEN 0.0 ELSE 1.0 END) < 0.67 AS low FROM customer GROUP BY 1 HAVING avg(CASE WHEN nullif(c_custkey % 3, 0) IS NULL THEN 0.0 ELSE 1.0 END) < 0.67")
def v31_not_null_proportion(spark, sf):
    c = t(spark, sf, "customer").withColumn("x", F.nullif(F.col("c_custkey") % 3, F.lit(0)))
    return K.not_null_proportion(c, "x", 0.67, group_by=["c_nationkey"]).select("c_nationkey", (F.col("not_null_proportion") < 0.67).alias("low"))


@query("SELECT user_id, max(ts) AS most_recent FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2030-01-01' - INTERVAL 1 DAY")
def v32_recency(spark, sf):
    return K.recency(t(spark, sf, "events"), "ts", "day", 1, F.lit("2030-01-01").cast("timestamp"), ["user_id"]).select("user_id", "most_recent")


@query("SELECT user_id AS id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 3)")
def v33_relationships_where(spark, sf):
    return K.relationships_where(t(spark, sf, "events"), "user_id", t(spark, sf, "customer"), "c_custkey", "event_type <> 'error'", "c_nationkey > 3")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b + 1 <> o_orderkey")
def v34_sequential_values(spark, sf):
    return K.sequential_values(t(spark, sf, "orders"), "o_orderkey", group_by=["o_custkey"]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v35_unique_combination(spark, sf):
    return K.unique_combination(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- reports -----------------------------------------------------------------------------------------------------
CASE = lambda buckets: "CASE " + " ".join(f"WHEN n <= {top} THEN '{name}'" for top, name in buckets[:-1]) + f" ELSE '{buckets[-1][1]}' END"


def sizes_by_customer(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("resolved_id")).agg(F.count("*").alias("cluster_size"))


SZ = "sz AS (SELECT o_custkey::VARCHAR AS c, count(*) AS n FROM orders GROUP BY 1)"


@query(f"WITH {SZ} SELECT {CASE(R.HEALTH)} AS size_bucket, count(*) AS cluster_count, sum(n)::BIGINT AS total_entities, min(n) AS min_size, max(n) AS max_size, avg(n) AS avg_size FROM sz GROUP BY 1")
def r02_cluster_health(spark, sf):
    return R.cluster_health(sizes_by_customer(spark, sf))


@query(f"WITH {IDS} SELECT ty AS identifier_type, v AS identifier_value_norm, count(*) AS entity_count, CASE WHEN count(*) > 10000 THEN 'CRITICAL: Excessive matches (>10K)' WHEN count(*) > 1000 THEN 'WARNING: High matches (>1K)' ELSE 'INFO: Elevated matches (>100)' END AS severity, 'Review identifier quality - may indicate data issue' AS recommendation FROM ids GROUP BY 1, 2 HAVING count(*) > 100")
def r03_identifier_issues(spark, sf):
    return R.identifier_issues(ids_of(spark, sf))


def audit_like(spark, sf):
    o = F.col("o_orderdate")
    return t(spark, sf, "orders").select(F.concat(F.lit("run_"), F.year(o)).alias("run_id"), F.col("o_orderpriority").alias("rule_id"), (F.col("o_orderkey") % 10).alias("edges_created"), o.alias("started_at"), (o + F.expr("INTERVAL 1 HOUR")).alias("ended_at"))


AUD = "aud AS (SELECT 'run_' || year(o_orderdate) AS run_id, o_orderpriority AS rule_id, o_orderkey % 10 AS e, o_orderdate AS s, o_orderdate + INTERVAL 1 HOUR AS f FROM orders)"


@query(f"WITH {AUD} SELECT rule_id, rule_id AS rule_name, 'X' AS identifier_type, sum(e)::BIGINT AS total_edges_created, max(CASE WHEN run_id = (SELECT max(run_id) FROM aud) THEN e ELSE 0 END) AS edges_last_run, 1::INTEGER AS priority FROM aud GROUP BY 1")
def r04_rule_effectiveness(spark, sf):
    a = audit_like(spark, sf)
    rules = a.select("rule_id").distinct().select("rule_id", F.col("rule_id").alias("rule_name"), F.lit("X").alias("identifier_type"), F.lit(True).alias("is_active"), F.lit(1).alias("priority"))
    return R.rule_effectiveness(rules, a)


def history_like(spark, sf):
    e = t(spark, sf, "events")
    status = F.when(F.col("event_id") % 5 == 0, "FAILED").when(F.col("event_id") % 5 == 1, "SUCCESS_WITH_WARNINGS").otherwise("SUCCESS")
    return e.select(F.col("event_id").cast("string").alias("run_id"), F.lit("INCR").alias("run_mode"), status.alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.col("value").alias("duration_seconds"),
                    F.col("user_id").alias("entities_processed"), F.col("event_id").alias("edges_created"), F.col("event_id").alias("clusters_impacted"), F.lit(3).cast("long").alias("lp_iterations"), F.lit(4).cast("long").alias("source_tables_processed"), F.lit("none").alias("error_message"))


@query("SELECT event_id::VARCHAR AS run_id, 'INCR' AS run_mode, CASE WHEN event_id % 5 = 0 THEN 'FAILED' WHEN event_id % 5 = 1 THEN 'SUCCESS_WITH_WARNINGS' ELSE 'SUCCESS' END AS status, ts AS started_at, ts AS ended_at, value AS duration_seconds, user_id AS entities_processed, event_id AS edges_created, event_id AS clusters_impacted, 3::BIGINT AS lp_iterations, 4::BIGINT AS source_tables_processed, 'none' AS error_message FROM events")
def r01_run_summary(spark, sf):
    return R.run_summary(history_like(spark, sf))


@query("SELECT strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS run_count, count(*) FILTER (event_id % 5 <> 0) AS success_count, count(*) FILTER (event_id % 5 = 0) AS error_count, round(avg(value), 4) AS avg_duration_seconds, sum(user_id)::BIGINT AS total_entities, sum(event_id)::BIGINT AS total_edges FROM events GROUP BY 1")
def r05_run_trends(spark, sf):
    return R.run_trends(history_like(spark, sf)).withColumns({"avg_duration_seconds": F.round("avg_duration_seconds", 4), "run_date": F.col("run_date").cast("string")})


@query(f"WITH {SZ} SELECT {CASE(R.DASHBOARD)} AS bucket, count(*) AS cluster_count, sum(n)::BIGINT AS entity_count FROM sz GROUP BY 1")
def r06_cluster_distribution(spark, sf):
    return R.cluster_distribution(sizes_by_customer(spark, sf))


@query(f"WITH {SZ} SELECT c AS resolved_id, n AS cluster_size FROM sz ORDER BY n DESC, c LIMIT 10")
def r06_largest_clusters(spark, sf):
    return R.largest_clusters(sizes_by_customer(spark, sf))


@query(f"WITH {SZ} SELECT c AS resolved_id, n AS cluster_size FROM sz WHERE c NOT IN (SELECT user_id::VARCHAR FROM events)")
def r07_orphaned_clusters(spark, sf):
    return R.orphaned_clusters(sizes_by_customer(spark, sf), t(spark, sf, "events").select(F.col("user_id").cast("string").alias("resolved_id")))


@query("SELECT 'cust:' || c_custkey AS entity_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def r08_orphaned_entities(spark, sf):
    e = t(spark, sf, "customer").select(S.entity_key("cust", "c_custkey").alias("entity_key"))
    return R.orphaned_entities(e, t(spark, sf, "orders").select(S.entity_key("cust", "o_custkey").alias("entity_key")))


@query("SELECT user_id::VARCHAR AS table_id, max(ts) AS last_run_ts, floor(epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600)::BIGINT AS hours_since FROM events GROUP BY 1 HAVING floor(epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600) >= 24")
def r09_stale_sources(spark, sf):
    s = t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("table_id")).agg(F.max("ts").alias("last_run_ts"))
    return R.stale_sources(s, F.lit("2024-02-01").cast("timestamp"))


@query(f"WITH {IDS} SELECT ty AS identifier_type, v AS identifier_value_norm, count(DISTINCT k) AS entities FROM ids WHERE k IN (SELECT 'ord:' || o_orderkey FROM orders WHERE o_custkey = 1 UNION SELECT 'cust:1') GROUP BY 1, 2")
def r10_cluster_root_cause(spark, sf):
    m = t(spark, sf, "orders").select(S.entity_key("ord", "o_orderkey").alias("entity_key"), S.entity_key("cust", "o_custkey").alias("resolved_id"))
    c = t(spark, sf, "customer").select(S.entity_key("cust", "c_custkey").alias("entity_key"), S.entity_key("cust", "c_custkey").alias("resolved_id"))
    return R.cluster_root_cause(m.union(c), ids_of(spark, sf), "cust:1")


@query("SELECT count(*) AS total_runs, count(*) FILTER (event_id % 5 <> 0) AS successful, round(100.0::DOUBLE * count(*) FILTER (event_id % 5 <> 0) / count(*), 2) AS success_rate FROM events")
def r11_success_rate(spark, sf):
    return R.success_rate(history_like(spark, sf))


@query(f"WITH {SZ}, a AS (SELECT n, count(*) AS x FROM sz GROUP BY 1), s2 AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT n, count(*) AS y FROM s2 GROUP BY 1) SELECT coalesce(a.n, b.n) AS cluster_size, coalesce(x, 0) AS clusters_before, coalesce(y, 0) AS clusters_after, coalesce(y, 0) - coalesce(x, 0) AS diff FROM a FULL JOIN b ON a.n = b.n")
def r12_size_comparison(spark, sf):
    return R.size_comparison(sizes_by_customer(spark, sf), t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cluster_size")))


@query(f"WITH {P44} SELECT pro.c AS proposed_resolved_id, count(*) AS moved_in FROM pro JOIN cur ON pro.k = cur.k WHERE pro.c <> cur.c GROUP BY 1")
def r13_moved_in(spark, sf):
    return R.moved_in(p44_dry_run_diff(spark, sf))


@query(f"WITH {AUD} SELECT run_id, sum(e)::BIGINT AS edges, date_diff('second', min(s), max(f)) AS seconds FROM aud GROUP BY 1")
def r14_run_timings(spark, sf):
    return R.run_timings(audit_like(spark, sf))


def _touches(spark, sf):
    e = t(spark, sf, "events").select(S.entity_key("ev", "event_id").alias("entity_key"), "event_type", "ts", S.entity_key("cust", "user_id").alias("resolved_id"))
    return e.select("entity_key", "resolved_id"), e.drop("resolved_id")


@query("SELECT 'cust:' || user_id AS resolved_id, count(DISTINCT event_type) AS channels, count(*) AS touches FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def r15_touchpoints(spark, sf):
    return R.touchpoints(*_touches(spark, sf), "event_type")


@query("SELECT 'cust:' || user_id AS resolved_id, arg_min(event_type, (ts, 'ev:' || event_id)) AS first_channel, min(ts) AS first_at FROM events GROUP BY 1")
def r15_first_touch(spark, sf):
    return R.first_touch(*_touches(spark, sf), "event_type", "ts")


@query(f"WITH {SZ} SELECT 'failed_run' AS alert, event_id::VARCHAR AS subject, 1::BIGINT AS n FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'giant_cluster', c, n FROM sz WHERE n > 15")
def r16_alerts(spark, sf):
    return R.alerts(history_like(spark, sf), spark.createDataFrame([], SCHEMAS["skipped_identifier_groups"]), sizes_by_customer(spark, sf), largest=15)


@query(f"WITH {IDS} SELECT table_id, k AS entity_key, ty AS identifier_type, v AS identifier_value_norm FROM ids WHERE (ty, v) IN (SELECT ty, v FROM ids GROUP BY 1, 2 HAVING count(*) > 50)")
def r17_excessive_values(spark, sf):
    return R.excessive_values(ids_of(spark, sf), 50).select("table_id", "entity_key", "identifier_type", "identifier_value_norm")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, orders, line items and events resolved to one cluster a customer."""
    return p31_cluster_sizes(spark, sf)


__all__ = ["EDGES", "GOLDEN", "QUERIES", "SQL", "flagship"]
