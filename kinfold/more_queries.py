"""Further queries: metadata, the state store, runs' records, generators, and the forms of joins and functions that
queries.py leaves out. They are added to its QUERIES and SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .functions import checks as K
from .functions import scalars as S
from .functions import transforms as T
from .model import Mapping, Metadata, Rule, RunConfig, Source
from .operators import clusters as C
from .operators import dryrun as D
from .operators import edges as E
from .operators import extract as X
from .plans import layout
from .plans.resolution import MEMBERS, run
from .queries import EDG, ENT, GRP, IDS, META, P44, _keep, _two_states, edges_of, frames, query, t
from .sources import generate as G
from .sources import metadata as M
from .sources.scratch import folder
from .sources.state import StateStore

CUSTOMERS = Metadata((Source("cust", "customer", "c_custkey"),), (Rule("r_seg", "SEG", "LOWERCASE", max_group_size=1_000_000),), (Mapping("cust", "SEG", "c_mktsegment"),))


def _store(spark) -> StateStore:
    return StateStore(spark, folder(spark, "state"))


# ---- sources, metadata, state ------------------------------------------------------------------------------------
@query("SELECT * FROM (VALUES ('r_a', 'EMAIL', 'LOWERCASE', 10000::BIGINT, true), ('r_b', 'PHONE', 'NONE', 7, false)) x(rule_id, identifier_type, canonicalize, max_group_size, require_non_null)")
def s05_metadata_tables(spark, sf):
    """Metadata written as tables and read from them."""
    path, kinds = folder(spark, "meta"), {"source_table": "table_id string, entity_key_expr string", "rule": "rule_id string, identifier_type string, canonicalize string, max_group_size int, require_non_null boolean", "identifier_mapping": "table_id string, identifier_type string, identifier_value_expr string"}
    rows = {"source_table": [("t", "id")], "rule": [("r_a", "EMAIL", "lowercase", None, None), ("r_b", "PHONE", None, 7, False)], "identifier_mapping": [("t", "EMAIL", "email"), ("t", "PHONE", "phone")]}
    for name, kind in kinds.items():
        spark.createDataFrame(rows[name], kind).write.parquet(f"{path}/{name}")
    meta = M.from_tables({name: spark.read.parquet(f"{path}/{name}") for name in kinds})
    return spark.createDataFrame([(r.rule_id, r.identifier_type, r.canonicalize, r.max_group_size, r.require_non_null) for r in meta.rules], "rule_id string, identifier_type string, canonicalize string, max_group_size long, require_non_null boolean")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def s06_seeds(spark, sf):
    """A seed file: a CSV file with a header whose types the caller states."""
    path = folder(spark, "seed")
    t(spark, sf, "nation").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("n_nationkey bigint, n_name string, n_regionkey bigint").csv(path)


@query("SELECT column_name, column_index::INTEGER AS ordinal FROM duckdb_columns() WHERE table_name = 'customer'")
def s09_schema_introspection(spark, sf):
    return spark.createDataFrame([(c, k) for k, c in enumerate(t(spark, sf, "customer").columns, 1)], "column_name string, ordinal int")


@query("SELECT * FROM (VALUES ('there', true), ('gone', false)) x(name, found)")
def s10_table_exists(spark, sf):
    s = _store(spark)
    s.replace("there", t(spark, sf, "region"))
    return spark.createDataFrame([(n, s.exists(n)) for n in ("there", "gone")], "name string, found boolean")


@query("SELECT * FROM (VALUES ('kf_nation', 'pattern'), ('kf_region', 'pattern'), ('kf_region', 'prefix'), ('kf_nation', 'kind'), ('kf_region', 'kind')) x(name, how)")
def s11_relation_lookup(spark, sf):
    for name in ("region", "nation"):
        t(spark, sf, name).createOrReplaceTempView(f"kf_{name}")
    try:
        of = lambda how, **x: T.tables(spark, "default", **x).select("name", F.lit(how).alias("how"))
        found = of("pattern", pattern="KF_%on", exclude="%x%").union(of("prefix", prefix="Kf_r")).union(of("kind", prefix="kf_", kinds=("TEMPORARY",))).collect()
    finally:
        for name in ("region", "nation"):
            spark.catalog.dropTempView(f"kf_{name}")
    return spark.createDataFrame(found, "name string, how string")


@query("SELECT r_regionkey, r_name FROM region")
def k02_create_if_absent(spark, sf):
    """The second creation finds the table and leaves its rows alone."""
    s, r = _store(spark), t(spark, sf, "region").select("r_regionkey", "r_name")
    s.create("region", r.schema)
    s.append("region", r)
    s.create("region", r.schema)
    return s.read("region")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def k03_append(spark, sf):
    s, rows = _store(spark), t(spark, sf, "supplier").select("s_suppkey", "s_name")
    s.append("supplier", rows)
    s.append("supplier", rows)
    return s.read("supplier")


@query("SELECT 'b' AS name, r_name FROM region")
def k07_rename(spark, sf):
    s = _store(spark)
    s.replace("a", t(spark, sf, "region"))
    s.rename("a", "b")
    (name,) = s.pointer()
    return s.read(name).select(F.lit(name).alias("name"), "r_name")


@query("SELECT r_regionkey, r_name FROM region")
def k09_reset_and_restore(spark, sf):
    s, r = _store(spark), t(spark, sf, "region").select("r_regionkey", "r_name")
    s.replace("region", r)
    s.snapshot("before")
    s.reset()
    s.append("region", r.limit(0))
    s.restore("before")
    return s.read("region")


@query(f"WITH {ENT} SELECT DISTINCT k AS entity_key, table_id AS resolved_id FROM ent")
def k14_layout(spark, sf):
    """Compaction changes files, not rows."""
    s = _store(spark)
    s.replace(MEMBERS, X.entities(spark, frames(spark, sf), META).select("entity_key", F.col("table_id").alias("resolved_id")).distinct())
    layout.compact(s, MEMBERS, 3)
    return s.read(MEMBERS)


# ---- runs and their records --------------------------------------------------------------------------------------
@query("""SELECT x.table_id, x.wc AS watermark_column, coalesce(m, TIMESTAMP '1900-01-01') AS last_watermark_value
FROM (VALUES ('cust', NULL), ('ord', 'o_orderdate'), ('li', 'l_shipdate'), ('ev', 'ts')) x(table_id, wc) LEFT JOIN (SELECT 'ord' AS table_id, max(o_orderdate) AS m FROM orders) USING (table_id)""")
def p02_source_plan(spark, sf):
    state = t(spark, sf, "orders").agg(F.max("o_orderdate").alias("last_watermark_value")).select(F.lit("ord").alias("table_id"), "last_watermark_value")
    return X.source_plan(spark, META, state).select("table_id", "watermark_column", "last_watermark_value")


@query("SELECT * FROM (VALUES ('error'), ('warning')) x(kind)")
def p04_metadata_validator(spark, sf):
    bad = replace(CUSTOMERS, mappings=(*CUSTOMERS.mappings, Mapping("cust", "EMAIL", "no_such_column")), rules=(*CUSTOMERS.rules, Rule("r_phone", "PHONE")))
    report = M.validate(bad, {"cust": t(spark, sf, "customer")})
    return spark.createDataFrame([(k,) for k, found in (("error", report.errors), ("warning", report.warnings)) if found], "kind string")


@query("""SELECT 'cust:' || c_custkey AS entity_key, r AS rule_id, v AS identifier_value_norm FROM (
  SELECT c_custkey, 'r_any' AS r, nullif(c_mktsegment, 'BUILDING') AS v FROM customer UNION ALL SELECT c_custkey, 'r_some', nullif(c_mktsegment, 'BUILDING') FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def p09_require_non_null(spark, sf):
    """A rule that doesn't require values keeps identifiers without one."""
    m = Metadata(CUSTOMERS.sources, (Rule("r_any", "SEG", require_non_null=False), Rule("r_some", "SEG")), (Mapping("cust", "SEG", "nullif(c_mktsegment, 'BUILDING')"),))
    return X.identifiers(spark, {"cust": t(spark, sf, "customer")}, m).select("entity_key", "rule_id", "identifier_value_norm")


_ROUND = lambda a, b: f"{b} AS (SELECT k, min(o) AS o FROM (SELECT k, o FROM {a} UNION ALL SELECT e.l, {a}.o FROM e JOIN {a} ON {a}.k = e.r UNION ALL SELECT e.r, {a}.o FROM e JOIN {a} ON {a}.k = e.l) GROUP BY k)"


@query(f"WITH {IDS}, {GRP}, {EDG}, l0 AS (SELECT l AS k, l AS o FROM e UNION SELECT r, r FROM e), {_ROUND('l0', 'l1')}, {_ROUND('l1', 'l2')}, {_ROUND('l2', 'l3')} SELECT k AS entity_key, o AS label FROM l3")
def p27_three_passes(spark, sf):
    e = edges_of(spark, sf)
    return E.propagated(E.impacted_nodes(e), e, 3)


@query("SELECT 'cust:' || c_custkey AS entity_key, c_mktsegment AS email, c_name AS first_name FROM customer")
def p37_probed_attributes(spark, sf):
    """Attributes by the names of columns, where nothing is mapped."""
    f = {"cust": t(spark, sf, "customer").withColumnsRenamed({"c_mktsegment": "customer_email", "c_name": "first_name"})}
    return X.attributes(spark, f, X.probed_attributes(f, CUSTOMERS), ("email", "first_name")).select("entity_key", "email", "first_name")


@query(f"""WITH {P44}, s AS (SELECT count(*) FILTER (cur.c <> pro.c) AS moved, (SELECT max(n) FROM (SELECT count(*) AS n FROM pro GROUP BY c)) AS largest FROM pro LEFT JOIN cur ON pro.k = cur.k)
SELECT m AS max_moved, c AS max_cluster, moved <= m AND largest <= c AS passes FROM s, (VALUES (10000::BIGINT, 50000::BIGINT), (1, 50000), (10000000, 1)) x(m, c)""")
def p47_dry_run_gate(spark, sf):
    pro, cur = _two_states(spark, sf)
    row = D.summary(D.diff(pro, cur, C.cluster_sizes(pro), C.cluster_sizes(cur))).first()
    return spark.createDataFrame([(m, c, D.gate(row, m, c)) for m, c in ((10_000, 50_000), (1, 50_000), (10_000_000, 1))], "max_moved long, max_cluster long, passes boolean")


@query(f"""WITH {P44}, j AS (SELECT DISTINCT pro.c AS p, cur.c AS c FROM pro JOIN cur ON pro.k = cur.k)
SELECT (SELECT count(*) FROM (SELECT p FROM j GROUP BY p HAVING count(*) > 1)) AS merged_clusters, (SELECT count(*) FROM (SELECT c FROM j GROUP BY c HAVING count(*) > 1)) AS split_clusters""")
def p46_merged_and_split(spark, sf):
    return D.reshaped(*_two_states(spark, sf))


def _customer_run(spark, sf) -> StateStore:
    s = _store(spark)
    run(spark, CUSTOMERS, {"cust": t(spark, sf, "customer")}, s, RunConfig(algorithm="alternating"), run_id="run_1", run_ts="2024-06-01 00:00:00")
    return s


SEGMENTS = "(SELECT count(*) FROM customer) AS n, (SELECT count(DISTINCT lower(c_mktsegment)) FROM customer) AS g"


@query(f"SELECT 'run_1' AS run_id, 'FULL' AS run_mode, n AS entities_processed, n - g AS edges_created, g AS clusters_impacted, 1::BIGINT AS source_tables_processed, true AS ended FROM (SELECT {SEGMENTS})")
def p48_run_history(spark, sf):
    h = _customer_run(spark, sf).read("run_history")
    return h.select("run_id", "run_mode", "entities_processed", "edges_created", "clusters_impacted", "source_tables_processed", (F.col("status").startswith("SUCCESS") & (F.col("ended_at") >= F.col("started_at"))).alias("ended"))


@query(f"SELECT u.* FROM (SELECT {SEGMENTS}), LATERAL (VALUES (1::INTEGER, 'entity_extraction', n), (2, 'identifier_extraction', n), (3, 'edge_building', n - g), (4, 'label_propagation', n), (5, 'output_generation', g)) u(stage_order, stage_name, rows_out)")
def p50_stage_metrics(spark, sf):
    return _customer_run(spark, sf).read("stage_metrics").select("stage_order", "stage_name", "rows_out")


@query(f"SELECT u.* FROM (SELECT {SEGMENTS}), LATERAL (VALUES ('idr_entities_processed', n::DOUBLE), ('idr_edges_created', (n - g)::DOUBLE), ('idr_clusters_impacted', g::DOUBLE), ('idr_groups_skipped', 0.0::DOUBLE)) u(metric_name, metric_value)")
def p51_metrics(spark, sf):
    m = _customer_run(spark, sf).read("metrics_export")
    return m.where(F.col("metric_name").isin("idr_entities_processed", "idr_edges_created", "idr_clusters_impacted", "idr_groups_skipped")).select("metric_name", "metric_value")


@query(f"WITH {IDS}, {GRP}, {EDG} SELECT DISTINCT 'rule_' || ty AS rule_id, l AS left_entity_key, r AS right_entity_key, ty AS identifier_type, v AS identifier_value_norm FROM e")
def p52_persistent_edges(spark, sf):
    return E.by_type(edges_of(spark, sf))


@query("SELECT 'ev:' || event_id AS entity_key FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def t02_late_data(spark, sf):
    """Rows that are late by less than the source's lookback are read again."""
    ev = t(spark, sf, "events")
    mark = str(ev.agg(F.max("ts")).first()[0])
    only = replace(META, sources=tuple(s for s in META.sources if s.table_id == "ev"))
    return X.entities(spark, {"ev": ev}, only, mode="INCR", marks={"ev": mark}).select("entity_key")


# ---- filters, joins, windows, sorts --------------------------------------------------------------------------------
@query("""SELECT 'null' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)
UNION ALL SELECT 'none', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'empty', c_custkey FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_custkey < 0)
UNION ALL SELECT 'own', c_custkey FROM customer WHERE nullif(c_custkey, c_nationkey) NOT IN (SELECT o_custkey FROM orders)""")
def f11_not_in_nulls(spark, sf):
    """NOT IN against a list with a null, one without, an empty one, and for rows whose own value is null."""
    c, o = t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_custkey").alias("v")), t(spark, sf, "orders").select(F.col("o_custkey").alias("w"))
    of = lambda kind, a, b: T.not_in(a, "v", b, "w").select(F.lit(kind).alias("kind"), "c_custkey")
    return (
        of("null", c, o.select(F.nullif("w", F.lit(1)).alias("w"))).unionAll(of("none", c, o)).unionAll(of("empty", c.withColumn("v", F.nullif("v", F.lit(5))), o.where("w < 0")))
        .unionAll(of("own", c.withColumn("v", F.nullif("v", F.col("c_nationkey").cast("long"))), o))
    )


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region WHERE false")
def f14_empty_relation(spark, sf):
    r = t(spark, sf, "region").select("r_regionkey", "r_name")
    return r.unionAll(spark.createDataFrame([], r.schema))


@query("SELECT * FROM (SELECT c_custkey AS k, c_name FROM customer) NATURAL JOIN (SELECT o_custkey AS k, o_orderkey FROM orders)")
def j16_natural_join(spark, sf):
    return T.natural_join(t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name"), t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders")
def w03_row_numbers(spark, sf):
    return T.numbered(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], _keep(spark)).select("o_orderkey", F.col("row_id").cast("long").alias("row_id"))


_URGENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 2 ELSE 1 END"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_URGENT}, o_orderkey)::INTEGER AS place FROM orders ORDER BY {_URGENT}, o_orderkey LIMIT 50")
def o02_order_by_case(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(1)
    first = t(spark, sf, "orders").orderBy(rank, "o_orderkey").select("o_orderkey").limit(50).collect()  # a top-k report
    return spark.createDataFrame([(r[0], k) for k, r in enumerate(first, 1)], "o_orderkey long, place int")


@query("SELECT count(*) > 0 AS some, count(*) FILTER (o_orderkey < 0) > 0 AS none FROM orders")
def o04_limit_probe(spark, sf):
    o = t(spark, sf, "orders")
    return spark.createDataFrame([(not o.limit(1).isEmpty(), not o.where("o_orderkey < 0").limit(1).isEmpty())], "some boolean, none boolean")


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 100")
def o06_oldest_first(spark, sf):
    """A batch of what waits longest."""
    return t(spark, sf, "events").where("event_type = 'click'").orderBy("ts", "event_id").limit(100).select("event_id", "ts")


# ---- functions ---------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, upper(substr(o_orderpriority, 1, 2)) || lower(substr(o_orderpriority, 3, 2)) AS head, position('-' IN o_orderpriority)::INTEGER AS dash, printf('%06d', o_orderkey) AS padded,
'{"s":"' || o_orderstatus || '","k":' || o_custkey || '}' AS object, o_orderdate + INTERVAL 3 DAY AS later, epoch(o_orderdate)::BIGINT AS seconds FROM orders""")
def scalar_more(spark, sf):
    p = F.col("o_orderpriority")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.upper(F.substring(p, 1, 2)), F.lower(F.substring(p, 3, 2))).alias("head"), F.position(F.lit("-"), p).alias("dash"), F.format_string("%06d", "o_orderkey").alias("padded"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("k"))).alias("object"), (F.col("o_orderdate") + F.make_interval(days=F.lit(3))).alias("later"), F.unix_timestamp("o_orderdate").alias("seconds"),
    )


@query("SELECT s_suppkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title FROM supplier JOIN part ON p_partkey = s_suppkey")
def scalar_initcap(spark, sf):
    s, p = t(spark, sf, "supplier"), t(spark, sf, "part")
    return s.join(p, s.s_suppkey == p.p_partkey).select("s_suppkey", F.initcap("p_type").alias("title"))


@query("SELECT r_regionkey, 36::INTEGER AS uuid_length, true AS recent, true AS in_unit, true AS repeatable FROM region")
def scalar_not_repeatable(spark, sf):
    """What can't be compared by value: uuid, the present time, seeded random numbers."""
    r = t(spark, sf, "region")
    again = r.select("r_regionkey", F.rand(7).alias("v"))
    return r.select("r_regionkey", F.length(F.expr("uuid()")).alias("uuid_length"), ((F.current_date() >= F.lit("2024-01-01").cast("date")) & (F.current_timestamp() >= F.current_date())).alias("recent"), F.rand(7).alias("u")).join(again, "r_regionkey").select("r_regionkey", "uuid_length", "recent", ((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_unit"), (F.col("u") == F.col("v")).alias("repeatable"))


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(n)), '[,\\s]+(INC|LLC|LTD|CORP|CO|GMBH|PLC)\\.?$', ''), '[^A-Z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS company
FROM (SELECT s_suppkey, ' ' || s_name || (['', ', Inc.', ' llc', '  GmbH'])[1 + s_nationkey % 4] AS n FROM supplier)""")
def x01_normalize_company(spark, sf):
    form = F.element_at(F.array(*map(F.lit, ("", ", Inc.", " llc", "  GmbH"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return t(spark, sf, "supplier").select("s_suppkey", S.normalize_company(F.concat(F.lit(" "), "s_name", form)).alias("company"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def v12_filtered_columns(spark, sf):
    c = t(spark, sf, "customer")
    return c.select(*T.filtered_columns(c, ["C_NAME", "c_nationkey", "C_mktsegment"]))


@query("SELECT 'not_null' AS test, count(*) FILTER (nullif(c_nationkey, 3) IS NULL) AS failures FROM customer UNION ALL SELECT 'unique', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)")
def v36_not_null_unique(spark, sf):
    c = t(spark, sf, "customer").withColumn("x", F.nullif("c_nationkey", F.lit(3)))
    of = lambda name, df: df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), "failures")
    return of("not_null", K.not_null(c, "x")).unionAll(of("unique", K.unique(c, "c_nationkey")))


# ---- generators --------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, (['web', 'store', 'mobile'])[1 + c_custkey % 3] AS source, md5(c_custkey::VARCHAR) AS m, sha256(c_custkey::VARCHAR) AS s, CAST(TIMESTAMP '2024-01-01' - INTERVAL 1 DAY * (c_custkey % 365) AS TIMESTAMP) AS made FROM customer")
def g02_elements_hashes_dates(spark, sf):
    """Elements of a literal list, hash-derived ids and past times, from a key instead of a random number."""
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select(
        k, F.element_at(F.array(*map(F.lit, ("web", "store", "mobile"))), (k % 3 + 1).cast("int")).alias("source"), F.md5(k.cast("string")).alias("m"), F.sha2(k.cast("string"), 256).alias("s"),
        (F.lit("2024-01-01").cast("timestamp") - F.make_interval(days=(k % 365).cast("int"))).alias("made"),
    )


@query("""SELECT c_custkey, CASE WHEN u < 2 THEN upper(e) WHEN u < 4 THEN split_part(e, '@', 1) || '+shop@' || split_part(e, '@', 2) WHEN u < 6 THEN substr(e, 1, 1) || '.' || substr(e, 2) WHEN u < 8 THEN NULL ELSE e END AS email,
CASE WHEN u < 2 THEN substr(p, 1, 3) || '-' || substr(p, 4, 3) || '-' || substr(p, 7, 4) WHEN u < 4 THEN '+1' || p WHEN u < 6 THEN NULL ELSE p END AS phone
FROM (SELECT c_custkey, c_custkey % 10 AS u, 'u' || c_custkey || '@x.org' AS e, printf('%010d', 2000000000 + c_custkey) AS p FROM customer)""")
def g03_noise(spark, sf):
    u, e, p = (F.col("c_custkey") % 10 + 0.5) / 10, F.concat(F.lit("u"), "c_custkey", F.lit("@x.org")), F.format_string("%010d", F.col("c_custkey") + 2_000_000_000)
    return t(spark, sf, "customer").select("c_custkey", G.noisy_email(e, u, 0.2, 0.2, 0.2, 0.2).alias("email"), G.noisy_phone(p, u, 0.2, 0.2, 0.2).alias("phone"))


@query("SELECT (SELECT count(*) FROM orders) AS row_count, true AS in_pool, true AS spread")
def g06_person_pool(spark, sf):
    """As many rows as there are orders, each with a customer from the pool."""
    pool, n = t(spark, sf, "customer").select(F.col("c_custkey").alias("person"), "c_name"), t(spark, sf, "orders").count()
    got = G.from_pool(spark, n, pool, "person")
    return got.agg(F.count("*").alias("row_count"), (F.count("c_name") == F.count("*")).alias("in_pool"), (F.count_distinct("person") > 100).alias("spread"))


@query("SELECT 'orders@corporate-hub.com' AS email, 6000::BIGINT AS n")
def g08_giant_group(spark, sf):
    return G.giant_group(spark, 6000).groupBy("email").agg(F.count("*").alias("n"))
