"""Macro library, exporters, streaming, presets, generator and layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinfold import export
from kinfold.functions import checks as K
from kinfold.functions import scalars as S
from kinfold.functions import transforms as T
from kinfold.model import Mapping, Metadata, Rule, RunConfig, Source
from kinfold.operators.dryrun import gate
from kinfold.plans import layout
from kinfold.plans.resolution import CLUSTERS, MEMBERS, run
from kinfold.sources import generate
from kinfold.sources.metadata import validate
from kinfold.sources.presets import PRESETS
from kinfold.sources.state import StateStore


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c).first()[0]


def test_scalars(spark):
    v = lambda c: one(spark, c, x="1")
    assert v(S.surrogate_key(F.lit("a"), F.lit("b"), F.lit("c"))) == "7b193b3d33184464106f41ddf733783b"
    assert v(S.surrogate_key(F.lit(None).cast("string"))) == "f14cc5cdce0420f4a5a6b6d9d7b85f39"
    assert [v(S.width_bucket(F.lit(x), 200000, 600000, 4)) for x in (190000.0, 290000.0, 399999.99, 600000.0, 300000.0)] == [0, 1, 2, 5, 2]
    assert v(S.safe_divide(F.lit(6), F.lit(0))) is None and v(S.safe_divide(F.lit(10), F.lit(5))) == 2
    assert [round(v(S.haversine(F.lit(48.864716), F.lit(2.349014), F.lit(52.379189), F.lit(4.899431), u))) for u in ("km", "mi")] == [430, 267]
    assert v(S.url_host(F.lit("android-app://m.facebook.com/"))) == "m.facebook.com" and v(S.url_host(F.lit("a.com?x=1"))) == "a.com"
    assert v(S.normalize_company(F.lit(" Acme, Inc. "))) == "ACME" and v(S.canonicalize(F.lit("+1 (55) 5"), "CLEAN_PHONE")) == "1555"
    assert S.slugify("!Hell0 World-hi") == "hell0_world_hi" and S.slugify("0x") == "_0x"
    with pytest.raises(ValueError):
        S.canonicalize(F.lit("x"), "SOUNDEX")


def test_transforms(spark):
    df = spark.createDataFrame([("S", "red"), ("S", "blue"), ("M", "red")], "size string, color string")
    got = {r["size"]: (r["c_red"], r["c_blue"]) for r in T.pivot(df, ["size"], "color", T.column_values(df, "color"), prefix="c_").collect()}
    assert got == {"S": (1, 1), "M": (1, 0)} and T.column_values(df, "color") == ["red", "blue"] and T.column_values(df, "color", 1, "size = 'X'", ["d"]) == ["d"]
    assert T.results_as_dict(df.orderBy("size", "color"))["color"] == ["red", "blue", "red"] and T.single_value(df.where("false"), 5) == 5
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    assert T.deduplicate(nulls, ["k"], [F.desc("v")]).first()["v"] == 2
    assert T.filtered_columns(df, ["SIZE"]) == ["color"] and T.nullcheck_table(spark.createDataFrame([("", 1)], "s string, i int")).first()["s"] is None
    with pytest.raises(ValueError):
        T.generate_series(spark, 0)
    df.write.saveAsTable("lib_test_one")
    assert T.relations_by_pattern(spark, "default", "LIB_test%") == ["lib_test_one"] and T.relations_by_pattern(spark, "default", "lib%", "%one") == []


def test_checks_that_pass(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    for bad in (K.accepted_range(df, "a", 1, 3), K.at_least_one(df, "a"), K.equal_rowcount(df, df), K.equality(df, df, precision=2), K.mutually_exclusive_ranges(df, "a", "b", gaps="not_allowed"),
                K.not_empty_string(df.select(F.col("a").cast("string").alias("s")), "s"), K.not_null_proportion(df, "a", 1.0), K.sequential_values(df, "a"), K.unique(df, "a"), K.not_null(df, "a"), K.fewer_rows_than(df.limit(1), df)):
        assert bad.count() == 0
    assert K.mutually_exclusive_ranges(df, "a", "b", gaps="required").count() == 2 and K.sequential_values(df.where("a <> 2"), "a").count() == 1
    at = spark.createDataFrame([("2024-01-01 00:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    assert K.recency(at, "ts", "hour", 5, F.lit("2024-01-01 05:00:00").cast("timestamp")).count() == 0 and K.recency(at, "ts", "hour", 5, F.lit("2024-01-01 05:00:01").cast("timestamp")).count() == 1


META = Metadata((Source("t", "t", "id", "ts"),), (Rule("r", "EMAIL", "LOWERCASE"),), (Mapping("t", "EMAIL", "email"),))


def test_export_dashboard_layout(spark, tmp_path, capsys):
    store = StateStore(spark, (tmp_path / "state").as_uri())
    df = spark.createDataFrame([("1", "a@x"), ("2", "A@x")], "id string, email string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    run(spark, META, {"t": df}, store)

    class Broken(export.Exporter):
        def export(self, metrics):
            return False

    assert export.export_pending(store, Broken(), "2024-02-01") == 0
    assert export.export_pending(store, export.PrometheusText(str(tmp_path / "m.prom")), "2024-02-01 00:00:00") == 7
    assert "idr_entities_processed{" in (tmp_path / "m.prom").read_text() and export.export_pending(store, export.Stdout(), "2024-02-02") == 0
    assert "Largest clusters" in export.dashboard(store) and "t:1" in export.dashboard(store)
    layout.compact(store, CLUSTERS, 1)
    assert layout.vacuum(store) > 0 and store.read(CLUSTERS).count() == 1
    assert gate({"moved_entities": 1, "largest_proposed_cluster": 2}) and not gate({"moved_entities": 10_001, "largest_proposed_cluster": 2})


def test_stream_of_changes_starts_incremental_runs(spark, tmp_path):
    from kinfold.streaming.incremental import follow

    path, schema = str(tmp_path / "in"), "id string, email string, ts timestamp"
    row = lambda *r: spark.createDataFrame([r], "id string, email string, s string").select("id", "email", F.col("s").cast("timestamp").alias("ts"))
    store = StateStore(spark, (tmp_path / "state").as_uri())
    for k, r in enumerate((("1", "a@x", "2024-01-01 00:00:00"), ("2", "a@x", "2024-01-02 00:00:00"))):
        row(*r).write.mode("append").parquet(path)
        q = follow(spark, spark.readStream.schema(schema).parquet(path), META, lambda: {"t": spark.read.schema(schema).parquet(path)}, store, str(tmp_path / "cp"))
        q.awaitTermination(300)
        assert q.exception() is None and store.read(MEMBERS).count() == k + 1
    assert {r["resolved_id"] for r in store.read(MEMBERS).collect()} == {"t:1"}


def test_presets_and_generator(spark):
    for name, make in PRESETS.items():
        assert validate(make()).ok, name
    a, b = generate.customers(spark, 2000, 1), generate.customers(spark, 2000, 1)
    assert 1200 < a.count() < 3000 and a.subtract(b).count() == 0 and generate.giant_group(spark, 30).select("email").distinct().count() == 1


def test_unconverged_runs_warn_or_raise(spark, tmp_path):
    df = spark.createDataFrame([("1", "a@x"), ("2", "A@x")], "id string, email string").withColumn("ts", F.lit(None).cast("timestamp"))
    s = StateStore(spark, (tmp_path / "s").as_uri())
    r = run(spark, META, {"t": df}, s, RunConfig(max_iters=1))
    assert not r.converged and r.status == "SUCCESS_WITH_WARNINGS"
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        run(spark, META, {"t": df}, s, RunConfig(max_iters=1, on_nonconverged="raise"))


def test_stream_of_the_history_tells_each_run_once(spark, tmp_path):
    from kinfold.sources.state import SCHEMAS, StateStore
    from kinfold.streaming.incremental import history

    store, at = StateStore(spark, f"{tmp_path.as_uri()}/state"), f"{tmp_path.as_uri()}/checkpoint"

    def add(run_id, status):
        rows = spark.createDataFrame([(run_id, status)], "run_id string, status string").withColumn("ended_at", F.lit("2024-06-01 10:00:00").cast("timestamp"))
        store.append("run_history", spark.createDataFrame([], SCHEMAS["run_history"]).unionByName(rows, allowMissingColumns=True))

    def alerts():
        failed, got = history(store).where("status = 'FAILED'"), []
        failed.writeStream.foreachBatch(lambda df, k: got.extend(r["run_id"] for r in df.collect())).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    add("a", "SUCCESS"), add("b", "FAILED")
    assert alerts() == ["b"]
    store.replace("run_history", store.read("run_history"))  # repeats all rows
    add("c", "FAILED")
    assert alerts() == ["c"]
