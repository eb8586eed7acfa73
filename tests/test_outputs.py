"""The command line, the exporters, the state store under two writers, and the generators."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from kinfold import cli, export
from kinfold.functions import scalars
from kinfold.functions import transforms as T
from kinfold.sources import generate
from kinfold.sources.state import SCHEMAS, ConflictError, StateStore


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, f"{tmp_path.as_uri()}/state")


@pytest.fixture
def listener():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(202)
            self.end_headers()

        def log_message(self, *_): ...

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/in", got
    server.shutdown()


def metrics(spark, n=3):
    rows = spark.range(n).select(F.concat(F.lit("m"), "id").alias("metric_id"), F.lit("r").alias("run_id"), F.lit("idr_edges").alias("metric_name"), F.col("id").cast("double").alias("metric_value"),
                                 F.lit("gauge").alias("metric_type"), F.lit('{"mode": "FULL"}').alias("dimensions"), F.timestamp_seconds(F.col("id") * 60).alias("recorded_at"), F.lit(None).cast("timestamp").alias("exported_at"))
    return spark.createDataFrame(rows.collect(), SCHEMAS["metrics_export"])


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("1", "a@x"), ("2", "A@x"), ("3", "b@x")], "id string, email string").write.parquet(f"{tmp_path}/people")
    (tmp_path / "meta.yaml").write_text(f"""
rules: [{{type: EMAIL, canonicalize: lowercase}}]
sources:
  - {{id: p, table: "{tmp_path}/people", entity_key: id, identifiers: [{{type: EMAIL, column: email}}]}}
""")
    base = ["--config", str(tmp_path / "meta.yaml")]
    assert cli.main([*base, "--validate"]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert cli.main([*base, "--state", f"{tmp_path.as_uri()}/state", "--mode", "FULL"]) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (out["counts"]["entities"], out["counts"]["clusters"]) == (3, 2)
    (tmp_path / "bad.yaml").write_text((tmp_path / "meta.yaml").read_text().replace("column: email", "column: nothing"))
    assert cli.main(["--config", str(tmp_path / "bad.yaml"), "--validate"]) == 1


def test_webhook_and_datadog(store, listener):
    url, got = listener
    store.append("metrics_export", metrics(store.spark))
    assert export.export_pending(store, export.Webhook(url), "2024-01-01 00:00:00", 2) == 2
    assert [m["metric_id"] for m in got[0]["metrics"]] == ["m0", "m1"]
    assert export.export_forever(store, export.Datadog(url), 0, rounds=2) == 1
    assert got[1]["series"][0]["points"] == [[120.0, 2.0]] and store.read("metrics_export").where("exported_at IS NULL").isEmpty()


def test_prometheus_endpoint(store):
    store.append("metrics_export", metrics(store.spark, 1))
    e = export.PrometheusEndpoint(0, "127.0.0.1")
    try:
        export.export_pending(store, e, "2024-01-01 00:00:00")
        assert urlopen(f"http://127.0.0.1:{e.port}/metrics").read().decode() == 'idr_edges{mode="FULL",run_id="r"} 0.0\n'
        with pytest.raises(HTTPError):
            urlopen(f"http://127.0.0.1:{e.port}/other")
    finally:
        e.close()


def test_exports_fail_and_go_on(store):
    store.append("metrics_export", metrics(store.spark, 1))
    assert export.export_forever(store, export.Webhook("http://127.0.0.1:9/"), 0, rounds=1) == 0
    assert store.read("metrics_export").where("exported_at IS NULL").count() == 1


def test_second_writer_notices_the_first(store):
    rows = lambda *x: store.spark.createDataFrame([(k,) for k in x], "k long")
    store.replace("a", rows(1))
    now = store.pointer()
    mine, theirs = store.stage("a", rows(2)), store.stage_merge("a", rows(3), rows(1), now)
    store.commit({"a": theirs}, now)
    with pytest.raises(ConflictError):
        store.commit({"a": ("replace", mine)}, now)
    store.commit({"b": ("append", store.stage("b", rows(5)))}, now)
    assert [r["k"] for r in store.read("a").collect()] == [3] and [r["k"] for r in store.read("b").collect()] == [5]


def test_many_small_changes(store):
    """Merges and appends beyond the most parts that a table may have."""
    row = lambda k, v: store.spark.createDataFrame([(k, v)], "k long, v string")
    for i in range(20):
        store.upsert("t", row(i % 3, f"v{i}"), ["k"])
        store.append("log", row(i, "x"))
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == {0: "v18", 1: "v19", 2: "v17"} and store.read("log").count() == 20
    assert max(len(parts) for parts in store.pointer().values()) <= 9


def test_generators(spark):
    df = spark.range(20_000)
    n = generate.sample(df, 0.1, 3).count()
    assert 1800 < n < 2200 and generate.sample(df, 0.1, 3).count() == n
    again = generate.sample(df, 2.0, 3, True)
    assert 38_000 < again.count() < 42_000 and again.groupBy("id").count().where("count > 2").count() > 1000
    c = generate.customers(spark, 5000)
    linked = c.groupBy("cluster", "phone").count().where("count = 2").count()
    assert linked > 50 and c.count() > 3000


def test_helpers(spark):
    with pytest.raises(ValueError):
        scalars.surrogate_key_of_columns("a")
    assert scalars.pretty_log_format("x").endswith(" + x") and len(scalars.pretty_time()) == 8
    a = spark.createDataFrame([(k % 7, k) for k in range(100)], "g long, k long")
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    got = T.numbered(a, ["g", "k"], keep).orderBy("row_id").collect()
    assert [(r["g"], r["k"]) for r in got] == sorted((k % 7, k) for k in range(100)) and [r["row_id"] for r in got] == list(range(1, 101))
