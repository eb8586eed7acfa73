"""Metric exporters, and a static page of the reports."""

from __future__ import annotations

import html
import json
import logging
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import reports
from .sources.state import StateStore


class Exporter(ABC):
    name = ""

    def setup(self) -> None: ...

    @abstractmethod
    def export(self, metrics: list[dict]) -> bool: ...

    def teardown(self) -> None: ...


class Stdout(Exporter):
    name = "stdout"

    def export(self, metrics: list[dict]) -> bool:
        for m in metrics:
            print(json.dumps(m, default=str))
        return True


class Webhook(Exporter):
    name = "webhook"

    def __init__(self, url: str, headers: Mapping[str, str] | None = None):
        self.url, self.headers = url, dict(headers or {})

    def export(self, metrics: list[dict]) -> bool:
        from urllib.request import Request, urlopen

        body = json.dumps({"metrics": metrics}, default=str).encode()
        with urlopen(Request(self.url, body, {"Content-Type": "application/json"} | self.headers), timeout=30) as r:
            return r.status < 300


class PrometheusText(Exporter):
    """Gauges in the text format, for a file that a collector reads."""

    name = "prometheus"

    def __init__(self, path: str):
        self.path = path

    def export(self, metrics: list[dict]) -> bool:
        with open(self.path, "w") as f:
            f.write(prometheus_text(metrics))
        return True


def prometheus_text(metrics: list[dict]) -> str:
    lines = []
    for m in metrics:
        labels = ",".join(f'{k}="{v}"' for k, v in (json.loads(m["dimensions"] or "{}") | {"run_id": m["run_id"]}).items())
        lines.append(f"{m['metric_name']}{{{labels}}} {m['metric_value']}")
    return "\n".join(lines) + "\n"


class PrometheusEndpoint(Exporter):
    """Serves the metrics of the last export at /metrics until `close`."""

    name = "prometheus_endpoint"

    def __init__(self, port: int = 9090, host: str = ""):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        endpoint, self.text = self, ""

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                found = self.path.split("?")[0] == "/metrics"
                body = endpoint.text.encode() if found else b""
                self.send_response(200 if found else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_) -> None: ...

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def export(self, metrics: list[dict]) -> bool:
        self.text = prometheus_text(metrics)
        return True

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class Datadog(Webhook):
    name = "datadog"

    def export(self, metrics: list[dict]) -> bool:
        series = [{"metric": m["metric_name"], "type": m["metric_type"], "points": [[m["recorded_at"].timestamp(), m["metric_value"]]], "tags": [f"{k}:{v}" for k, v in json.loads(m["dimensions"] or "{}").items()]} for m in metrics]
        from urllib.request import Request, urlopen

        with urlopen(Request(self.url, json.dumps({"series": series}).encode(), {"Content-Type": "application/json"} | self.headers), timeout=30) as r:
            return r.status < 300


EXPORTERS: dict[str, type[Exporter]] = {c.name: c for c in (Stdout, Webhook, PrometheusText, PrometheusEndpoint, Datadog)}


def export_pending(store: StateStore, exporter: Exporter, now: str, limit: int = 1000) -> int:
    """Oldest unexported metrics first; they are marked only if the exporter took them."""
    table = store.read("metrics_export")
    pending = [r.asDict() for r in table.where("exported_at IS NULL").orderBy("recorded_at", "metric_id").limit(limit).collect()]
    if not pending:
        return 0
    exporter.setup()
    try:
        if not exporter.export(pending):
            return 0
    finally:
        exporter.teardown()
    done = store.spark.createDataFrame([(m["metric_id"],) for m in pending], "metric_id string").withColumn("_done", F.lit(True))
    marked = table.join(F.broadcast(done), "metric_id", "left").withColumn("exported_at", F.when(F.col("_done"), F.lit(now).cast("timestamp")).otherwise(F.col("exported_at"))).drop("_done")
    store.replace("metrics_export", marked)
    return len(pending)


def export_forever(store: StateStore, exporter: Exporter, seconds: float, limit: int = 1000, rounds: int | None = None) -> int:
    """Exports what is pending every so many seconds, for ever or for so many rounds; how many metrics went out. A round
    that fails is told in the log and made up for in the next."""
    sent = k = 0
    while rounds is None or k < rounds:
        if k:
            time.sleep(seconds)
        k += 1
        try:
            sent += export_pending(store, exporter, datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), limit)
        except OSError as e:
            logging.getLogger("kinfold").warning("export failed: %s", e)
    return sent


def dashboard(store: StateStore, rows: int = 20) -> str:
    """A page of small reports; each is an aggregate or a top list."""
    now = store.pointer()
    history, clusters = store.read("run_history", now), store.read("identity_clusters_current", now)
    parts: dict[str, DataFrame] = {
        "Runs": reports.run_summary(history).limit(rows), "Cluster sizes": reports.cluster_distribution(clusters), "Largest clusters": reports.largest_clusters(clusters, rows),
        "Dry runs": store.read("dry_run_summary", now).orderBy(F.desc("created_at")).limit(rows), "Skipped groups": store.read("skipped_identifier_groups", now).orderBy(F.desc("group_size")).limit(rows),
        "Trends": reports.run_trends(history).limit(rows),
    }
    out = ["<!doctype html><meta charset=utf-8><title>Entity resolution</title>"]
    for title, df in parts.items():
        out.append(f"<h2>{html.escape(title)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect()]
        out.append("</table>")
    return "\n".join(out)
