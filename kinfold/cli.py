"""python -m kinfold.cli --config meta.yaml --state DIR --mode FULL [--dry-run | --validate]: sources are table names or Parquet paths.

--validate checks the metadata against the sources and runs nothing; it exits with 1 if there are errors."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .model import RunConfig
from .plans.resolution import run
from .sources.metadata import from_yaml, validate
from .sources.state import StateStore


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinfold")
    p.add_argument("--config", required=True)
    p.add_argument("--state")
    p.add_argument("--mode", choices=("FULL", "INCR"), default="INCR")
    p.add_argument("--max-iters", type=int, default=30)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--validate", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    meta = from_yaml(Path(a.config).read_text())
    read = lambda t: spark.read.parquet(t) if "/" in t else spark.table(t)
    frames = {s.table_id: read(s.table) for s in meta.active_sources()}
    if a.validate:
        report = validate(meta, frames)
        print(json.dumps({"ok": report.ok, "errors": report.errors, "warnings": report.warnings}))
        return 0 if report.ok else 1
    if not a.state:
        p.error("--state is needed for a run")
    r = run(spark, meta, frames, StateStore(spark, a.state), RunConfig(mode=a.mode, max_iters=a.max_iters, dry_run=a.dry_run))
    print(json.dumps({"run_id": r.run_id, "status": r.status, "lp_iterations": r.lp_iterations, "counts": r.counts, "summary": r.summary}, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
