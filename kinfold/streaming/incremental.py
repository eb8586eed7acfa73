"""Incremental runs driven by a stream, and a stream of the runs' history.

Each micro-batch that brings rows starts an incremental run over the sources.

Merges are retroactive, so the clusters' state stays in the state store, not in a streaming operator."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import Metadata, RunConfig
from ..plans.resolution import run
from ..sources.state import SCHEMAS, StateStore


def follow(spark: SparkSession, stream: DataFrame, meta: Metadata, frames: Callable[[], Mapping[str, DataFrame]], store: StateStore, checkpoint: str, config: RunConfig = RunConfig(), trigger: Mapping | None = None) -> StreamingQuery:
    """stream: a source's changes; frames: reads the sources anew. Batches are repeatable, as runs upsert."""
    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            run(spark, meta, frames(), store, replace(config, mode="INCR"), run_id=f"run_stream_{number:012d}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def history(store: StateStore, lookback: str = "7 days") -> DataFrame:
    """A stream of the runs' history, each run once, for alerts: new parts of the table are new files to Spark. A part that
    was written anew repeats its rows, which are told by run_id among those that ended within `lookback`."""
    rows = store.spark.readStream.schema(SCHEMAS["run_history"]).parquet(f"{store.root}/run_history/v-*")
    return rows.withWatermark("ended_at", lookback).dropDuplicatesWithinWatermark(["run_id"])
