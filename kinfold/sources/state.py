"""State tables as versioned Parquet folders behind numbered pointer files.

A change writes new folders first and then the next pointer file, which must not exist yet, so that a reader sees all
tables before a run or all after it, a plan never overwrites what it reads, and of two writers the second notices the
first. Works on any file system that Spark reaches whose renames don't replace (HDFS and its like).

A table is a list of parts. A part replaces the table's rows with certain keys by rows of its own, or adds rows, so that a
small change writes little; a table of MOST_PARTS is written anew as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import put

#: The tables' columns.
SCHEMAS = {
    "identifiers_current": "table_id string, entity_key string, rule_id string, identifier_type string, identifier_value_norm string, is_hashed boolean, excluded boolean, made_by string",
    "run_state": "table_id string, last_watermark_value timestamp, last_run_id string, last_run_ts timestamp",
    "identity_edges_current": "rule_id string, left_entity_key string, right_entity_key string, identifier_type string, identifier_value_norm string, first_seen_ts timestamp, last_seen_ts timestamp",
    "identity_resolved_membership_current": "entity_key string, resolved_id string, updated_ts timestamp",
    "identity_clusters_current": "resolved_id string, cluster_size long, confidence_score double, edge_diversity long, match_density double, primary_reason string, updated_ts timestamp",
    "golden_profile_current": "resolved_id string, updated_ts timestamp",
    "rule_match_audit_current": "run_id string, rule_id string, edges_created long, started_at timestamp, ended_at timestamp",
    "skipped_identifier_groups": "run_id string, rule_id string, identifier_type string, identifier_value_norm string, group_size long, max_allowed long, sample_entity_keys string, reason string, skipped_at timestamp",
    "run_history": "run_id string, run_mode string, status string, started_at timestamp, ended_at timestamp, duration_seconds double, entities_processed long, edges_created long, edges_updated long, clusters_impacted long, lp_iterations long, source_tables_processed long, groups_skipped long, values_excluded long, large_clusters long, warnings string, watermarks_json string, error_message string, error_stage string, created_at timestamp",
    "stage_metrics": "run_id string, stage_name string, stage_order int, started_at timestamp, ended_at timestamp, duration_seconds double, rows_in long, rows_out long, notes string",
    "dry_run_results": "run_id string, entity_key string, current_resolved_id string, proposed_resolved_id string, change_type string, current_cluster_size long, proposed_cluster_size long, created_at timestamp",
    "dry_run_summary": "run_id string, total_entities long, new_entities long, moved_entities long, merged_clusters long, split_clusters long, unchanged_entities long, largest_proposed_cluster long, edges_would_create long, groups_would_skip long, values_would_exclude long, execution_time_seconds double, created_at timestamp",
    "metrics_export": "metric_id string, run_id string, metric_name string, metric_value double, metric_type string, dimensions string, recorded_at timestamp, exported_at timestamp",
}


MOST_PARTS = 8


class ConflictError(RuntimeError):
    """Another writer changed a table since it was read."""


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def text(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict[str, list]]:
        found = self.fs.globStatus(self._path(f"{self.root}/_pointers/*.json"))
        last = max((f.getPath() for f in found or []), key=lambda p: p.getName(), default=None)
        return (int(last.getName().removesuffix(".json")), json.loads(self.text(last))) if last else (0, {})

    def pointer(self) -> dict[str, list]:
        """The parts of each table: [rows, keys that they replace or null, the keys' columns]."""
        return self._latest()[1]

    def _point(self, number: int, now: dict[str, list]) -> bool:
        """Whether pointer `number` is ours: False if it is there already."""
        new = self._path(f"{self.root}/_pointers/_next-{uuid.uuid4().hex}")
        stream = self.fs.create(new, True)
        stream.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(new, self._path(f"{self.root}/_pointers/{number:012d}.json"), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _folder(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def read(self, table: str, now: dict[str, list] | None = None) -> DataFrame:
        now = self.pointer() if now is None else now
        if table not in now:
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = None
        for rows, keys, on in now[table]:
            if keys is not None and df is not None:
                df = df.join(self._folder(keys), on, "left_anti")
            df = self._folder(rows) if df is None else df.unionByName(self._folder(rows), allowMissingColumns=True)
        return df

    def stage(self, table: str, df: DataFrame) -> list:
        """The part that df would make: the whole table."""
        path = self.place(table)
        put(df, path)
        return [path, None, None]

    def place(self, table: str) -> str:
        """A folder for a part that isn't written yet."""
        return f"{self.root}/{table}/v-{uuid.uuid4().hex}"

    def stage_merge(self, table: str, rows: DataFrame, keys: DataFrame, now: dict[str, list]) -> tuple[str, list]:
        """('merge', part) that puts rows in place of those with keys; the whole table, ('replace', part), if it is time."""
        if table not in now:
            return "replace", self.stage(table, rows)
        on, keys = keys.columns, keys.distinct()
        if len(now[table]) >= MOST_PARTS:
            return "replace", self.stage(table, self.read(table, now).join(keys, on, "left_anti").unionByName(rows, allowMissingColumns=True))
        gone = f"{self.root}/{table}/k-{uuid.uuid4().hex}"
        put(keys, gone)
        return "merge", [self.stage(table, rows)[0], gone, list(on)]

    def commit(self, staged: dict[str, tuple[str, list]], since: dict[str, list] | None = None) -> None:
        """staged: ('replace' | 'merge' | 'append', part) or ('parts', parts: the whole table) for each table. since: the pointer that parts were made from; a
        table that was replaced or merged and has changed since raises ConflictError."""
        while True:
            number, now = self._latest()
            for table, (how, _) in staged.items():
                if since is not None and how != "append" and now.get(table) != since.get(table):
                    raise ConflictError(f"{table} was changed by another writer")
            after = dict(now)
            for table, (how, part) in staged.items():
                after[table] = part if how == "parts" else [part] if how == "replace" else [*now.get(table, []), part]
            if self._point(number + 1, after):
                return

    def replace(self, table: str, df: DataFrame) -> None:
        self.commit({table: ("replace", self.stage(table, df))})

    def append(self, table: str, df: DataFrame) -> None:
        self.append_all({table: df})

    def append_all(self, rows: dict[str, DataFrame]) -> None:
        """Rows of several tables in one change. A table of many parts is written anew first."""
        now = self.pointer()
        for table in rows:
            if len(now.get(table, ())) >= MOST_PARTS:
                self.commit({table: ("replace", self.stage(table, self.read(table, now)))}, now)
        self.commit({table: ("append", self.stage(table, df)) for table, df in rows.items()})

    def create(self, table: str, schema: str) -> bool:
        """Makes an empty table unless it is there; whether it was made."""
        if table in self.pointer():
            return False
        self.replace(table, self.spark.createDataFrame([], schema))
        return True

    def exists(self, table: str) -> bool:
        return table in self.pointer()

    def rename(self, old: str, new: str) -> None:
        """`new` gets the parts of `old`, which goes; in one change."""
        while True:
            number, now = self._latest()
            if old not in now:
                raise KeyError(old)
            if self._point(number + 1, {k: v for k, v in now.items() if k != old} | {new: now[old]}):
                return

    def upsert(self, table: str, df: DataFrame, keys: Sequence[str]) -> None:
        now = self.pointer()
        self.commit({table: self.stage_merge(table, df, df.select(*keys), now)}, now)

    def purge(self, table: str, column: str, before) -> None:
        """Keeps rows from `before` on (a Column or timestamp string), and rows without a time."""
        bound = before if not isinstance(before, str) else F.lit(before).cast("timestamp")
        self.replace(table, self.read(table).where((F.col(column) >= bound) | F.col(column).isNull()))

    def reset(self) -> None:
        """No table has rows; the next run starts from the first watermark. Old versions stay until `vacuum`."""
        self._set({})

    def _set(self, tables: dict[str, list]) -> None:
        while not self._point(self._latest()[0] + 1, tables):
            pass

    def snapshot(self, name: str) -> None:
        stream = self.fs.create(self._path(f"{self.root}/_snapshots/{name}"), True)
        stream.write(bytearray(json.dumps(self.pointer()).encode()))
        stream.close()

    def restore(self, name: str) -> None:
        self._set(json.loads(self.text(self._path(f"{self.root}/_snapshots/{name}"))))


def upserted(current: DataFrame, update: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with update's rows in place of those with their keys."""
    return current.join(update.select(*keys).distinct(), list(keys), "left_anti").unionByName(update, allowMissingColumns=True)


def upserted_edges(current: DataFrame, update: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An edge that is seen again keeps its first time and takes the new last time."""
    every = current.unionByName(update)
    return every.groupBy(*keys).agg(F.min("first_seen_ts").alias("first_seen_ts"), F.max("last_seen_ts").alias("last_seen_ts"))
