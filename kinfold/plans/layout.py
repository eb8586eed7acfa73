"""Upkeep of the state tables' layout."""

from __future__ import annotations

from ..sources.state import StateStore

#: What lookups and joins filter by: rows near each other in these columns share files and row groups.
ORDER = {
    "identity_edges_current": ("identifier_type", "identifier_value_norm"),
    "identity_resolved_membership_current": ("resolved_id", "entity_key"),
    "identity_clusters_current": ("resolved_id",),
    "golden_profile_current": ("resolved_id",),
    "run_history": ("started_at",),
}


def compact(store: StateStore, table: str, files: int | None = None) -> None:
    """Rewrites a table range-partitioned and sorted, in `files` files or as many as the session's shuffles have."""
    by = ORDER[table]
    df = store.read(table)
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    store.replace(table, ranged.sortWithinPartitions(*by))


def vacuum(store: StateStore) -> int:
    """Removes versions that neither the pointer nor a snapshot names. Only while nobody reads old versions."""
    import json

    pointers = [store.pointer()]
    snaps = store._path(f"{store.root}/_snapshots")
    if store.fs.exists(snaps):
        pointers += [json.loads(store.text(s.getPath())) for s in store.fs.listStatus(snaps)]
    live = {path for p in pointers for parts in p.values() for rows, keys, _ in parts for path in (rows, keys) if path}
    gone, names = 0, {p.rstrip("/").rsplit("/", 2)[-2] + "/" + p.rstrip("/").rsplit("/", 1)[-1] for p in live}
    for table in store.fs.listStatus(store._path(store.root)):
        name = table.getPath().getName()
        if not table.isDirectory() or name.startswith("_"):
            continue
        for v in store.fs.listStatus(table.getPath()):
            if f"{name}/{v.getPath().getName()}" not in names:
                store.fs.delete(v.getPath(), True)
                gone += 1
    return gone
