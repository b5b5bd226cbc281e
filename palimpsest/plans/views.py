"""Inspection views of a store, by name, for spark.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import catalog, packs
from .store import Store


def views(store: Store) -> dict[str, DataFrame]:
    snapshots, files, blobs = store.table("snapshots"), store.table("snapshot_files"), store.table("blob_index")
    return {
        "snapshots": snapshots,
        "newest_snapshots": catalog.newest_first(snapshots),
        "snapshot_display": catalog.display(catalog.newest_first(snapshots)),
        "manifests": catalog.manifests(snapshots, files),
        "manifest_owners": snapshots.select("id", catalog.owner().alias("owner_id")),
        "blobs": blobs,
        "pack_references": packs.reference_counts(blobs, blobs),
        "pack_bytes": packs.dead_bytes(blobs, catalog.reachable(snapshots, files)),
    }


def register(store: Store, prefix: str = "store_") -> list[str]:
    """Makes temporary views of them; their names."""
    found = views(store)
    for name, df in found.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in found]
