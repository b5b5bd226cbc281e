"""Saving, listing, restoring and deleting snapshots of a folder: as functions with plain results, and as tools over JSON lines."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import short_id
from .functions.paths import DEPENDENCIES, STORE_FOLDER, has_component
from .operators.catalog import newest_first
from .plans.errors import SnapshotNotFound, StoreError
from .plans.store import Store
from .sources.workspace import read_workspace, with_content, with_hash


def store_of(spark: SparkSession, root: str, home: str | None = None, progress: Callable[[str, dict], None] | None = None) -> Store:
    """The store of a folder, in the home folder's store folder if no other is named."""
    home = home or os.path.join(os.path.expanduser("~"), STORE_FOLDER)
    return Store(spark, os.path.join(home, "stores", short_id(os.path.abspath(root))), progress=progress)


def loaders(root: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {"load": lambda df: with_content(df, root), "digest": lambda df: with_hash(df, root)}


def public(row) -> dict[str, Any]:
    """A snapshot as {id, created_at, message, parent, root_tree_hash, stats}; without a tree, its hash is zeros."""
    stats = {k: row[k] for k in ("total_files", "total_bytes", "new_objects")}
    return {"id": row.id, "created_at": row.created_at.isoformat() + "Z", "message": row.message, "parent_snapshot_id": row.parent_snapshot_id, "root_tree_hash": row.root_tree_hash or "0" * 32, "stats": stats}


def save(spark: SparkSession, root: str, *, message: str | None = None, include_deps: bool = False, pack_chunk_bytes: int | None = None, home: str | None = None, progress=None) -> dict[str, Any]:
    root = os.path.abspath(root)
    return store_of(spark, root, home, progress).save(read_workspace(spark, root, include_deps=include_deps), message, include_deps=include_deps, pack_chunk_bytes=pack_chunk_bytes, **loaders(root))


def listing(spark: SparkSession, root: str, *, limit: int | None = None, home: str | None = None) -> list[dict[str, Any]]:
    """Newest first."""
    return [public(r) for r in store_of(spark, root, home).list(limit).toLocalIterator()]


def restore(spark: SparkSession, root: str, ref: str = "latest", *, dry_run: bool = False, home: str | None = None, progress=None) -> dict[str, int]:
    root = os.path.abspath(root)
    store = store_of(spark, root, home, progress)
    deps = not store.manifest(ref).where(has_component(F.col("path"), DEPENDENCIES)).isEmpty()
    current = store.hashed(read_workspace(spark, root, include_deps=deps), **loaders(root)).select("path", "blob_hash", "size", "mode")
    return store.restore(ref, current, root, dry_run=dry_run)


def nth(spark: SparkSession, root: str, number: int, *, home: str | None = None) -> str:
    """The id of the number-th snapshot from 1, newest first."""
    found = newest_first(store_of(spark, root, home).table("snapshots"), number).select("id").collect()
    if not 1 <= number <= len(found):
        raise SnapshotNotFound(str(number))
    return found[-1].id


def delete(spark: SparkSession, root: str, ident: str, *, home: str | None = None) -> dict[str, Any]:
    return store_of(spark, root, home).delete(ident)


def scan(spark: SparkSession, root: str, *, include_deps: bool = False) -> list[dict[str, Any]]:
    """The files of a folder by path, without device and type."""
    found = read_workspace(spark, root, include_deps=include_deps).drop("device", "is_symlink").orderBy("relative_path")
    return [r.asDict() for r in found.toLocalIterator()]


TOOLS = {"checkpoint_save": save, "checkpoint_list": listing, "checkpoint_restore": restore, "checkpoint_delete": delete}


def answered(spark: SparkSession, request: dict[str, Any], home: str | None = None) -> dict[str, Any]:
    """The answer to {"id", "tool", "arguments"}: its result, or what was wrong."""
    try:
        result = TOOLS[request["tool"]](spark, **request.get("arguments", {}), home=home)
        return {"id": request.get("id"), "result": result}
    except (StoreError, KeyError, TypeError, OSError) as e:
        return {"id": request.get("id"), "error": f"{type(e).__name__}: {e}"}


def serve(spark: SparkSession, lines: IO[str], out: IO[str], home: str | None = None) -> None:
    """Answers requests, one JSON text a line, until the lines end."""
    for line in lines:
        if line.strip():
            try:
                answer = answered(spark, json.loads(line), home)
            except ValueError as e:
                answer = {"id": None, "error": f"not JSON: {e}"}
            print(json.dumps(answer, default=str), file=out, flush=True)
