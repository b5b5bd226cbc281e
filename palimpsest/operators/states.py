"""Comparing keyed states (path, blob_hash, size, mode): caches, diffs, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

#: The file-type bits of a mode, and those of a symbolic link.
TYPE_BITS, SYMLINK = 0o170000, 0o120000
IDENTITY = ("mtime_secs", "mtime_nanos", "size", "inode", "mode")


def is_symlink(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(TYPE_BITS)) == SYMLINK


def diff(target: DataFrame, current: DataFrame, *, include_type: bool = True, include_mode: bool = False) -> DataFrame:
    """(path, status): add, remove, change, unchanged - what turns current into target."""
    columns = ["path", "blob_hash", "mode"]
    t = target.select(*(F.col(c).alias(f"t_{c}") for c in columns))
    c = current.select(*(F.col(c).alias(f"c_{c}") for c in columns))
    differs = ~F.col("t_blob_hash").eqNullSafe(F.col("c_blob_hash"))
    if include_type:
        differs |= is_symlink(F.col("t_mode")) != is_symlink(F.col("c_mode"))
    if include_mode:
        differs |= ~F.col("t_mode").eqNullSafe(F.col("c_mode"))
    status = F.when(F.col("c_path").isNull(), "add").when(F.col("t_path").isNull(), "remove").when(differs, "change").otherwise("unchanged")
    return t.join(c, F.col("t_path") == F.col("c_path"), "full_outer").select(F.coalesce("t_path", "c_path").alias("path"), status.alias("status"))


def summary(diffs: DataFrame) -> DataFrame:
    """(status, n), zero rows included by absence only."""
    return diffs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cache_probe(files: DataFrame, index: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """files with cached_hash: the index's hash where nothing about the file changed, else null.

    With blobs, a hash counts only if its blob is still stored.
    """
    known = index if blobs is None else index.join(blobs.select("blob_hash"), "blob_hash", "left_semi")
    known = known.select(F.col("path").alias("i_path"), F.col("blob_hash").alias("cached_hash"), *(F.col(c).alias(f"i_{c}") for c in IDENTITY))
    same = F.col("path") == F.col("i_path")
    for c in IDENTITY:
        same &= F.col(c).eqNullSafe(F.col(f"i_{c}"))
    return files.join(known, same, "left").drop("i_path", *(f"i_{c}" for c in IDENTITY))


def removed_paths(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.select("path").join(files.select("path"), "path", "left_anti")


def duplicate_groups(state: DataFrame) -> DataFrame:
    """(blob_hash, first_path, n) of contents under several paths."""
    return state.groupBy("blob_hash").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n")).where("n > 1")


def new_objects(state: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob_hash, size) of distinct contents that no blob holds yet."""
    return state.groupBy("blob_hash").agg(F.max("size").alias("size")).join(blobs.select("blob_hash").distinct(), "blob_hash", "left_anti")


def hardlink_groups(files: DataFrame) -> DataFrame:
    """files with the path that is read for all links of one inode; symbolic links and unknown inodes are their own.

    The least path of each (device, inode) by a grouped minimum, joined back: no window gathers an inode's rows.
    """
    linked = F.col("device").isNotNull() & F.col("inode").isNotNull() & ~is_symlink(F.col("mode"))
    first = files.where(linked).groupBy(F.col("device").alias("g_device"), F.col("inode").alias("g_inode")).agg(F.min("path").alias("g_path"), F.count(F.lit(1)).alias("g_n"))
    both = files.join(first, linked & (F.col("device") == F.col("g_device")) & (F.col("inode") == F.col("g_inode")), "left")
    return both.withColumns({"read_path": F.coalesce("g_path", "path"), "links": F.coalesce("g_n", F.lit(1))}).drop("g_device", "g_inode", "g_path", "g_n")


def by_locality(files: DataFrame) -> DataFrame:
    """files in the order of inodes (null last) and paths."""
    return files.orderBy(F.col("inode").asc_nulls_last(), "path")


def locality_places(files: DataFrame) -> DataFrame:
    """files with their place from 1 in that order."""
    placed = ranked(files, [], [F.col("inode").asc_nulls_last(), F.col("path")], "place_")
    return placed.withColumn("place", F.col("place_") + 1).drop("place_")


def first_occurrences(state: DataFrame) -> DataFrame:
    """state with is_new: whether a row has the least path of its content, by a grouped minimum joined back (a content may be any share of the rows)."""
    first = state.groupBy(F.col("blob_hash").alias("f_hash")).agg(F.min("path").alias("f_path"))
    return state.join(first, F.col("blob_hash").eqNullSafe(F.col("f_hash"))).withColumn("is_new", F.col("path") == F.col("f_path")).drop("f_hash", "f_path")


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of equal keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def index_applied(index: DataFrame, removed: DataFrame, upserts: DataFrame) -> DataFrame:
    return upserted(index.join(removed.select("path"), "path", "left_anti"), upserts, "path")


def digest(state: DataFrame) -> DataFrame:
    """(n, digest): alike for equal manifests, whatever their order."""
    return state.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(path, blob_hash, mode, size))").alias("digest"))


def same_manifest(a: DataFrame, b: DataFrame) -> bool:
    """Whether two manifests hold the same rows: digests first, then both differences."""
    if digest(a).first() != digest(b).first():
        return False
    columns = ["path", "blob_hash", "size", "mode"]
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()
