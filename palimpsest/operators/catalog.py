"""Snapshots and their manifests: listing, finding, owning, deleting, collecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = snapshots.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def display(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(F.substring("id", 1, 8).alias("short_id"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.coalesce("message", F.lit("")).alias("message"))


def latest_by(snapshots: DataFrame, key: str) -> DataFrame:
    """(key, id, created_at) of the newest snapshot of each key, by partial maxima."""
    return snapshots.groupBy(key).agg(F.max(F.struct("created_at", "id")).alias("x")).select(key, "x.id", "x.created_at")


def prefix_verdicts(snapshots: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, hits, verdict): not found, found or ambiguous; ASCII case doesn't matter.

    Ids are listed under their beginnings of the lengths that are asked for, counted by beginning, and met
    by equality: time-ordered ids that all begin alike cost no more than others.
    """
    asked = prefixes.select("prefix", F.lower("prefix").alias("p"))
    lengths = asked.select(F.length("p").alias("length")).distinct()
    beginnings = snapshots.select(F.lower("id").alias("id")).join(F.broadcast(lengths), F.length("id") >= F.col("length"))  # as many lengths as an id has characters at most
    counts = beginnings.groupBy(F.expr("substring(id, 1, length)").alias("begins")).agg(F.count(F.lit(1)).alias("hits"))
    hits = asked.join(counts, F.col("p") == F.col("begins"), "left").select("prefix", F.coalesce("hits", F.lit(0)).alias("hits"))
    return hits.withColumn("verdict", F.when(F.col("hits") == 0, "not found").when(F.col("hits") == 1, "found").otherwise("ambiguous"))


def owner() -> Column:
    return F.coalesce("manifest_snapshot_id", "id")


def manifests(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest rows of snapshots, aliases through their owners, under the snapshot's own id."""
    owned = snapshots.select(F.col("id").alias("of_id"), owner().alias("owner_id"))
    return owned.join(files, F.col("owner_id") == F.col("snapshot_id")).drop("owner_id", "snapshot_id").withColumnRenamed("of_id", "snapshot_id")


def heirs(snapshots: DataFrame, deleted: DataFrame) -> DataFrame:
    """(old_owner, heir): for each deleted owner the newest alias that stays."""
    aliases = snapshots.join(deleted.select("id"), "id", "left_anti").where(F.col("manifest_snapshot_id").isNotNull())
    aliases = aliases.join(deleted.select(F.col("id").alias("manifest_snapshot_id")), "manifest_snapshot_id", "left_semi")
    return aliases.groupBy(F.col("manifest_snapshot_id").alias("old_owner")).agg(F.max(F.struct("created_at", "id"))["id"].alias("heir"))


def after_delete(snapshots: DataFrame, files: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """snapshots and files without the deleted ids; manifests that aliases need pass to the newest of them."""
    h = heirs(snapshots, deleted)
    kept = snapshots.join(deleted.select("id"), "id", "left_anti").join(h, F.col("manifest_snapshot_id") == F.col("old_owner"), "left")
    new_owner = F.when(F.col("heir").isNull(), F.col("manifest_snapshot_id")).when(F.col("heir") == F.col("id"), None).otherwise(F.col("heir"))
    kept = kept.withColumn("manifest_snapshot_id", new_owner).select(snapshots.columns)
    moved = files.join(h, F.col("snapshot_id") == F.col("old_owner"), "left").join(deleted.select(F.col("id").alias("d_id")), F.col("snapshot_id") == F.col("d_id"), "left")
    moved = moved.where(F.col("d_id").isNull() | F.col("heir").isNotNull()).withColumn("snapshot_id", F.coalesce("heir", "snapshot_id"))
    return kept, moved.select(files.columns)


def reachable(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct hashes that some snapshot's manifest holds."""
    owners = snapshots.select(owner().alias("snapshot_id")).distinct()
    return files.join(owners, "snapshot_id", "left_semi").select("blob_hash").distinct()


def sweep(blobs: DataFrame, reachable_: DataFrame) -> DataFrame:
    """Blobs that nothing reaches."""
    return blobs.join(reachable_.select("blob_hash"), "blob_hash", "left_anti")
