"""A store of snapshots: Parquet tables, each commit a new version, one pointer file that names the versions.

A commit writes its tables to new folders and then replaces the pointer by a rename, so readers see all
of a commit or nothing of it. One writer at a time holds the lock file; it also deletes the folders that no
version names any more. Files go through Hadoop's file systems, so a store can lie anywhere that Spark writes.

Blobs lie in packs of bounded size, each in a folder of its own, compressed. Contents are read for their
hashes bit by bit or a batch at a time, once for all links of an inode, and are moved only where the store
doesn't have them yet, one path for each hash.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import lz4_frame, lz4_plain
from ..functions.paths import is_excluded
from ..operators import catalog, merkle, packs, states
from ..operators.tables import forgotten, written
from .errors import AmbiguousReference, LockHeld, ObjectNotFound, RestoreFailed, SnapshotNotFound, StoreCorrupted

SCHEMAS = {
    "snapshots": "id string, created_at timestamp, message string, parent_snapshot_id string, manifest_snapshot_id string, root_tree_hash string, total_files bigint, total_bytes bigint, new_objects bigint",
    "snapshot_files": "snapshot_id string, path string, blob_hash string, size bigint, mode int",
    "blob_index": "blob_hash string, pack_hash string, size bigint",
    "file_index": "path string, blob_hash string, size bigint, mtime_secs bigint, mtime_nanos bigint, inode bigint, mode int",
    "tree_nodes": "tree_hash string, entries array<struct<name: string, entry_type: string, hash: string, size: bigint, mode: int>>",
    "blobs": "pack_hash string, blob_hash string, offset bigint, compressed_len bigint, part bigint, data binary",
}
_STATE = ("path", "blob_hash", "size", "mode")
Load = Callable[[DataFrame], DataFrame]


def uuid7() -> str:
    """A time-ordered id."""
    n = int(time.time() * 1000) << 80 | 7 << 76 | int.from_bytes(os.urandom(10)) & ((1 << 76) - 1)
    return str(uuid.UUID(int=n & ~(3 << 62) | 2 << 62))


class Store:
    def __init__(self, spark: SparkSession, root: str, *, hasher: Callable = F.md5, pack_bytes: int = 256 << 20, pack_entries: int = 1 << 18, dead_share: float = 0.5, progress: Callable[[str, dict], None] | None = None):
        """pack_bytes, pack_entries: about how much a pack holds; dead_share: from which share of dead bytes on a pack is rewritten; progress: hears of each step."""
        self.spark, self.root, self.hasher = spark, root.rstrip("/"), hasher
        self.pack_bytes, self.pack_entries, self.dead_share = pack_bytes, pack_entries, dead_share
        self.progress = progress or (lambda step, figures: None)

    # Files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_current").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict[str, list[str]]:
        fs, path = self._fs(), self._path("_current")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, pointer: dict[str, list[str]]) -> None:
        fs, staged = self._fs(), self._path(f"_staged-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("_current").toUri(), self.spark._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(staged, self._path("_current"), array)

    @contextmanager
    def _lock(self) -> Iterator[None]:
        fs, path = self._fs(), self._path("_lock")
        if not fs.createNewFile(path):
            raise LockHeld(f"{self.root} is being written")
        try:
            yield
        finally:
            fs.delete(path, False)

    def table(self, name: str) -> DataFrame:
        folders = self._pointer().get(name)
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{f}" for f in folders))

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema))

    def _write(self, name: str, df: DataFrame, by: str | None = None) -> str:
        folder, typed = f"{name}/{uuid.uuid4().hex}", self._typed(name, df)
        (typed.sortWithinPartitions(by) if by else typed).write.option("compression", "lz4_raw").parquet(f"{self.root}/{folder}")
        return folder

    def _folders(self, name: str) -> list[str]:
        """The folders in a folder of the store."""
        fs, path = self._fs(), self._path(name)
        return [f"{name}/{x.getPath().getName()}" for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []

    def _write_packs(self, blobs: DataFrame, part_bytes: int | None) -> list[str]:
        """Writes blobs (pack_hash, blob_hash, compressed_len, data); the folders of their packs."""
        folder = f"blobs/{uuid.uuid4().hex}"
        typed = self._typed("blobs", packs.pieces(packs.with_offsets_of_bounded(blobs), part_bytes)).withColumn("pack", F.col("pack_hash"))
        typed.sortWithinPartitions("pack", "blob_hash", "part").write.option("compression", "none").partitionBy("pack").parquet(f"{self.root}/{folder}")
        return self._folders(folder)

    def _drop_unnamed(self) -> None:
        """Deletes what the pointer doesn't name; the lock is held."""
        fs = self._fs()
        named = {f for folders in self._pointer().values() for f in folders}
        for name in SCHEMAS:
            for folder in self._folders(name):
                inside = self._folders(folder) if name == "blobs" else []
                kept = [f for f in inside if f in named]
                for f in [folder] if folder not in named and not kept else [f for f in inside if f not in named]:
                    fs.delete(self._path(f), True)

    # Reading

    def list(self, limit: int | None = None) -> DataFrame:
        return catalog.newest_first(self.table("snapshots"), limit)

    def resolve(self, ref: str) -> str:
        """The id that `latest`, an id or a unique prefix of one means."""
        snapshots = self.table("snapshots")
        if ref == "latest":
            found = catalog.newest_first(snapshots, 1).select("id").collect()
        else:
            found = snapshots.where(F.col("id") == ref).select("id").limit(1).collect() or snapshots.where(F.lower("id").startswith(ref.lower())).select("id").limit(2).collect()
        if not found:
            raise SnapshotNotFound(ref)
        if len(found) > 1:
            raise AmbiguousReference(ref)
        return found[0].id

    def manifest(self, ref: str) -> DataFrame:
        one = self.table("snapshots").where(F.col("id") == self.resolve(ref))
        return catalog.manifests(one, self.table("snapshot_files")).select(*_STATE)

    def root_hash(self, ref: str) -> str | None:
        """The root of a snapshot's tree: as stored, else made from its manifest."""
        stored = self.table("snapshots").where(F.col("id") == self.resolve(ref)).select("root_tree_hash").first()[0]
        if stored:
            return stored
        root = merkle.nodes(self.manifest(ref)).where("dir = ''").select("tree_hash").collect()
        return root[0].tree_hash if root else None

    def hashed(self, files: DataFrame, load: Load | None = None, digest: Load | None = None) -> DataFrame:
        """files (relative_path, size, mode, mtime_*, inode and device; content unless load gives it) with path and blob_hash, without contents.

        Contents are read only where the index doesn't know the hash or its blob is gone, once for all links
        of an inode, in the order of inodes. digest: gives the rows of load's argument blob_hash, without contents.
        """
        named = files.withColumnRenamed("relative_path", "path") if "relative_path" in files.columns else files
        probed = states.cache_probe(named, self.table("file_index"), self.table("blob_index"))
        hits = probed.where("cached_hash is not null").withColumnRenamed("cached_hash", "blob_hash").drop("content")
        misses = probed.where("cached_hash is null").drop("cached_hash")
        if load is None:
            return hits.unionByName(misses.withColumn("blob_hash", self.hasher(F.col("content"))).drop("content"))
        misses = misses.drop("content")
        if {"device", "inode"} <= set(misses.columns):
            misses = written(states.hardlink_groups(misses).drop("links"))
        else:
            misses = written(misses.withColumn("read_path", F.col("path")))
        order = [F.col("inode").asc_nulls_last()] if "inode" in misses.columns else []
        read = misses.where("path = read_path").drop("read_path").withColumnRenamed("path", "relative_path")
        read = read.repartitionByRange(*order, "relative_path").sortWithinPartitions(*order, "relative_path")
        read = digest(read) if digest else load(read).withColumn("blob_hash", self.hasher(F.col("content")))
        once = written(read.select(F.col("relative_path").alias("read_path"), "blob_hash"))
        return hits.unionByName(misses.join(once, "read_path").drop("read_path"))

    def diff(self, ref: str, current: DataFrame, *, include_mode: bool = False) -> DataFrame:
        """(path, status) of what a restore of ref would do to current (path, blob_hash, mode)."""
        return states.diff(self.manifest(ref), current, include_mode=include_mode)

    # Writing

    def _new_packs(self, new: DataFrame, n_new: int) -> DataFrame:
        """new (blob_hash, size) with the pack_hash of packs of bounded size."""
        total = new.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        numbered = written(packs.pack_numbers(new, max(1, -(-total // self.pack_bytes), -(-n_new // self.pack_entries))))
        return written(numbered.join(packs.pack_names(numbered), "pack").drop("pack"))

    def _contents(self, files: DataFrame, chosen: DataFrame, load: Load | None) -> DataFrame:
        """chosen (path, blob_hash, ...) with their contents compressed as data; a content that isn't what was hashed is an error."""
        if load:
            read = load(chosen.withColumnRenamed("path", "relative_path"))
        else:
            named = files.withColumnRenamed("relative_path", "path") if "relative_path" in files.columns else files
            read = named.select("path", "content").join(chosen, "path")
        changed = F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("blob_hash")))
        same = F.when(self.hasher(F.col("content")) == F.col("blob_hash"), F.col("content")).otherwise(changed.cast("binary"))
        framed = read.select("pack_hash", "blob_hash", lz4_frame(same.cast("binary")).alias("data"))
        return framed.withColumn("compressed_len", F.octet_length("data").cast("long"))

    def save(self, files: DataFrame, message: str | None = None, *, include_deps: bool = False, load: Load | None = None, digest: Load | None = None, pack_chunk_bytes: int | None = None) -> dict:
        """Records the files (see hashed()) as a snapshot: its id and counts. pack_chunk_bytes: cuts new packs into parts of this size."""
        with self._lock():
            path = "relative_path" if "relative_path" in files.columns else "path"
            wanted = files.where(~is_excluded(F.col(path), include_deps))
            rows = written(self.hashed(wanted, load, digest))
            state = rows.select(*_STATE)
            new = written(states.new_objects(state, self.table("blob_index")))
            pointer = self._pointer()
            total = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
            n_new = new.count()
            self.progress("scanned", {"files": total.n, "bytes": total.bytes, "new_objects": n_new})
            if n_new:
                placed = self._new_packs(new, n_new)
                one_path = rows.groupBy("blob_hash").agg(F.min("path").alias("path"))
                chosen = written(placed.select("blob_hash", "pack_hash").join(one_path, "blob_hash"))
                folders = self._write_packs(self._contents(wanted, chosen, load), pack_chunk_bytes)
                pointer["blobs"] = [*pointer.get("blobs", []), *folders]
                pointer["cut"] = [*pointer.get("cut", []), *(folders if pack_chunk_bytes else [])]
                pointer["blob_index"] = [*pointer.get("blob_index", []), self._write("blob_index", placed)]
                forgotten(placed, chosen)
                self.progress("packed", {"packs": len(folders)})
            snapshots = self.table("snapshots")
            parent = catalog.newest_first(snapshots, 1).collect()
            alias_of = None
            if parent and states.same_manifest(self.manifest(parent[0].id), state):
                alias_of, root = parent[0].manifest_snapshot_id or parent[0].id, parent[0].root_tree_hash
            else:
                nodes = written(merkle.nodes(state))
                root_row = nodes.where("dir = ''").select("tree_hash").collect()
                root = root_row[0].tree_hash if root_row else None
                trees = merkle.tree_table(nodes).join(self.table("tree_nodes").select("tree_hash"), "tree_hash", "left_anti")
                pointer["tree_nodes"] = [*pointer.get("tree_nodes", []), self._write("tree_nodes", trees)]
            ident = uuid7()
            if alias_of is None:
                pointer["snapshot_files"] = [*pointer.get("snapshot_files", []), self._write("snapshot_files", state.withColumn("snapshot_id", F.lit(ident)), "path")]
            row = self.spark.range(1).select(F.lit(ident).alias("id"), F.current_timestamp().alias("created_at"), F.lit(message).alias("message"), F.lit(parent[0].id if parent else None).alias("parent_snapshot_id"), F.lit(alias_of).alias("manifest_snapshot_id"), F.lit(root).alias("root_tree_hash"), F.lit(total.n).alias("total_files"), F.lit(total.bytes).alias("total_bytes"), F.lit(n_new).alias("new_objects"))
            pointer["snapshots"] = [*pointer.get("snapshots", []), self._write("snapshots", row)]
            wanted = [c.split()[0] for c in SCHEMAS["file_index"].split(", ")]
            have = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in wanted]
            pointer["file_index"] = [self._write("file_index", rows.select(*have))]
            self._publish(pointer)
            self._drop_unnamed()
            forgotten(rows, new)
            self.progress("saved", {"snapshot_id": ident})
            return {"snapshot_id": ident, "total_files": total.n, "total_bytes": total.bytes, "new_objects": n_new}

    def restored(self, ref: str, current: DataFrame | None = None) -> DataFrame:
        """(path, mode, data, pack_hash, offset) to write so that current becomes ref; a missing blob is an error."""
        manifest = self.manifest(ref)
        if current is not None:
            manifest = manifest.join(states.diff(manifest, current).where("status in ('add', 'change')").select("path"), "path", "left_semi")
        found = packs.located(manifest, self.table("blob_index"))
        lost = found.where("not found").limit(1).collect()
        if lost:
            raise ObjectNotFound(lost[0].blob_hash)
        needed = manifest.join(found.select("blob_hash", "pack_hash"), "blob_hash")
        blobs = self.table("blobs")
        if self._pointer().get("cut"):
            blobs = packs.rejoined(blobs.join(needed.select("pack_hash", "blob_hash").distinct(), ["pack_hash", "blob_hash"], "left_semi"))
        both = needed.join(blobs.select("pack_hash", "blob_hash", "offset", F.col("data").alias("framed")), ["pack_hash", "blob_hash"], "left").withColumn("data", lz4_plain("framed", "size"))
        broken = F.raise_error(F.concat(F.lit("the store is corrupted: "), F.col("blob_hash")))
        return both.select("path", "mode", F.when(F.coalesce(self.hasher(F.col("data")) == F.col("blob_hash"), F.lit(False)), F.col("data")).otherwise(broken.cast("binary")).alias("data"), "pack_hash", "offset")

    def restore(self, ref: str, current: DataFrame, target: str | None = None, *, dry_run: bool = False) -> dict:
        """Counts of what a restore does; with a target folder that executors share, does it: removals first, then each file staged and renamed."""
        changes = written(self.diff(ref, current))
        counts = {r.status: r.n for r in states.summary(changes).collect()}
        result = {k: counts.get(s, 0) for k, s in (("files_added", "add"), ("files_changed", "change"), ("files_removed", "remove"), ("files_unchanged", "unchanged"))}
        if dry_run or target is None:
            return result
        with self._lock():
            try:
                changes.where("status = 'remove'").select("path").foreachPartition(lambda rows: _remove(target, rows))
                self.progress("removed", {"files": result["files_removed"]})
                tasks = self.restored(ref, current).repartitionByRange("pack_hash", "offset").sortWithinPartitions("pack_hash", "offset", "path")
                tasks.select("path", "mode", "data").foreachPartition(lambda rows: _materialize(target, rows))
                self._prune(target, changes)
            except PySparkException as e:
                raise (StoreCorrupted if "corrupted" in str(e) else RestoreFailed)(f"{ref}: {str(e).splitlines()[0][:300]}") from e
            self.progress("restored", result)
        return result

    def _prune(self, target: str, changes: DataFrame) -> None:
        """Removes directories that are empty now: level by level, deepest first, each level on the executors."""
        gone = written(merkle.empty_after_removal(changes.where("status = 'remove'"), changes.where("status <> 'remove'")))
        for row in gone.select("depth").distinct().orderBy(F.col("depth").desc()).collect():
            gone.where(F.col("depth") == row.depth).select("dir").foreachPartition(lambda rows: _remove_folders(target, rows))
        forgotten(gone)

    def delete(self, ident: str) -> dict:
        """Deletes a snapshot by its exact id and the blobs that nothing reaches any more.

        Packs without live blobs go; the live blobs of packs with many dead bytes move to new packs; others stay as they are.
        """
        with self._lock():
            snapshots = self.table("snapshots")
            gone = snapshots.where(F.col("id") == ident)
            if gone.isEmpty():
                raise SnapshotNotFound(ident)
            kept, files = catalog.after_delete(snapshots, self.table("snapshot_files"), gone)
            pointer = {**self._pointer(), "snapshots": [self._write("snapshots", kept)], "snapshot_files": [self._write("snapshot_files", files)]}
            self._publish(pointer)
            index = self.table("blob_index")
            dead = written(catalog.sweep(index, catalog.reachable(self.table("snapshots"), self.table("snapshot_files"))))
            n, freed = dead.count(), 0
            if n:
                live = written(index.join(dead.select("blob_hash"), "blob_hash", "left_anti"))
                of_pack = packs.dead_bytes(index, live).where("dead_bytes > 0").withColumn("moves", F.col("dead_bytes") >= self.dead_share * (F.col("live_bytes") + F.col("dead_bytes")))
                leaves = of_pack.where("live_bytes = 0 or moves").select("pack_hash")
                left = {r.pack_hash for r in leaves.collect()}  # of a store's packs, which the pointer names as well
                moving = written(live.join(leaves, "pack_hash", "left_semi").select("blob_hash", "size", F.col("pack_hash").alias("old_pack")))
                folders = [f for f in pointer.get("blobs", []) if f.rpartition("=")[2] not in left]
                freed, n_moving = len(pointer.get("blobs", [])) - len(folders), moving.count()
                if n_moving:
                    placed = self._new_packs(moving, n_moving)
                    old = self.table("blobs")
                    old = packs.rejoined(old.join(leaves, "pack_hash", "left_semi")) if pointer.get("cut") else old
                    data = old.select(F.col("pack_hash").alias("old_pack"), "blob_hash", "compressed_len", "data").join(placed, ["old_pack", "blob_hash"])
                    folders += self._write_packs(data.select("pack_hash", "blob_hash", "compressed_len", "data"), None)
                    live = live.join(leaves, "pack_hash", "left_anti").unionByName(placed.drop("old_pack"))
                pointer |= {"blob_index": [self._write("blob_index", live)], "blobs": folders, "cut": [f for f in pointer.get("cut", []) if f in folders]}
                self._publish(pointer)
            self._drop_unnamed()
            self.progress("deleted", {"snapshot_id": ident, "dead_blobs": n, "freed_packs": freed})
            return {"deleted": ident, "dead_blobs": n, "freed_packs": freed}


def _remove(root: str, rows) -> None:
    for r in rows:
        try:
            os.remove(os.path.join(root, r.path))
        except FileNotFoundError:
            continue


def _remove_folders(root: str, rows) -> None:
    for r in rows:
        try:
            os.rmdir(os.path.join(root, r.dir))
        except OSError:
            continue


def _materialize(root: str, rows) -> None:
    for r in rows:
        path = os.path.join(root, r.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        staged = f"{path}.{uuid.uuid4().hex}"
        if r.mode & 0o170000 == 0o120000:
            os.symlink(bytes(r.data).decode(), staged)
        else:
            with open(staged, "wb") as f:
                f.write(bytes(r.data))
            os.chmod(staged, r.mode & 0o7777)
        os.replace(staged, path)
