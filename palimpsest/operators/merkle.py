"""Directory trees as Merkle nodes: built from the deepest level up, expanded from the root down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .tables import written

DIRECTORY_MODE = 0o040755
_ENTRY = ("name", "entry_type", "hash", "size", "mode")


def encoded(entries):
    """The canonical text of a node: name:type:hash:size:mode of its entries by name, joined by |."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws(":", e["name"], e["entry_type"], e["hash"], e["size"].cast("string"), e["mode"].cast("string"))), "|")


def directories(state: DataFrame) -> DataFrame:
    """(dir, depth) of every directory above a path, the root among them."""
    above = state.select(F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")))).alias("dir")).distinct()
    return above.select("dir", paths.depth(F.col("dir")).alias("depth"))


def nodes(state: DataFrame) -> DataFrame:
    """(dir, depth, tree_hash, entries) of all directories of a state (path, blob_hash, size, mode).

    One round for each level, deepest first; a level is written before the next reads it. Files are
    written by depth, so a round reads its own level's files only.
    """
    files = written(state.select(paths.depth(paths.parent(F.col("path"))).alias("level"), paths.parent(F.col("path")).alias("dir"), paths.base_name(F.col("path")).alias("name"), F.when(F.col("mode").bitwiseAND(F.lit(0o170000)) == 0o120000, "symlink").otherwise("file").alias("entry_type"), F.col("blob_hash").alias("hash"), F.col("size").cast("long").alias("size"), F.col("mode").cast("int").alias("mode")), by="level")
    dirs = written(directories(state))
    deepest = dirs.agg(F.max("depth")).first()[0]
    done, children = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = dirs.where(F.col("depth") == level).select("dir")
        entries = files.where(F.col("level") == level).drop("level")
        if children is not None:
            entries = entries.unionByName(children)
        grouped = here.join(entries.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("entries")), "dir", "left")
        made = written(grouped.select("dir", F.lit(level).alias("depth"), F.md5(encoded(F.col("entries"))).alias("tree_hash"), "entries"))
        children = made.where(F.col("dir") != "").select(paths.parent(F.col("dir")).alias("dir"), paths.base_name(F.col("dir")).alias("name"), F.lit("directory").alias("entry_type"), F.col("tree_hash").alias("hash"), F.lit(0).cast("long").alias("size"), F.lit(DIRECTORY_MODE).alias("mode"))
        done = made if done is None else done.unionByName(made)
    return done if done is not None else dirs.select("dir", "depth", F.lit("").alias("tree_hash"), F.lit(None).cast("array<struct<name:string,entry_type:string,hash:string,size:bigint,mode:int>>").alias("entries"))


def tree_table(nodes_: DataFrame) -> DataFrame:
    """(tree_hash, entries): each distinct node once."""
    return nodes_.groupBy("tree_hash").agg(F.first("entries").alias("entries"))


def expand(trees: DataFrame, root_hash: str, *, max_levels: int = 4096) -> DataFrame:
    """(path, blob_hash, entry_type) of all files under a root, level by level."""
    level = trees.sparkSession.createDataFrame([("", root_hash)], "prefix string, tree_hash string")
    found = None
    for _ in range(max_levels):
        entries = written(level.join(trees, "tree_hash").select("prefix", F.explode("entries").alias("e")).select(paths.joined(F.col("prefix"), F.col("e.name")).alias("path"), F.col("e.hash").alias("hash"), F.col("e.entry_type").alias("entry_type")))
        leaves = entries.where("entry_type <> 'directory'").select("path", F.col("hash").alias("blob_hash"), "entry_type")
        found = leaves if found is None else found.unionByName(leaves)
        level = entries.where("entry_type = 'directory'").select(F.col("path").alias("prefix"), F.col("hash").alias("tree_hash"))
        if level.isEmpty():
            return found
    raise ValueError(f"trees deeper than {max_levels}")


def reachable_blobs(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct blob hashes under any of the roots (tree_hash); each shared subtree is visited once."""
    seen = written(roots.select("tree_hash").distinct())
    frontier, blobs = seen, None
    while True:
        entries = written(frontier.join(trees, "tree_hash").select(F.explode("entries").alias("e")).select("e.hash", "e.entry_type").distinct())
        leaves = entries.where("entry_type <> 'directory'").select(F.col("hash").alias("blob_hash"))
        blobs = leaves if blobs is None else blobs.unionByName(leaves)
        frontier = written(entries.where("entry_type = 'directory'").select(F.col("hash").alias("tree_hash")).join(seen, "tree_hash", "left_anti"))
        if frontier.isEmpty():
            return blobs.distinct()
        seen = written(seen.unionByName(frontier))


def empty_after_removal(removed: DataFrame, remaining: DataFrame) -> DataFrame:
    """(dir, depth) of directories that hold nothing once `removed` is gone, deepest first."""
    above = lambda df: df.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()
    gone = above(removed).join(above(remaining), "dir", "left_anti")
    return gone.select("dir", paths.depth(F.col("dir")).alias("depth")).orderBy(F.col("depth").desc(), "dir")
