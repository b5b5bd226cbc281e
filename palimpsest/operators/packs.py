"""Packs: blobs appended one after another, cut into parts, found again by hash or range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import part_name
from .ranks import sums_before

#: Bytes before the first entry, and before each entry's data.
HEADER, ENTRY = 8, 24


def with_offsets(entries: DataFrame, *, pack: str = "pack_hash", order: str = "blob_hash", length: str = "compressed_len") -> DataFrame:
    """entries with their offset in the pack, in the order of their hashes; a pack may be any share of the rows."""
    out = sums_before(entries, [pack], [F.col(order)], F.col(length) + ENTRY, "offset")
    return out.withColumn("offset", F.col("offset") + HEADER)


def with_offsets_of_bounded(entries: DataFrame) -> DataFrame:
    """The same of packs of bounded size, in one window for each."""
    before = Window.partitionBy("pack_hash").orderBy("blob_hash").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", (F.coalesce(F.sum(F.col("compressed_len") + ENTRY).over(before), F.lit(0)) + HEADER).cast("long"))


def part_span(entries: DataFrame, part_bytes: int) -> DataFrame:
    """entries with the first and last fixed-size part that they lie in."""
    end = F.col("offset") + ENTRY + F.col("compressed_len") - 1
    return entries.withColumns({"first_part": F.floor(F.col("offset") / part_bytes), "last_part": F.floor(end / part_bytes)})


def parts(entries: DataFrame, part_bytes: int, *, pack: str = "pack_hash") -> DataFrame:
    """(pack, part, offset, size) of each pack's parts; their number follows from the pack's end."""
    if part_bytes < 1:
        raise ValueError("parts of no bytes")
    ends = entries.groupBy(pack).agg(F.max(F.col("offset") + ENTRY + F.col("compressed_len")).alias("end"))
    one = ends.select(pack, "end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1) / part_bytes))).alias("part"))
    return one.select(pack, "part", (F.col("part") * part_bytes).alias("offset"), F.least(F.lit(part_bytes), F.col("end") - F.col("part") * part_bytes).alias("size"))


def range_parts(ranges: DataFrame, parts_: DataFrame, part_bytes: int, *, pack: str = "pack_hash") -> DataFrame:
    """(pack, start, end, part) of what parts each byte range [start, end) touches.

    Parts are of one size, so the range condition is an equality on part numbers: no nested loop.
    """
    touched = ranges.select(pack, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / part_bytes), F.floor((F.col("end") - 1) / part_bytes))).alias("part"))
    return touched.join(parts_.select(pack, "part", "offset", "size"), [pack, "part"]).where((F.col("start") < F.col("offset") + F.col("size")) & (F.col("end") > F.col("offset"))).select(pack, "start", "end", "part")


def contiguity(parts_: DataFrame, *, pack: str = "pack_hash") -> DataFrame:
    """parts with expected: where the part before ends; and contiguous."""
    order = Window.partitionBy(pack).orderBy("part")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(0))
    return parts_.withColumn("expected", expected.cast("long")).withColumn("contiguous", F.col("offset") == F.col("expected"))


def located(needed: DataFrame, blobs: DataFrame, *, strict: bool = False) -> DataFrame:
    """Distinct needed hashes with their pack; found tells whether there is one. strict: a missing one is an error."""
    first = blobs.groupBy("blob_hash").agg(F.min("pack_hash").alias("pack_hash"))  # of several packs with a blob, the first
    hits = needed.select("blob_hash").distinct().join(first, "blob_hash", "left")
    if strict:
        return hits.withColumn("pack_hash", F.coalesce("pack_hash", F.raise_error(F.concat(F.lit("no stored blob: "), F.col("blob_hash").cast("string"))).cast("string")))
    return hits.withColumn("found", F.col("pack_hash").isNotNull())


def restore_tasks(paths: DataFrame, target: DataFrame, entries: DataFrame) -> DataFrame:
    """(pack_hash, offset, path, size) to write, so ordered within partitions."""
    wanted = target.select("path", "blob_hash", "size").join(paths.select("path"), "path", "left_semi")
    return wanted.join(entries.select("blob_hash", "pack_hash", "offset"), "blob_hash").select("pack_hash", "offset", "path", "size")


def packs_needed(needed: DataFrame, blobs: DataFrame) -> DataFrame:
    return blobs.join(needed.select("blob_hash"), "blob_hash", "left_semi").select("pack_hash").distinct()


def reference_counts(packs: DataFrame, blobs: DataFrame) -> DataFrame:
    """(pack_hash, n) with zero for packs that hold nothing any more."""
    counts = blobs.groupBy("pack_hash").agg(F.count(F.lit(1)).alias("n"))
    return packs.select("pack_hash").distinct().join(counts, "pack_hash", "left").select("pack_hash", F.coalesce("n", F.lit(0)).alias("n"))


def dead_bytes(blobs: DataFrame, reachable: DataFrame) -> DataFrame:
    """(pack_hash, live_bytes, dead_bytes)."""
    marked = blobs.join(reachable.select("blob_hash").distinct().withColumn("live", F.lit(True)), "blob_hash", "left")
    return marked.groupBy("pack_hash").agg(F.coalesce(F.sum(F.when(F.col("live"), F.col("size"))), F.lit(0)).alias("live_bytes"), F.coalesce(F.sum(F.when(F.col("live").isNull(), F.col("size"))), F.lit(0)).alias("dead_bytes"))


def pieces(blobs: DataFrame, part_bytes: int | None) -> DataFrame:
    """blobs (pack_hash, blob_hash, offset, compressed_len, data) cut at the borders of parts: part, and the bytes of data in it; without a size, parts are whole packs."""
    if part_bytes is None:
        return blobs.withColumn("part", F.lit(0).cast("long"))
    start = F.col("offset") + ENTRY
    last = F.greatest(F.floor(start / part_bytes), F.floor((start + F.col("compressed_len") - 1) / part_bytes))
    each = blobs.withColumn("part", F.explode(F.sequence(F.floor(start / part_bytes), last)))
    begin, end = F.greatest(F.col("part") * part_bytes, start), F.least((F.col("part") + 1) * part_bytes, start + F.col("compressed_len"))
    return each.withColumn("data", F.substring("data", (begin - start + 1).cast("int"), (end - begin).cast("int")))


def rejoined(pieces_: DataFrame) -> DataFrame:
    """The blobs of such pieces: a range read across borders of parts."""
    whole = pieces_.groupBy("pack_hash", "blob_hash").agg(F.min("offset").alias("offset"), F.min("compressed_len").alias("compressed_len"), F.array_sort(F.collect_list(F.struct("part", "data"))).alias("all"))
    return whole.withColumn("data", F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["data"]))).drop("all")


def pack_numbers(new: DataFrame, n_packs: int) -> DataFrame:
    """new (blob_hash, size) with the number of a pack: equal ranges of the hashes' hashes, so packs are about equally large."""
    return new.withColumn("pack", F.pmod(F.xxhash64("blob_hash"), F.lit(n_packs)))


def pack_names(numbered: DataFrame) -> DataFrame:
    """(pack, pack_hash): a pack is named by the hash of its entries' hashes in order; a pack has a bounded number of them."""
    return numbered.groupBy("pack").agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("blob_hash")), ",")), 1, 16).alias("pack_hash"))


PART_LIST = "array<struct<path: string, offset: bigint, size: bigint>>"


def part_lists(parts_: DataFrame, *, pack: str = "pack_hash") -> DataFrame:
    """(pack, json): the parts of each pack as the JSON text of its list; a pack has few parts."""
    named = F.struct(F.col("offset"), part_name(F.col(pack), F.col("part")).alias("path"), F.col("size"))
    listed = F.transform(F.array_sort(F.collect_list(named)), lambda x: F.struct(x["path"].alias("path"), x["offset"].alias("offset"), x["size"].alias("size")))
    return parts_.groupBy(pack).agg(F.to_json(listed).alias("json"))


def part_list_faults(lists: DataFrame, *, json: str = "json") -> DataFrame:
    """lists with fault: what is wrong with a part list (null: nothing): not a list, empty, a bad name or size, or a gap."""
    found = lists.withColumn("parts_", F.from_json(json, PART_LIST))
    whole = F.aggregate("parts_", F.lit(0).cast("long"), lambda end, p: F.when((end >= 0) & (p["offset"] == end) & (p["size"] > 0), end + p["size"]).otherwise(F.lit(-1).cast("long")))
    bad_name = F.exists("parts_", lambda p: p["path"].isNull() | p["path"].contains("/") | (p["path"] == "") | (p["path"] == ".."))
    fault = F.when(F.col("parts_").isNull(), "not a list").when(F.size("parts_") == 0, "empty").when(bad_name, "bad name").when(F.coalesce(whole, F.lit(-1)) < 0, "gap")
    return found.withColumn("fault", fault).drop("parts_")


def checked_part_lists(lists: DataFrame, *, json: str = "json") -> DataFrame:
    """lists, or an error at the first one that is faulty."""
    faults = part_list_faults(lists, json=json)
    return faults.where(F.when(F.col("fault").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("part list: "), F.col("fault"))).cast("boolean"))).drop("fault")
