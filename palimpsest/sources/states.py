"""States (path, blob_hash, size, mode) and catalogs derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_MODE, FILE_MODE = 41471, 33188


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_state(docs: DataFrame, which: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """State 0 (target) or 1 (current) of the documents: some rows are only in one, some changed in 1."""
    text = F.col("text") if which == 0 else F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("#v1"))).otherwise(F.col("text"))
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    mode = F.when(F.col("doc_id") % 97 == 0, F.lit(LINK_MODE)).otherwise(F.lit(FILE_MODE))
    rows = docs.where(F.col("doc_id") % 10 != (3 if which == 0 else 7))
    return rows.select(path.alias("path"), F.md5(text).alias("blob_hash"), F.octet_length(text).cast("long").alias("size"), mode.cast("long").alias("mode"), "doc_id", *keep)


def document_files(docs: DataFrame, which: int) -> DataFrame:
    """The same with contents and what a scan tells of files, for a store to save."""
    text = F.col("text") if which == 0 else F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("#v1"))).otherwise(F.col("text"))
    rows = document_state(docs.withColumn("content", F.encode(text, "UTF-8")), which, keep=("content",))
    nothing = F.lit(0).cast("long")
    return rows.select("path", "content", "size", F.col("mode").cast("int").alias("mode"), (F.col("doc_id") + which).alias("mtime_secs"), nothing.alias("mtime_nanos"), F.col("doc_id").alias("inode"))


def page_state(pages: DataFrame) -> DataFrame:
    """Paths are urls without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return pages.select(path.alias("path"), F.md5("html").alias("blob_hash"), F.octet_length("html").cast("long").alias("size"), F.lit(FILE_MODE).cast("long").alias("mode"))


def snapshots(orders: DataFrame) -> DataFrame:
    """Orders as snapshots of a customer's project; every fifth is an alias of the fourth order key before it."""
    alias = F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") - 4).cast("string"))
    return orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("message"), F.col("o_custkey").alias("project"), alias.alias("manifest_snapshot_id"))


def snapshot_files(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_orderkey").cast("string").alias("snapshot_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_partkey").alias("blob_hash"), F.col("l_quantity").cast("long").alias("size"))


def blob_index(lineitem: DataFrame) -> DataFrame:
    """Distinct parts as blobs, 64 packs."""
    return lineitem.groupBy(F.col("l_partkey").alias("blob_hash")).agg(F.max(F.col("l_quantity").cast("long")).alias("size")).withColumn("pack_hash", (F.col("blob_hash") % 64).cast("long"))


def bench_samples(events: DataFrame) -> DataFrame:
    """(side, metric, iteration, value) of events with a value."""
    return events.select(F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("side"), F.col("event_type").alias("metric"), F.col("event_id").alias("iteration"), "value")
