"""Synthetic files, manifests, blobs and snapshots for benchmarks, from spark.range and expressions."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_files(spark: SparkSession, n: int, dirs: int, version: int = 0) -> DataFrame:
    """(path, content): bodies of about 4 KiB that differ by file and version."""
    body = F.concat(F.format_string(f"file=%d\nversion={version}\n", "id"), F.expr(f"repeat('x', cast(4096 + 17 * {version} + id % 31 as int))"))
    return spark.range(n).select(F.format_string("dir_%d/file_%d.txt", F.col("id") % dirs, "id").alias("path"), body.alias("content"))


@F.pandas_udf(T.BinaryType())
def xorshift_bytes(size: pd.Series, seed: pd.Series) -> pd.Series:
    """Pseudo-random bytes: the low bytes of a 64-bit xorshift sequence."""

    def one(n: int, state: int) -> bytes:
        out, state = bytearray(), (state or 1) & (2**64 - 1)
        for _ in range(n):
            state ^= state << 13 & (2**64 - 1)
            state ^= state >> 7
            state ^= state << 17 & (2**64 - 1)
            out.append(state & 255)
        return bytes(out)

    return pd.Series([one(int(n), int(s)) for n, s in zip(size, seed, strict=True)])


def manifest(spark: SparkSession, n: int, blobs: int) -> DataFrame:
    """(path, blob_hash, size, mode) in the shape of installed modules."""
    path = F.format_string("node_modules/pkg_%05d/dir_%03d/file_%06d.js", F.col("id") % 2048, F.col("id") % 128, "id")
    return spark.range(n).select(path.alias("path"), F.md5((F.col("id") % blobs).cast("string")).alias("blob_hash"), (4096 + F.col("id") % 1024).alias("size"), F.lit(0o100644).cast("long").alias("mode"))


def blobs(spark: SparkSession, n: int) -> DataFrame:
    """(blob_hash, pack_hash, size); every fifth is in no pack."""
    return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("blob_hash"), F.when(F.col("id") % 5 != 0, F.format_string("pack-%04x", F.col("id") % 512)).alias("pack_hash"), (4096 + F.col("id") % 1024).alias("size"))


def snapshots(spark: SparkSession, n: int) -> DataFrame:
    created = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-04-01 00:00:00")) + F.col("id"))
    return spark.range(n).select(F.format_string("019d%08x-0000-7000-8000-000000000000", "id").alias("id"), created.alias("created_at"), F.lit(None).cast("string").alias("manifest_snapshot_id"))


def write_files(files: DataFrame, root: str) -> None:
    """Writes files (path, content) under a folder that the executors share."""

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(bytes(r.content))

    os.makedirs(root, exist_ok=True)
    files.select("path", "content").foreachPartition(write)


def link_files(root: str, packages: int, links: int, pool: int) -> None:
    """A tree of installed packages on the driver's disk: each has `links` hard links to a pool of files."""
    os.makedirs(os.path.join(root, "pool"), exist_ok=True)
    for k in range(pool):
        with open(os.path.join(root, f"pool/{k}"), "w") as f:
            f.write(f"content {k}\n" * (k + 1))
    for p in range(packages):
        folder = os.path.join(root, f"packages/package_{p:05}")
        os.makedirs(folder, exist_ok=True)
        for k in range(links):
            os.link(os.path.join(root, f"pool/{(p * links + k) % pool}"), os.path.join(folder, f"file_{k}"))
