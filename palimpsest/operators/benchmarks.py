"""Benchmark analytics: samples, robust summaries, comparisons, notes on noise.

Samples are rows (run, scenario, metric, iteration, value); log lines become samples by parse().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_values, line_kind, percent_change
from .ranks import at_ranks, medians, ranked
from .tables import written


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """(kind, iteration, metric, value) of `key=number` log lines; iteration is null outside iterations."""
    pairs = lines.select(line_kind(F.col(value)).alias("kind"), key_values(F.col(value)).alias("pairs"))
    one = pairs.select("kind", F.try_element_at("pairs", F.lit("iteration")).cast("long").alias("iteration"), F.explode("pairs").alias("metric", "value"))
    return one.where(F.col("metric") != "iteration")


#: Log lines of a save's phases and of read variants; each number with its section and metric.
PHASE_LINES = (
    ("phases", "scan_ms", r"^\[scan\]\s+(\d+)ms"),
    ("phases", "index_total_ms", r"^\[index\]\s+(\d+)ms"),
    ("index", "load_ms", r"^\[index\]\s+\d+ms\s+\(load: (\d+)ms"),
    ("index", "check_ms", r"^\[index\].* check: (\d+)ms"),
    ("index", "cached", r"^\[index\].* cached: (\d+)"),
    ("index", "new", r"^\[index\].* new: (\d+)\)"),
    ("phases", "read_hash_compress_ms", r"^\[read\+hash\+compress\]\s+(\d+)ms"),
    ("metadata", "unique_objects", r"^\[read\+hash\+compress\].*\(unique: (\d+)"),
    ("metadata", "duplicate_objects", r"^\[read\+hash\+compress\].* dup: (\d+)\)"),
    ("phases", "pack_write_ms", r"^\[pack_write\]\s+(\d+)ms"),
    ("phases", "build_tree_ms", r"^\[build_tree\]\s+(\d+)ms"),
    ("metadata", "tree_dirs", r"^\[build_tree\].*\((\d+) dirs\)"),
    ("phases", "index_flush_ms", r"^\[index_flush\]\s+(\d+)ms"),
    ("variants", "dir_fd_cache_ms", r"^dir FD cache build: (\d+)ms"),
    ("metadata", "dir_fd_dirs", r"^dir FD cache build:.*\((\d+) dirs\)"),
    ("variants", "best_thread_count", r"^>> best: (\d+) threads"),
    ("variants", "best_threads_read_hash_ms", r"^>> best: \d+ threads \((\d+)ms\)"),
    ("variants", "baseline_read_hash_ms", r"^baseline \(std::fs, path order\)\s+(\d+)ms\s+\(\d+ threads\)$"),
    ("variants", "baseline_thread_count", r"^baseline \(std::fs, path order\)\s+\d+ms\s+\((\d+) threads\)$"),
    ("variants", "inode_sorted_read_hash_ms", r"^inode-sorted\s+(\d+)ms\s+\(\d+ threads\)$"),
    ("variants", "openat_read_hash_ms", r"^openat \+ inode-sorted\s+(\d+)ms\s+\(\d+ threads\)$"),
    ("variants", "mmap_hybrid_read_hash_ms", r"^mmap hybrid \+ inode-sorted\s+(\d+)ms\s+\(\d+ threads\)$"),
    ("variants", "combined_read_hash_ms", r"^ALL COMBINED\s+(\d+)ms\s+\(\d+ threads\)$"),
    ("resources", "peak_rss_kb", r"^peak_rss_kb=(\d+)$"),
)


def phases(lines: DataFrame, value: str = "value") -> DataFrame:
    """(the other columns, section, metric, value) of the numbers in a save pipeline's log lines."""
    line = F.trim(F.col(value))
    found = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.regexp_extract(line, pattern, 1).try_cast("double").alias("value")) for section, metric, pattern in PHASE_LINES))
    others = [c for c in lines.columns if c != value]
    return lines.select(*others, F.explode(F.filter(found, lambda x: x["value"].isNotNull())).alias("x")).select(*others, "x.section", "x.metric", "x.value")


def summarize(samples: DataFrame, keys: list[str]) -> DataFrame:
    """samples, mean, median, min, max, mad, relative_mad_pct, span_pct of value by keys (per cents 0 where the median is 0).

    Medians are exact and come from ranks, so a key may hold any share of the rows.
    """
    middle = written(medians(samples, keys, "value"))
    first = samples.groupBy(*keys).agg(F.count("value").cast("double").alias("samples"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")).join(middle, keys, "left")
    away = samples.join(middle, keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"))
    spread = medians(away, keys, "value", "mad")
    share = lambda x: F.when(F.col("median") == 0, F.lit(0.0)).otherwise(x / F.col("median") * 100)
    out = first.join(spread, keys, "left").withColumns({"relative_mad_pct": share(F.col("mad")), "span_pct": share(F.col("max") - F.col("min"))})
    return out.select(*keys, "samples", "mean", "median", "min", "max", "mad", "relative_mad_pct", "span_pct")


def upper_median(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The element at n div 2 of the sorted values: for even n the upper of the middle two."""
    return at_ranks(samples, keys, "value", lambda n: F.array(F.floor(n / 2))).withColumnRenamed("value", "upper_median")


def compare(before: DataFrame, after: DataFrame, keys: list[str], stat: str = "median") -> DataFrame:
    """(keys, before, after, delta, percent) of what both summaries have."""
    b, a = (df.select(*keys, F.col(stat).alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, keys).withColumns({"delta": F.col("after") - F.col("before"), "percent": percent_change(F.col("before"), F.col("after"))})


def resolved(summary: DataFrame, averages: DataFrame, keys: list[str]) -> DataFrame:
    """The value shown for a metric: its median, else the logged average, else its mean."""
    both = summary.join(averages.select(*keys, F.col("value").alias("average")), keys, "full_outer")
    return both.withColumn("shown", F.coalesce("median", "average", "mean"))


def unstable(summary: DataFrame, *, min_samples: int = 3, span_pct: float = 15.0, relative_mad_pct: float = 5.0) -> DataFrame:
    return summary.where((F.col("samples") >= min_samples) & ~((F.col("span_pct") < span_pct) & (F.col("relative_mad_pct") < relative_mad_pct)))


def coverage(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one of the runs has."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("side", F.lit("before")).unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("after")))


def pooled(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Iterations of several runs as one series, numbered anew by (round, iteration)."""
    numbered = ranked(runs, keys, [F.col("round"), F.col("iteration")], "number_")
    return numbered.withColumn("iteration", F.col("number_") + 1).drop("number_")


def rolled_up(samples: DataFrame, scenario: str = "scenario") -> DataFrame:
    """A roll-up of runs (scenario, run, section, metric, value): the summary of each metric over the runs, and how many runs the scenario has."""
    runs = samples.groupBy(scenario).agg(F.countDistinct("run").alias("ab_run_count"))
    return summarize(samples, [scenario, "section", "metric"]).join(runs, scenario)


def peaks(samples: DataFrame, keys: list[str], resource: str = "peak_rss_kb") -> DataFrame:
    """(keys, runs, mean, peak) of a resource that runs (keys, metric, value) measured."""
    some = samples.where((F.col("metric") == resource) & F.col("value").isNotNull())
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean"), F.max("value").alias("peak"))


#: The order in which comparisons show metrics, of operations, the catalog and the save pipeline.
METRIC_ORDER = (
    "cold_save_ms", "warm_save_ms", "incremental_save_ms", "restore_dry_run_ms", "restore_apply_ms",
    "open_ms", "bulk_upsert_ms", "insert_snapshot_ms", "latest_snapshot_ms", "resolve_prefix_ms", "list_snapshots_ms", "snapshot_manifest_ms", "blob_lookup_ms",
    "scan_ms", "index_total_ms", "baseline_read_hash_ms", "inode_sorted_read_hash_ms", "best_threads_read_hash_ms", "openat_read_hash_ms", "mmap_hybrid_read_hash_ms", "combined_read_hash_ms", "read_hash_compress_ms", "pack_write_ms", "build_tree_ms", "index_flush_ms",
)


def in_metric_order(compared: DataFrame, metric: str = "metric") -> DataFrame:
    """Known metrics in their order, others after them by name."""
    place = F.array_position(F.array(*map(F.lit, METRIC_ORDER)), F.col(metric))
    return compared.orderBy(F.when(place == 0, len(METRIC_ORDER) + 1).otherwise(place), metric)


def best(samples: DataFrame, keys: list[str], choice: str, cost: str, ordinal: str) -> DataFrame:
    """The choice of least cost, the first of equals."""
    return samples.groupBy(*keys).agg(F.min_by(choice, F.struct(cost, ordinal)).alias("best"), F.min(cost).alias("least"))


def alternating(rounds: int, spark) -> DataFrame:
    """(round, position, side): before first in even rounds, after first in odd ones."""
    one = spark.range(rounds).select(F.col("id").alias("round"), F.posexplode(F.when(F.col("id") % 2 == 0, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("after"), F.lit("before")))).alias("position", "side"))
    return one


def size_buckets(blobs: DataFrame, size: str = "size") -> DataFrame:
    """(bucket, n, bytes): small under 1 KiB, medium under 256 KiB, large."""
    bucket = F.when(F.col(size) < 1024, "small").when(F.col(size) < 262144, "medium").otherwise("large")
    return blobs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def size_shares(blobs: DataFrame, size: str = "size") -> DataFrame:
    """(n, tiny_percent, large_percent, megabytes): how many blobs that aren't empty are under 1 KiB, and from 64 KiB on."""
    some = blobs.where(F.col(size) > 0)
    part = lambda c: F.sum(F.when(c, 1).otherwise(0)) * 100.0 / F.count(F.lit(1))
    return some.agg(F.count(F.lit(1)).alias("n"), part(F.col(size) < 1024).alias("tiny_percent"), part(F.col(size) >= 65536).alias("large_percent"), (F.sum(size) / 1e6).alias("megabytes"))


def markdown(compared: DataFrame, name: str, stat: str = "median") -> DataFrame:
    """(place, line) of a Markdown table of a comparison; the heading has places -2 and -1."""
    body = compared.select(F.monotonically_increasing_id().alias("place"), F.format_string("| %s | %.2f | %.2f | %+.2f | %+.1f%% |", F.col(name), "before", "after", "delta", "percent").alias("line"))
    spark = compared.sparkSession
    heading = spark.createDataFrame([(-2, f"| {name} | before ({stat}) | after ({stat}) | delta | % |"), (-1, "|-|-|-|-|-|")], "place long, line string")
    return heading.unionByName(body).orderBy("place")
