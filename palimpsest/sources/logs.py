"""Benchmark logs and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "label string, generated_at string, results array<struct<name: string, kind: string, parsed: struct<config: map<string, double>, iterations: array<map<string, double>>, average: map<string, double>>>>"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_results(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(label, scenario, iteration, metric, value) of result files; lines: a result to each line, not to each file."""
    runs = spark.read.schema(RESULTS).json(path, multiLine=not lines).select("label", F.explode("results").alias("r"))
    its = runs.select("label", F.col("r.name").alias("scenario"), F.posexplode("r.parsed.iterations").alias("iteration", "values"))
    return its.select("label", "scenario", F.col("iteration").cast("long"), F.explode("values").alias("metric", "value"))


def log_lines(events: DataFrame) -> DataFrame:
    """Events as benchmark log lines."""
    line = F.format_string("iteration=%d cold_save_ms=%d.50 warm_save_ms=%d.25", "event_id", F.col("event_id") % 97 + 40, F.col("event_id") % 13 + 9)
    return events.select(F.when(F.col("event_id") % 10 == 0, F.format_string("benchmark_config source_files=%d dirs=60", "event_id")).otherwise(line).alias("value"))
