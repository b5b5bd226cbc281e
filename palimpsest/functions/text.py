"""Labels, sizes, and what benchmark logs say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = r"([a-z_]+)=([0-9.]+)"


def key_values(line: Column) -> Column:
    """map<string, double> of the `key=number` pairs of a line."""
    return F.map_from_arrays(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1)), F.transform(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2)), lambda x: x.cast("double")))


def line_kind(line: Column) -> Column:
    return F.when(line.startswith("benchmark_config "), "config").when(line.startswith("iteration="), "iteration").when(line.startswith("average "), "average").otherwise("other")


def label(text: Column) -> Column:
    """A file-name-like label: other characters become one dash, dashes at the ends go, nothing becomes `run`."""
    dashed = F.regexp_replace(F.trim(text), "[^a-zA-Z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("run"))


def human_size(size: Column) -> Column:
    """GB, MB or KB with one truncated decimal; bytes below."""
    s = size.cast("long")

    def unit(power: int, name: str) -> Column:
        tenths = F.floor(s * 10 / F.lit(1 << power))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(s >= 1 << 30, unit(30, "GB")).when(s >= 1 << 20, unit(20, "MB")).when(s >= 1 << 10, unit(10, "KB")).otherwise(F.concat(s.cast("string"), F.lit(" B")))


def human_duration(seconds: Column, decimals: int = 1) -> Column:
    return F.when(seconds >= 60, F.format_string(f"%dm %.{decimals}fs", F.floor(seconds / 60).cast("long"), seconds % 60)).otherwise(F.format_string(f"%.{decimals}fs", seconds))


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before) / before * 100)


def kib_as_mib(kib: Column) -> Column:
    return kib / 1024.0
