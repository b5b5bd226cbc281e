"""What the training-data operators share: table reads, written intermediate tables, null-safe row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import drop_tables, forgotten, narrowed, setting, swept, written

__all__ = ["drop_tables", "forgotten", "free_name", "let", "narrowed", "setting", "swept", "table", "words_of", "written"]

#: The words of contract texts: runs of anything but ASCII white space (a Java pattern of the separators).
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet (extra columns may clash with ours)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name
