"""The stages of the corpus pipeline; each applies one operator and lets its decisions take effect.

A stage takes and returns the columns of documents, whatever they are besides doc_id, text and
source; where it changes texts, n_chars follows if there is such a column. The last returns the encoded
documents. Null and empty texts don't pass quality rules; the other stages pass them on. Repeated rows
are near copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .decontaminate import contamination
from .near_copies import one_of_each
from .quality import quality_rules as judged
from .quality import without_lines
from .queries import tokenizer_json
from .secret_scan import scan_secrets
from .shared import table


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if they have it, as their texts are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines above the limit."""
    rows = judged(docs, carry=(F.struct(*docs.columns).alias("row_"),)).where("kept")
    return counted(rows.select(*(without_lines(F.col("row_.text"), F.col("removed_lines")).alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard similarity of 0.8 or more) stays, the one with the least id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly passages go."""
    return counted(contamination(docs, table(spark, sf_dir, "benchmark"), clean=True))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return counted(scan_secrets(docs, redact="[secret]"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token ids of every document, with the digests of ids and decoded text."""
    return encode_documents(docs, tokenizer_json(), keep=tuple(c for c in ("lang", "source") if c in docs.columns), with_ids=True)
