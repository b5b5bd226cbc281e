"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import encode_documents
from .chat_format import format_conversations
from .decontaminate import contamination
from .html_extract import extract_main_text
from .language_id import identify
from .lm_score import score_documents
from .pii import find_personal_data
from .quality import quality_rules
from .secret_scan import scan_secrets
from .shared import table
from .simhash import near_duplicates

TOKENIZER = "word_bpe_49k.json"


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file at path; where none is named, the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_json())


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_documents(table(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "spans", "longest_match")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("removed_lines")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


_BY_NAME = (op1_bpe, op2_lm_score, op3_chat_format, op4_simhash, op5_language_id, op6_decontamination, op7_quality_rules, op8_secret_scan, op9_html, op10_pii)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _BY_NAME}

SQL: dict[str, str] = {"op2_lm_score": oracles.OP2, "op6_decontamination": oracles.OP6, "op7_quality_rules": oracles.OP7}
