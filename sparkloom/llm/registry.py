"""Queries of the training-data operators, with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, html_text, lexical_search, minhash_dedup, packing, preference_format, quality_model, quality_rules, secrets, suffix_dedup, token_rollups, warc
from .common import table

#: The tokenizer file's name under the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollups.maintained(table(spark, sf_dir, "documents"), tokenizer_path())


def rollups_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of op2 with a tokenizer version that SQL can count by."""
    return token_rollups.maintained(table(spark, sf_dir, "documents"), "marks-2")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumns(rounded)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.col("n_lexed"))


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 finds by the fixed patterns alone, for its SQL."""
    return secrets.scan(table(spark, sf_dir, "documents")).select(*secrets.BASE)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.digests(preference_format.against_next(table(spark, sf_dir, "conversations")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1,
        "op2_token_rollups": op2,
        "op3_html_text": op3,
        "op4_quality_rules": op4,
        "op5_quality_model": op5,
        "op6_decontaminate": op6,
        "op7_near_duplicates": op7,
        "op8_secrets": op8,
        "op9_packing": op9,
        "op10_preference_format": op10,
        "op11_lexical_search": op11,
        "op12_conversation_repair": op12,
        "op13_suffix_dedup": op13,
        "secret_base_spans": base_spans,
        "token_rollups_by_pattern": rollups_by_pattern,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op4_quality_rules": quality_rules.SQL,
        "op6_decontaminate": decontaminate.SQL,
        "op10_preference_format": preference_format.SQL,
        "op11_lexical_search": lexical_search.SQL,
        "op12_conversation_repair": conversation_repair.SQL,
        "secret_base_spans": secrets.BASE_SQL,
        "token_rollups_by_pattern": token_rollups.SQL,
    }
