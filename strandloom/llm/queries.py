"""Registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, linerules, mixing, oracles, sharding
from .runtime import read


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents")).select("doc_id", "shard", "level", "shard_docs", "shard_bytes")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(read(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.digest(repeats.remove_repeats(read(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import runtime, tokens

    out = runtime.scratch(spark, "tokens")
    tokens.write_tokens(read(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_table(spark, out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.quality_rules(read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.digest(licences.scan(read(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.spelling_groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_chat_formatting, op3_mixing, op4_quality_classifier, op5_substring_dedup, op6_decontamination, op7_token_binary, op8_toxicity, op9_quality_rules, op10_minhash_near_dedup, op11_filter_audit, op12_license_scan, op13_spelling_variants)}
SQL: dict[str, str] = {"op1_sharding": sharding.sql(), "op2_chat_formatting": chat.SQL, "op3_mixing": mixing.sql(), "op5_substring_dedup": oracles.SUBSTRING, "op6_decontamination": oracles.CONTAMINATION, "op9_quality_rules": linerules.SQL, "op10_minhash_near_dedup": oracles.NEAR, "op11_filter_audit": audit.SQL}
