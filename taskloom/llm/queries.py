"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_tree, decontaminate, langid, lz_fingerprint, multi_index, perspectives, prefix_trie, simhash, suffix_dedup, token_planes, toxicity, urlfilter, whitening
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1_langid(table(spark, sf_dir, "documents"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_planes.token_planes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op3_url_filter(spark, table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.op5_perspectives(table(spark, sf_dir, "conversations"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_simhash(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op8_suffix_dedup(table(spark, sf_dir, "documents"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.op9_multi_index(table(spark, sf_dir, "embeddings"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.op11_lz_fingerprint(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op12_prefix_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13_whitening(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_token_planes": op2_token_planes,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_perspectives": op5_perspectives,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_multi_index": op9_multi_index,
    "op10_bpe_tree": op10_bpe_tree,
    "op11_lz_fingerprint": op11_lz_fingerprint,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op3_url_filter": urlfilter.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_perspectives": perspectives.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
