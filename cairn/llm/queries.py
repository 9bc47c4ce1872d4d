"""The subpackage's queries, by name; each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, centroids, chat, language, lcp, lines, mixing, packing, quality, sharding, simhash, urls, wavelet
from .common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_wavelet": op4_wavelet,
    "op5_mixing": op5_mixing,
    "op6_urls": op6_urls,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_hamerly": op11_hamerly,
    "op12_alignment": op12_alignment,
    "op13_lines": op13_lines,
}

SQL: dict[str, str] = {"op1_chat": chat.SQL, "op13_lines": lines.SQL}
