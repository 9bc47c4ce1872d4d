"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  A stage's result is written as Parquet and read again as the next one's docs; these tables
are removed when the application ends.

Cases, for every stage: nulls in any column, empty and very long texts, ties and repeated rows are handled
as its operator states; an empty table gives no rows; columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, language, mixing, packing, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and whose perplexity is in their language's band; null texts go."""
    return quality.kept_documents(docs).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows near enough to a language's centroids; null texts and texts without letters go."""
    return language.accepted_documents(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each group of texts linked by likeness of 0.8 or more; null ids are last."""
    return simhash.first_of_groups(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture uses it, once at least; a null source is a source."""
    return mixing.mixed_documents(docs, repetition=2.0, floor=1.0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens, with their ids (little-endian uint32); a null text is its end id alone."""
    # a smaller memo than op3's: workers and JVMs have the stages before behind them
    return packing.pack_documents(docs, memo=500_000, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Kneser-Ney bands, centroids and tokenisation are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
