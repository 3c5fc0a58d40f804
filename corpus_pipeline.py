"""The training corpus in five stages: quality rules, line dedup, near-duplicate dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.op4_lines import drop_lines
from blockloom.llm.op5_decontaminate import drop_leaks
from blockloom.llm.op7_packing import pack
from blockloom.llm.op8_quality import keep_documents
from blockloom.llm.op10_minhash import drop_near_duplicates
from blockloom.llm.scratch import Scratch
from blockloom.session import ship

#: No stage but the last could be told in SQL: the first needs a trained field.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: all without words (null or empty texts too) among them; repeated rows are judged each."""
    ship(spark)
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; one of which no word is left goes as a whole.

    Texts without words stay as they are, repeated rows are one document; other columns are carried
    through whatever their names, and n_chars follows the text.
    """
    ship(spark)
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, by word shingles at 0.8; the query op10_minhash has its own 0.85.

    Texts without words are near nothing and stay; of rows that repeat doc_id and text one stays.
    """
    ship(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows each; texts without words hold none."""
    ship(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences; a text without words is one closing token, a repeated row is packed again."""
    import public_tokenizers

    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is written and read again.  Empty tables give empty ones."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
