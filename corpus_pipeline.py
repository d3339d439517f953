"""A training corpus from the table ``documents``, stage by stage.

Every stage takes what its predecessor kept and decides over all of it; its
rows are written as Parquet to the shared folder before the next one reads
them, so a lost executor repeats tasks of one stage only. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import table
from tidegraph.llm.decontaminate import decontaminate
from tidegraph.llm.line_frequency import apply_quality_rules
from tidegraph.llm.line_templates import apply_line_dedup
from tidegraph.llm.packing import pack_texts, with_prompts
from tidegraph.llm.queries import MAX_LOSS, word_bpe
from tidegraph.llm.simhash import drop_near_duplicates
from tidegraph.runtime import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are frequent on their host."""
    return apply_quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template stands in an earlier document, less those of which little is left."""
    return apply_line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs, similarity=0.8, words=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of 2048 tokens, with limits on loss tokens and segments."""
    pieces = pack_texts(with_prompts(docs), word_bpe(), end_id=1, max_loss=MAX_LOSS, prompt="prompt")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

# Templates, fingerprints and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
