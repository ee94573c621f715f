"""The corpus pipeline: stages over ``documents``, each on all that its
predecessor kept. Stages come from ``ledgerloom.llm``; between two stages the
documents are written to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import fuzzy_lines, keys, langid, piece_fst, simhash, string_tiling
from ledgerloom.llm.shared import read, ready, remainder, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, or without one language that has half of them."""
    ready(spark)
    model = langid.fit(docs, remainder(3) != 1)
    return langid.keep_identified(docs, model, least_share=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier line; every document stays."""
    return fuzzy_lines.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups (3-word shingles, 3 bits): one document of each stays."""
    ready(spark)
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item has leaked."""
    return string_tiling.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    ready(spark)
    out = piece_fst.round_trip(docs, piece_fst.compile_model(keys.PIECES))
    return out.select("doc_id", "ids", "same")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: Union-find, Viterbi decoding and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
