"""The registered queries of the subpackage: thin wrappers with production
parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, chat_repair, fuzzy_lines, kneser_ney, langid, nbsvm, periodic_runs, piece_fst, simhash, string_tiling, substring_dedup, url_filters, vptree
from ledgerloom.llm.shared import read, remainder

#: SentencePiece model of the registered query (installed with the public tokenizers).
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

Job = Callable[[SparkSession, str], DataFrame]


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder(5) == 0
    model = nbsvm.fit(docs, read(spark, sf_dir, "labels"), ~held_out, "quality")
    return _judged(nbsvm.score(docs, model), held_out)


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_vantage_point_search(spark: SparkSession, sf_dir: str, factor: float = 1.05) -> DataFrame:
    found = vptree.nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, factor=factor)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder(4) == 2
    model = kneser_ney.fit(docs, read(spark, sf_dir, "labels"), ~held_out, "toxic")
    return _judged(kneser_ney.score(docs, model), held_out)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.drop_lines(read(spark, sf_dir, "documents"), removed="removed_lines")
    return out.select("doc_id", F.size("removed_lines").alias("n_removed"), "removed_lines",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), url_filters.RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder(3) == 1
    labelled = langid.label(docs, langid.fit(docs, ~held_out))
    return labelled.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    out = piece_fst.round_trip(read(spark, sf_dir, "documents"), piece_fst.compile_model(model))
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                      F.col("same").alias("round_trip"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.collapse(periodic_runs.cycled(read(spark, sf_dir, "documents")))
    out = out.withColumn("best", periodic_runs.strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      _hex_digest(listed).alias("runs_sha256"), _hex_digest(F.col("collapsed")).alias("collapsed_sha256"))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    fixed = chat_repair.repair(chat_repair.damaged(rows))
    digests = chat_repair.digests(fixed.messages)
    out = rows.select(F.col("conv_id").alias("original")).distinct()
    for part in (fixed.summary, digests):
        out = out.join(part, out["original"].eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    figures = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("original").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", _hex_digest(F.lit(""))).alias("repaired_sha256"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(chat_format.PROBE, chat_format.PROBE_SCHEMA)
    chats = chat_format.format_chats(rows.unionByName(probe)).select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _hex_digest(said).alias("turns_sha256"),
                        F.length("learned").cast("long").alias("loss_chars"), _hex_digest(F.col("learned")).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


def _hex_digest(text):
    return F.sha2(text.cast("binary"), 256)


QUERIES: dict[str, Job] = {
    "op1_nbsvm_quality": op1_nbsvm_quality,
    "op2_vantage_point_search": op2_vantage_point_search,
    "op3_kneser_ney_toxicity": op3_kneser_ney_toxicity,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_url_filters": op5_url_filters,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_string_tiling": op8_string_tiling,
    "op9_language_id": op9_language_id,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_repair": op12_chat_repair,
    "op13_chat_format": op13_chat_format,
}

ORACLE: dict[str, str] = {
    "op5_url_filters": url_filters.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op12_chat_repair": chat_repair.ORACLE_SQL,
    "op13_chat_format": chat_format.ORACLE_SQL,
}
