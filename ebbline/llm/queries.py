"""Named queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import decontamination, exact_dedup, host_rules, language_model, main_text, mixing, near_dedup, periodic_runs, quality, token_counts, url_filter, warc, whitening


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(read(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.convert(warc.pages_to_arc(read(spark, folder, "pages")))
    records = warc.resolve(warc.read_warc(spark, path))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date")


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_spans(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = exact_dedup.copy_groups(docs, carry={"text_sha256": exact_dedup.full_hash()})
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = [url_filter.host_path_rule(*rule) for rule in url_filter.CONTRACT_RULES]
    return url_filter.judge_urls(read(spark, folder, "pages"), rules).withColumnRenamed("id", "page_id")


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.document_sizes(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return mixing.mix(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = language_model.fit_language_model(docs)
    return language_model.score_documents(docs, model).withColumnRenamed("id", "doc_id")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    network = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs.select("doc_id", "text"), network)
    predicted = (F.col("quality_score") >= quality.KEPT_FROM).cast("int")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = host_rules.judge_by_host(read(spark, folder, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


def with_planted_run(own_id: object, text: bytes) -> list[bytes]:
    """Words of the text; where the CRC-32 of the id ends in 0, those from one word on repeat with a period. A null id plants nothing."""
    words = periodic_runs.split_words(own_id, text)
    mark = zlib.crc32(str(own_id).encode()) if own_id is not None else 1
    if mark % 10 or not words:
        return words
    rest, n = mark // 10, len(words)
    first = rest % n
    period = 1 + (n - first) // (3 + rest % 8)
    root = words[first : first + period]
    return words[:first] + (root * -(-(n - first) // period))[: n - first]


def sha256_of_words(words: Sequence[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(read(spark, folder, "documents"), words_of=with_planted_run, render=sha256_of_words)
    # Quotients of whole numbers below 2^26 are equal, or ordered, as doubles just as they are exactly.
    ranked = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", F.when(F.size("runs") > 0, F.array_min(ranked)))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    fit = whitening.fit_whitening(vectors)
    error = whitening.identity_error(vectors, fit) if fit else 0.0
    white = whitening.whiten(vectors, fit)
    return white.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_token_counts,
        op3_arc_to_warc,
        op4_minhash_near_dedup,
        op5_decontamination,
        op6_exact_dedup,
        op7_url_filter,
        op8_source_mix,
        op9_pseudo_likelihood,
        op10_quality_classifier,
        op11_host_rules,
        op12_periodic_runs,
        op13_embedding_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op8_source_mix": mixing.ORACLE_SQL,
    "op11_host_rules": host_rules.ORACLE_SQL,
}
