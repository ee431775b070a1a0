"""The operators over their whole tables, one query each, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import ann, decontaminate, filter_audit, language_id, line_dedup, minhash, packing, passages, periodic, sharding, swap_packing, toxicity, url_filter
from tallyfold.sources.tables import dealt, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SHARDS, TABLE_SIZE = 64, 6421


def tokenizer_path() -> str:
    """The vocabulary file of the packing query; installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from all learning: crc32 of its id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules=RULES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), ["doc_id"], [f"shard-{i}" for i in range(SHARDS)], TABLE_SIZE)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")), order_by=F.xxhash64("doc_id"))
    return language_id.identify(docs, model).select("doc_id", "held_out", "language.*")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(dealt(table(spark, sf_dir, "documents")), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents")).select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    # The bounded sample is drawn from the labels, which are small rows; only then are its texts read.
    picked = toxicity.pick(labels, "toxic", F.xxhash64("doc_id"))
    model = toxicity.fit(docs.where(~F.col("held_out")).join(F.broadcast(picked), "doc_id"), order_by=F.xxhash64("doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "toxicity.score", "toxicity.predicted", "toxicity.sentences", "toxicity.offending")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack(dealt(table(spark, sf_dir, "documents")), tokenizer_path())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(dealt(table(spark, sf_dir, "documents")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_sharding, op3_language_id, op4_substring_dedup, op5_packing, op6_decontamination, op7_line_dedup, op8_ann, op9_minhash, op10_toxicity, op11_filter_audit, op12_swap_packing, op13_periodic_runs)
}


def oracles() -> dict[str, str]:
    """SQL can't express compression, chaining, tokenizing, forests or training; those queries have tests against plain versions or held-out rows instead."""
    return {
        "op1_url_filter": url_filter.oracle(RULES),
        "op2_sharding": sharding.oracle(SHARDS, TABLE_SIZE),
        "op6_decontamination": decontaminate.oracle(),
        "op7_line_dedup": line_dedup.oracle(),
        "op11_filter_audit": filter_audit.oracle(),
    }
