"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm.oracles import ORACLES  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.quality import quality_rules

    return quality_rules(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("text", "source", "clean_text")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One formatted pair per conversation; masks as ``start:end`` lists."""
    from atomweave.llm.preferences import conversation_pairs, format_preferences

    made = format_preferences(conversation_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return made.select(
        "conv_id", "other_id", "n_prompt_turns", "prompt", "chosen_text", "rejected_text", told(F.col("chosen_mask")).alias("chosen_mask"), told(F.col("rejected_mask")).alias("rejected_mask")
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from atomweave.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, and which of them match an earlier line of the corpus."""
    from atomweave.llm.line_dedup import matched_lines

    docs = documents(spark, sf_dir).select("doc_id", "text")
    removed = matched_lines(docs).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    removed = removed.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "gone")
    both = lines.join(removed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    return both.select("doc_id", F.col("n_lines").cast("long"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.substring_dedup import repeated_substrings

    return repeated_substrings(documents(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.html import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.divergence import source_divergence

    return source_divergence(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.lexical import ranked_search

    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from atomweave.llm.relative_parse import repeated_passages

    return repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_mixing_sources": op3_mixing_sources,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_secret_scans": op6_secret_scans,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_substring_dedup": op13_substring_dedup,
    "pipeline": pipeline,
}
