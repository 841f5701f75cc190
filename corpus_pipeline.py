"""Corpus preparation: quality rules, line dedup, near-duplicate documents, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm.line_dedup import dedup_lines
from atomweave.llm.mixing import mixed_texts
from atomweave.llm.ngram_join import ngram_jaccard_join
from atomweave.llm.packing import pack_documents
from atomweave.llm.quality import quality_rules
from atomweave.session import cut

#: SQL can't express tokenised packing; the tests hold each stage's operator against brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator needs, and the others as one, so that their names can't clash with what it adds."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    own = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return rows.select(*[(own[c] if c in own else F.col("_rest").getField(c)).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host share.

    Null and empty texts have no words and are rejected. Repeated rows are judged alike and all stay or go; a null
    doc_id or source is a value like others. An empty table stays empty; other columns are kept, whatever their names.
    """
    kept = quality_rules(_packed(docs, "doc_id", "text", "source")).where("kept").withColumn("text", F.col("clean_text"))
    return _unpacked(kept, docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; documents with no words left go, null texts too.

    Earlier is a smaller doc_id (null last), then a smaller text hash, then a smaller line number, so ties are decided.
    Repeated rows lose the same lines. An empty table stays empty; other columns are kept.
    """
    left = dedup_lines(_packed(docs, "doc_id", "text"))
    return _unpacked(left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id; rows without doc_id stay.

    Documents without words are linked with nothing and stay. Rows of one doc_id stay or go together, repeated ones too.
    An empty table stays empty; other columns are kept.
    """
    members = ngram_jaccard_join(docs.select("doc_id", "text"))
    gone = members.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row per reading of a document; documents that it takes whole stay whole.

    Documents without words give no rows. The null source is the last one; repeated rows are read each for itself. Equal
    rows can't be told apart, so it makes no difference which of them is read. An empty table stays empty.
    """
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens: ``pack_documents``' columns.

    A null or empty text is its end token alone; each row is packed for itself, with or without a doc_id.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("mixing sources", mix), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
