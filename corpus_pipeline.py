"""The corpus pipeline: five stages, each of which takes the documents that the one before has kept.

Toxic documents go, one row of each group of equal and of similar texts stays, documents with
benchmark passages go, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from engramic.llm.common import DOCUMENT_COLUMNS, materialize, table


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The documents in keep(doc_id, text_hash), of rows repeated in full one."""

    def key(text_hash: Column) -> list[Column]:
        return [text_hash.alias("_text"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]

    own = docs.select(*DOCUMENT_COLUMNS, *key(F.xxhash64("text")))
    # rows meet once, by their keys, for both steps
    both = own.join(keep.select(*key(F.col("text_hash"))), ["_text", "_id", "_none"], "left_semi")
    return both.dropDuplicates(["_text", "_id", "_none"]).select(*DOCUMENT_COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is not toxic, as they are; learned from ``labels`` of the documents.

    Null and empty texts and, without labels of both kinds, all rows stay. Repeated rows and null
    ids are rows like others; an empty table gives an empty one; other columns than those of
    documents are dropped, here and in the next stages.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*DOCUMENT_COLUMNS), model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for blanks: the longest, then the least id.

    Null texts count as empty, so one of all empty texts stays; of rows repeated in full one stays;
    null ids come last.
    """
    return _only(docs, exact_dedup.mark_duplicates(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by similarity (words of five, 0.8): that of the least id.

    Texts without words stay, but of rows repeated in full one; null ids come last.
    """
    return _only(docs, near_dedup.near_duplicates(docs).where("first"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of ``benchmark``; null and empty texts stay.

    A row is told by its id and text, so neither a null nor a repeated id takes other rows with it;
    repeated rows stay or go together.
    """
    own = docs.select(*DOCUMENT_COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_row"))
    leaks = decontamination.find_leaks(own, table(spark, sf_dir, "benchmark"), id_col="_row").select(F.col("doc_id").alias("_row"))
    return own.join(materialize(spark, leaks.distinct(), "leaks"), "_row", "left_anti").select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences; a null or empty text is a document of the closing id alone."""
    return packing.pack(docs, packing.default_tokenizer()).drop("ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned weights, q-gram searches and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
