"""Queries of files and long texts: transcripts, Markdown, notes, chunks and code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.plans.memories import MEM_SQL, TRIM, memories, table
from engramic.sources import files

_LINES = "'{\"message\":{\"role\":\"user\",\"content\":\"hello ' || CAST(doc_id % 9 AS STRING) || '\"}}' || chr(10) || 'not json' || chr(10) || '{\"message\":{\"role\":\"assistant\",\"content\":[{\"text\":\"one\"},{\"type\":\"x\"},{\"text\":\"two\"}]}}' || chr(10) || '{\"message\":{\"role\":\"\",\"content\":\"lost\"}}'"
_NOTES = "CASE WHEN doc_id % 2 = 0 THEN '\ufeff' ELSE '' END || '- first point ' || CAST(doc_id % 8 AS STRING) || chr(13) || chr(10) || 'plain' || chr(10) || '  * second point' || chr(10) || '+ no'"
_CODE = "CASE doc_id % 5 WHEN 0 THEN 'def run(x):' || chr(10) || '  return x' WHEN 1 THEN 'const a = () => 1' WHEN 2 THEN 'export interface A' || chr(10) || 'const f = (x: string) => x' WHEN 3 THEN 'plain words' ELSE 'import os' || chr(10) || 'class A:' END"


def _docs(spark, sf_dir, name: str, sql: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(sql).alias(name))


def a36_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "content", _LINES).select("id", files.transcript(F.col("content")).alias("text"))


def a43_markdown_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all files that the store lacks; here it has those that end in 3."""
    found = files.bullets(_docs(spark, sf_dir, "content", _NOTES).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("path"), "content"))
    there = found.where(F.col("text").endswith("3")).select("text", F.lit("global").alias("scope"))
    return files.imported(found, there, "global").select("path", "line", "text")


def a44_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.note(memories(spark, sf_dir))


def k7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.chunked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def k11_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.chunked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), by_lines=True)


def k10_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text", _CODE).select("id", files.code_language(F.col("text")).alias("language"))


_SQL = {
    "a36_transcript": "SELECT doc_id AS id, '## user' || chr(10) || 'hello ' || (doc_id % 9) || chr(10) || chr(10) || '## assistant' || chr(10) || 'one' || chr(10) || 'two' AS text FROM documents",
    "a43_markdown_import": "SELECT min(path) AS path, min(line)::INTEGER AS line, text FROM (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, 1 AS line, 'first point ' || (doc_id % 8) AS text FROM documents UNION ALL SELECT lpad(doc_id::VARCHAR, 9, '0'), 3, 'second point' FROM documents) WHERE NOT ends_with(text, '3') GROUP BY text",
    "a44_notes": f"WITH {MEM_SQL} SELECT id, '---' || chr(10) || 'id: \"' || id || '\"' || chr(10) || 'category: \"' || category || '\"' || chr(10) || 'scope: \"' || scope || '\"' || chr(10) || 'importance: ' || importance || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(text, {TRIM}) || chr(10) AS note FROM mem",
    "k10_code_language": "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 4 THEN 'python' END AS language FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (a36_transcript, a43_markdown_import, a44_notes, k7_chunks, k11_line_chunks, k10_code_language)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
