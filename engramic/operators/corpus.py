"""Keeping stored chunks of files in step with the files: add, keep, replace and remove, by one join of fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What names a file, and a chunk of it.
DOCUMENT = ["workspace", "agent", "source", "path"]
CHUNK = [*DOCUMENT, "first_line", "last_line"]
_FIELDS = {"workspace": "workspaceDir", "agent": "agentId", "source": "source", "path": "path", "fingerprint": "fingerprint"}


def chunk_id(chunk: Column | None = None) -> Column:
    """The id of a chunk by its place; other text at the same place has the same id."""
    parts = [F.col(c) if chunk is None else chunk[c] for c in CHUNK]
    return F.concat(F.lit("corpus:"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 48))


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks(workspace, agent, source, path, first_line, last_line, text) with id, fingerprint and the metadata that the store keeps."""
    stamped = chunks.withColumns({"id": chunk_id(), "fingerprint": F.sha2(F.coalesce("text", F.lit("")), 256)})
    fields = [F.col(c).alias(f) for c, f in _FIELDS.items()]
    return stamped.withColumn("metadata", F.to_json(F.struct(F.lit(True).alias("corpus"), *fields, F.col("first_line").alias("startLine"), F.col("last_line").alias("endLine"))))


def stored_refs(rows: DataFrame) -> DataFrame:
    """id, workspace, agent, source, path, fingerprint of the store's chunks; other rows are left out."""
    parsed = F.from_json("metadata", "struct<" + ",".join(f"{f}:string" for f in _FIELDS.values()) + ">")
    refs = rows.where(F.col("id").startswith("corpus:")).select("id", parsed.alias("m"))
    return refs.select("id", *[F.col(f"m.{f}").alias(c) for c, f in _FIELDS.items()])


def sync_plan(chunks: DataFrame, refs: DataFrame, active: DataFrame, failed: DataFrame) -> DataFrame:
    """id, action for every chunk of a file or of the store.

    add: not stored; replace: stored with another fingerprint; keep: stored alike. A stored chunk that
    no file has goes (remove) if its workspace and agent are among ``active`` and its document is not
    among ``failed``, whose chunks could not be read; else, and where the metadata names no place, it
    stays (keep). Chunks of failed documents are not written (skip, if not stored: else keep).
    One full join by id; ``active`` and ``failed`` meet it by keys that spread over the documents.
    """
    bad = failed.select(*DOCUMENT, F.lit(True).alias("bad")).distinct()
    new = chunks.select("id", "fingerprint", *DOCUMENT).join(bad, DOCUMENT, "left").select("id", F.col("fingerprint").alias("new"), F.coalesce("bad", F.lit(False)).alias("bad"))
    watched = active.select("workspace", "agent", F.lit(True).alias("watched")).distinct()
    old = refs.join(watched, ["workspace", "agent"], "left").join(bad.withColumnRenamed("bad", "unread"), DOCUMENT, "left")
    old = old.select("id", F.lit(True).alias("stored"), F.col("fingerprint").alias("old"), (F.coalesce("watched", F.lit(False)) & ~F.coalesce("unread", F.lit(False))).alias("removable"))
    met = new.join(old, "id", "full_outer")
    action = (
        F.when(F.col("new").isNull(), F.when(F.col("removable"), "remove").otherwise("keep"))
        .when(F.col("bad"), F.when(F.col("stored"), "keep").otherwise("skip"))
        .when(F.col("stored").isNull(), "add")
        .when(F.col("new").eqNullSafe(F.col("old")), "keep")
        .otherwise("replace")
    )
    return met.select("id", action.alias("action"))


def synced(rows: DataFrame, chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` without what the plan removes or replaces, and its new chunks (with the columns of ``rows`` that they have)."""
    left = rows.join(plan.where("action IN ('remove', 'replace')").select("id"), "id", "left_anti")
    new = chunks.join(plan.where("action IN ('add', 'replace')").select("id"), "id", "left_semi")
    return left.unionByName(new.select([c for c in rows.columns if c in new.columns]), allowMissingColumns=True)


def sync_stats(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """documents, chunks, indexed, skipped, stale_deleted of a run."""
    told = plan.agg(*[F.count_if(F.col("action").isin(kinds)).alias(name) for name, kinds in (("indexed", ["add", "replace"]), ("skipped", ["skip"]), ("stale_deleted", ["remove"]))])
    seen = chunks.agg(F.count_distinct(*DOCUMENT).alias("documents"), F.count(F.lit(1)).alias("chunks"))
    return seen.crossJoin(told)  # one row beside one row
