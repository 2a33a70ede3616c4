"""Writes of the tools as batches: each request gets an outcome, and the rows change by one join.

Requests come with ``seq``; where several name one row, the first that may be carried out stands, and the
others are told so. What is returned is the new table and the outcomes; the caller writes both beside the
old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions import metadata, rules
from engramic.functions.text import trim

# Forms of ids that name one row, and of prefixes.
WHOLE_ID = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|mem-md-\d+)$"
PREFIX = r"(?i)^[0-9a-f]{8,}$"
LEAST_PREFIX = 8


def accessible(scope: Column, scopes: list[str] | None) -> Column:
    """Whether a row's scope (null: global) may be touched: by all without a list, by nobody with an empty one."""
    return F.lit(True) if scopes is None else F.coalesce(scope, F.lit("global")).isin(scopes) if scopes else F.lit(False)


def resolved(rows: DataFrame, requests: DataFrame, scopes: list[str] | None) -> DataFrame:
    """``requests`` with target and problem: invalid (no form of an id), missing, ambiguous (a prefix of several rows), forbidden, or null.

    Whole ids meet rows by equality, prefixes by their first characters, so no request is compared with all rows.
    """
    form = F.when(F.col("id").rlike(WHOLE_ID), "whole").when(F.col("id").rlike(PREFIX), "prefix").otherwise("invalid")
    told = requests.withColumn("form", F.coalesce(form, F.lit("invalid"))).withColumn("start", F.lower(F.substring("id", 1, LEAST_PREFIX)))
    own = rows.select(F.col("id").alias("row_id"), F.coalesce("scope", F.lit("global")).alias("row_scope"))
    whole = told.where("form = 'whole'").select("seq", "id").join(own, F.col("id") == F.col("row_id")).select("seq", "row_id", "row_scope")
    begins = told.where("form = 'prefix'").select("seq", "id", "start").join(own.withColumn("start", F.lower(F.substring("row_id", 1, LEAST_PREFIX))), "start").where(F.startswith("row_id", F.col("id")))
    met = whole.union(begins.select("seq", "row_id", "row_scope")).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "row_scope")).alias("t"))
    out = told.join(met, "seq", "left")
    problem = F.when(F.col("form") == "invalid", "invalid").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(~accessible(F.col("t.row_scope"), scopes), "forbidden")
    return out.withColumn("problem", problem).withColumn("target", F.when(problem.isNull(), F.col("t.row_id"))).drop("form", "start", "n", "t")


def _first_each(told: DataFrame, done: str) -> DataFrame:
    """The outcome of each request: its problem, or ``done`` for the first of a row and superfluous for later ones."""
    nth = F.row_number().over(Window.partitionBy("target").orderBy("seq"))
    return told.withColumn("outcome", F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("target").isNotNull() & (nth > 1), "superfluous").otherwise(done)).drop("problem")


def stored(rows: DataFrame, new: DataFrame, now: int, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones, outcomes seq, id, outcome) of new(seq, text, vector, category, scope, importance, metadata).

    A row without a scope or, where ``dimension`` says so, with another vector is not stored. Texts that
    only repeat noise are not either. Ids are made of text, scope and ``seq``.
    """
    scope = trim(F.col("scope"))
    outcome = F.when(F.coalesce(scope, F.lit("")) == "", "no scope").when(F.coalesce(trim(F.col("text")), F.lit("")) == "", "empty").when(rules.is_noise(F.col("text")), "noise")
    if dimension is not None:
        outcome = outcome.when(F.coalesce(F.size("vector"), F.lit(-1)) != dimension, "wrong vector")
    digest = F.sha2(F.concat_ws("\x1f", "text", "scope", F.col("seq").cast("string")), 256)
    name = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    told = new.withColumn("outcome", outcome.otherwise("stored")).withColumn("id", F.when(F.col("outcome") == "stored", name))
    good = told.where("outcome = 'stored'").withColumns({"scope": scope, "importance": metadata.importance(F.col("importance")), "timestamp": F.lit(now), "metadata": F.coalesce("metadata", F.lit("{}"))})
    return rows.unionByName(good.select([c for c in rows.columns if c in good.columns]), allowMissingColumns=True), told.select("seq", "id", "outcome")


def imported(rows: DataFrame, new: DataFrame, dimension: int, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with the imported ones, outcomes id, outcome) of new(id, text, vector, category, scope, importance, timestamp, metadata).

    Rows keep their ids; without one, without a scope, or with another vector they are not taken. Old scales
    of importance are read where ``legacy`` says so, and times in seconds always.
    """
    outcome = F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.coalesce(F.size("vector"), F.lit(-1)) != dimension, "wrong vector").when(F.coalesce(trim(F.col("scope")), F.lit("")) == "", "no scope").otherwise("imported")
    told = new.withColumn("outcome", outcome)
    importance = metadata.legacy_importance if legacy else metadata.importance
    good = told.where("outcome = 'imported'").withColumns({"scope": trim(F.col("scope")), "importance": importance(F.col("importance")), "timestamp": metadata.timestamp_ms(F.col("timestamp"), F.lit(0)), "metadata": F.coalesce(F.nullif("metadata", F.lit("")), F.lit("{}"))})
    return rows.unionByName(good.select([c for c in rows.columns if c in good.columns]), allowMissingColumns=True), told.select("id", "outcome")


def forgotten(rows: DataFrame, requests: DataFrame, scopes: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(rows without the named ones, outcomes seq, id, target, outcome) of requests(seq, id)."""
    told = _first_each(resolved(rows, requests, scopes), "deleted")
    gone = told.where("outcome = 'deleted'").select(F.col("target").alias("id"))
    return rows.join(gone, "id", "left_anti").select(rows.columns), told.select("seq", "id", "target", "outcome")


def transformed(rows: DataFrame, changes: DataFrame, scopes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with changed metadata, outcomes id, outcome) of changes(id, patch map<string,string>): keys of the patch alone change.

    Outcomes: missing (or not accessible), unchanged (an empty or null patch), unparseable (metadata that is no
    JSON object stays as it is), updated. Null values of a patch leave their keys. Ids of changes are unique.
    """
    own = rows.where(accessible(F.col("scope"), scopes)).select("id", F.coalesce(F.nullif("metadata", F.lit("")), F.lit("{}")).alias("raw"), F.lit(True).alias("there"))
    told = changes.join(own, "id", "left")
    old = F.from_json("raw", "map<string,string>")
    readable = F.coalesce(F.json_object_keys("raw").isNotNull(), F.lit(False))
    patch = F.map_filter(F.coalesce("patch", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    outcome = F.when(F.col("there").isNull(), "missing").when(F.size(patch) == 0, "unchanged").when(~readable, "unparseable").otherwise("updated")
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)
    told = told.withColumn("outcome", outcome).withColumn("new", F.when(outcome == "updated", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))))
    after = rows.join(told.where("new IS NOT NULL").select("id", "new"), "id", "left").withColumn("metadata", F.coalesce("new", "metadata")).select(rows.columns)
    return after, told.select("id", "outcome")


def revised(rows: DataFrame, requests: DataFrame, now: int, scopes: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(rows after, outcomes seq, id, target, outcome) of requests(seq, id, text, importance, category): what the update tool does.

    ``rows`` need ``meta``. A new text of a versioned category does not overwrite a fact in force: the row ends, and a
    row of its own supersedes it (superseded). Else texts, importance and categories change in place (updated);
    nulls leave them. A request that changes nothing is told so (unchanged).
    """
    told = resolved(rows, requests, scopes)
    nothing = F.col("text").isNull() & F.col("importance").isNull() & F.col("category").isNull()
    told = _first_each(told.withColumn("problem", F.coalesce("problem", F.when(nothing, "unchanged"))), "updated")
    hits = told.where("outcome = 'updated'").select(F.col("target").alias("id"), "seq", F.col("text").alias("_text"), F.col("importance").alias("_importance"), F.col("category").alias("_category"))
    met = rows.join(hits, "id", "left")
    versioned = F.coalesce(F.col("meta.memory_category").isin(metadata.VERSIONED) & F.col("_text").isNotNull() & (F.col("_text") != F.col("text")) & metadata.active_at(F.lit(now)), F.lit(False))
    met = met.withColumn("_ends", versioned).withColumn("_new_id", F.concat(F.lit("mem-"), F.substring(F.sha2(F.concat_ws("\x1f", "id", "_text", F.col("seq").cast("string")), 256), 1, 32)))
    columns = [c for c in rows.columns if c != "meta"]
    importance = F.when(F.col("_importance").isNotNull(), metadata.importance(F.col("_importance"))).otherwise(F.col("importance"))
    end = metadata.built(F.col("metadata"), F.col("meta"), {"invalidated_at": F.lit(now), "superseded_by": F.col("_new_id"), "fact_key": F.col("meta.fact_key")}, F.col("timestamp"))
    fresh = {"l0_abstract": F.col("_text"), "l1_overview": F.concat(F.lit("- "), "_text"), "l2_content": F.col("_text")}
    inside = metadata.built(F.col("metadata"), F.col("meta"), fresh, F.col("timestamp"))
    kept = {
        "text": F.when(F.col("_ends"), F.col("text")).otherwise(F.coalesce("_text", "text")), "importance": F.when(F.col("_ends"), F.col("importance")).otherwise(importance),
        "category": F.when(F.col("_ends"), F.col("category")).otherwise(F.coalesce("_category", "category")),
        "metadata": F.when(F.col("_ends"), end).when(F.col("_text").isNotNull(), inside).otherwise(F.col("metadata")),
    }
    after = met.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in columns])
    start = metadata.built(F.col("metadata"), F.col("meta"), fresh | {"valid_from": F.lit(now), "invalidated_at": F.lit(0), "superseded_by": F.lit(""), "supersedes": F.col("id"), "fact_key": F.col("meta.fact_key"), "access_count": F.lit(0)}, F.col("timestamp"))
    new = {"id": F.col("_new_id"), "text": F.col("_text"), "importance": importance, "category": F.coalesce("_category", "category"), "timestamp": F.lit(now), "metadata": start}
    born = met.where("_ends").select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])
    ended = met.where("_ends").select("seq", F.lit("superseded").alias("_o"))
    outcomes = told.join(ended, "seq", "left").select("seq", "id", "target", F.coalesce("_o", "outcome").alias("outcome"))
    return after.unionByName(born), outcomes
