"""The store's tools as DataFrame operations: promotion, archive, resolution, ids, upgrade, migration, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions import governance, metadata
from engramic.functions.text import trim


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def patched(raw: Column, changes: dict[str, Column]) -> Column:
    """JSON metadata with some string or number fields replaced; null changes leave a field, unparseable metadata starts anew.

    Values are kept as text, as all readers of this library take "5" and 5 for one.
    """
    old = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in changes.items()])
    new = F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull()))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    entries = F.array_sort(F.map_entries(F.map_concat(kept, new)))
    return F.to_json(F.map_from_entries(entries))


def promoted(rows: DataFrame, ids: DataFrame, layer: str = "durable") -> DataFrame:
    """Rows of ids(id) confirmed, in a layer, and without strikes; others as they are."""
    told = rows.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    new = patched(F.col("metadata"), {"state": F.lit("confirmed"), "memory_layer": F.lit(layer), "bad_recall_count": F.lit(0), "suppressed_until_ms": F.lit(0)})
    return told.withColumn("metadata", F.when(F.col("_hit"), new).otherwise(F.col("metadata"))).drop("_hit")


def archived(rows: DataFrame, ids: DataFrame) -> DataFrame:
    told = rows.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    new = patched(F.col("metadata"), {"state": F.lit("archived"), "memory_layer": F.lit("archive")})
    return told.withColumn("metadata", F.when(F.col("_hit"), new).otherwise(F.col("metadata"))).drop("_hit")


def resolved(rows: DataFrame, ids: DataFrame, at: int, by: str) -> DataFrame:
    """Unresolved reflection items of ids(id) with the time and author of their resolution."""
    told = rows.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    open_ = F.coalesce(F.get_json_object("metadata", "$.type") == "memory-reflection-item", F.lit(False)) & F.get_json_object("metadata", "$.resolvedAt").isNull()
    new = patched(F.col("metadata"), {"resolvedAt": F.lit(at), "resolvedBy": F.lit(by)})
    return told.withColumn("metadata", F.when(F.col("_hit") & open_, new).otherwise(F.col("metadata"))).drop("_hit")


def found_by_reference(rows: DataFrame, references: DataFrame, least: int = 8) -> DataFrame:
    """references(ref) -> ref, id, matches: by the whole id, else by a prefix of ``least`` characters that one row alone has."""
    whole = references.join(rows.select("id"), F.col("ref") == F.col("id"), "left_semi").select("ref", F.col("ref").alias("id"), F.lit(1).cast("long").alias("matches"))
    rest = references.join(whole, "ref", "left_anti").where(F.length("ref") >= least)
    begins = rows.select("id", F.substring("id", 1, least).alias("_b")).join(rest.withColumn("_b", F.substring("ref", 1, least)), "_b").where(F.startswith("id", F.col("ref")))
    counted = begins.groupBy("ref").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("matches"))
    return whole.union(counted.select("ref", F.when(F.col("matches") == 1, F.col("id")).alias("id"), "matches"))


def superseded(rows: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """``rows`` and ``new``; the active rows with a new row's fact key end at a time and name their successor. ``rows`` and ``new`` need ``meta``."""
    keys = new.select(trim(F.lower("meta.fact_key")).alias("_key"), F.col("id").alias("_by")).where("_key IS NOT NULL")
    own = rows.withColumn("_key", trim(F.lower("meta.fact_key"))).join(keys, "_key", "left")
    ends = F.col("_by").isNotNull() & metadata.active_at(F.lit(at))
    changed = patched(F.col("metadata"), {"invalidated_at": F.lit(at), "superseded_by": F.col("_by")})
    return own.withColumn("metadata", F.when(ends, changed).otherwise(F.col("metadata"))).select(*rows.columns).unionByName(new, allowMissingColumns=True)


def upgraded(rows: DataFrame) -> DataFrame:
    """Legacy rows (with ``meta``) with a stamped category and three summary levels; others as they are."""
    level = governance.simple_levels(F.col("text"))
    new = patched(F.col("metadata"), {"memory_category": F.col("meta.memory_category"), "l0_abstract": level["l0"], "l1_overview": level["l1"], "l2_content": level["l2"]})
    return rows.withColumn("metadata", F.when(governance.is_legacy(F.col("category"), F.col("meta")), new).otherwise(F.col("metadata")))


def evolved(rows: DataFrame) -> DataFrame:
    """Rows of an older table with the columns that it lacks, at their defaults."""
    defaults = {"scope": F.lit("global"), "timestamp": F.lit(0).cast("long"), "metadata": F.lit("{}")}
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def in_milliseconds(rows: DataFrame) -> DataFrame:
    """Times in seconds of old rows times 1000."""
    at = F.col("timestamp")
    return rows.withColumn("timestamp", F.when((at > 0) & (at < metadata.SECONDS_BELOW), at * 1000).otherwise(at))


def migrated(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of an old table(id, text, importance, category, createdAt) that are not in the store, in its form."""
    new = old.join(rows.select("id"), "id", "left_anti")
    return new.select(
        "id", "text", F.when(F.col("category").isin(metadata.OLD_CATEGORIES), F.col("category")).otherwise("other").alias("category"), F.lit("global").alias("scope"),
        metadata.legacy_importance(F.col("importance")).alias("importance"), metadata.timestamp_ms(F.col("createdAt"), F.lit(0)).alias("timestamp"),
        F.to_json(F.struct(F.lit("migration").alias("source_session"), F.col("category").alias("original_category"))).alias("metadata"),
    )


def versions_deduplicated(rows: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each text, by time and id; texts differ by more than case and spaces."""
    key = F.lower(F.regexp_replace(trim(F.col(text)), r"\s+", " "))
    return first_rows(rows.withColumn("_key", key).where("_key != ''"), ["_key"], [F.col("timestamp"), F.col("id")], 1).drop("_key")
