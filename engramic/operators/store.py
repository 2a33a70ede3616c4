"""The store's reads and writes as DataFrame operations on memory rows.

Writes return the new table; the caller writes it beside the old one and swaps, so that a lost
job leaves the old table whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions.metadata import importance
from engramic.functions.text import trim


def scoped(rows: DataFrame, scopes: list[str] | None) -> DataFrame:
    """None: all rows; []: none; else rows of these scopes (rows without a scope never)."""
    return rows if scopes is None else rows.where(F.col("scope").isin(scopes) if scopes else F.lit(False))


def listed(rows: DataFrame, scopes: list[str] | None, categories: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, equal times by id."""
    rows = scoped(rows, scopes)
    rows = rows.where(F.col("category").isin(categories)) if categories else rows
    return rows.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def by_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.col("id").startswith(prefix))


def rejected_reason(rows: DataFrame) -> Column:
    """Why a new row may not be stored, or null."""
    return (
        F.when(F.coalesce(trim(F.col("text")), F.lit("")) == "", "empty text")
        .when(F.coalesce(trim(F.col("scope")), F.lit("")) == "", "blank scope")
    )


def appended(rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the valid new ones, the invalid ones with their reason)."""
    judged = new.withColumn("reason", rejected_reason(new))
    good = judged.where(F.col("reason").isNull()).drop("reason").withColumn("scope", trim(F.col("scope"))).withColumn("importance", importance(F.col("importance")))
    return rows.unionByName(good, allowMissingColumns=True), judged.where(F.col("reason").isNotNull())


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def upserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in place of the ones with their ids; ids in `new` are unique."""
    return rows.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(rows: DataFrame, scopes: list[str], before: int) -> DataFrame:
    """Without the rows of these scopes from before a time."""
    gone = F.coalesce(F.col("scope").isin(scopes) & (F.col("timestamp") < before), F.lit(False))
    return rows.where(~gone)


def updated(rows: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the patches replace those of the rows with their ids where they are not null."""
    new = patches.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, "id", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def access_merged(accesses: DataFrame) -> DataFrame:
    """Accesses(id, at) as one row an id: their number and the last of them."""
    return accesses.groupBy("id").agg(F.count(F.lit(1)).alias("accesses"), F.max("at").alias("last_at"))


def scope_repaired(rows: DataFrame, target: str) -> DataFrame:
    return rows.withColumn("scope", F.when(F.coalesce(trim(F.col("scope")), F.lit("")) == "", F.lit(target)).otherwise(F.col("scope")))
