"""Sharding by proportional stratified interleaving.

Rows are ranked in seeded random order within their source, the ranks are divided by the size of
the source, and the rows of all sources are sorted by that fraction. Cutting this order into equal
runs gives shards whose mixture of sources is the mixture of the whole.

No rank is taken over a whole source in one task: a rank is the number of rows in lower hash
buckets (a prefix sum over bucket counts) plus the position within one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform

#: Rows that one bucket holds on average, and the least and greatest numbers of bits of a bucket.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 20_000, 10, 20


def _global_rank(rows: DataFrame, by: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """0-based rank of each row within ``by``, in the order of (bucket, order)."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(*by, bucket).orderBy(*order)
    return (
        rows.withColumn("_at", F.row_number().over(within) - 1)
        .join(offsets, [*by, bucket])
        .withColumn(out, F.col("_before") + F.col("_at"))
        .drop("_before", "_at")
    )


def interleave(
    docs: DataFrame,
    shards: int = 8,
    seed: str = "interleave-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
) -> DataFrame:
    """Assign every row to one of ``shards`` shards; row counts differ by at most one.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum. ``size`` is the
    UTF-8 length of the text (null: none) plus 1. Null sources form a stratum of their own; null
    texts have size 1 and the crc32 of the empty text; rows with equal ids are ordered by text
    digest and size, so that repeated rows take adjacent ranks; an empty table gives an empty
    result. Other columns are not read.
    """
    total = docs.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (total // BUCKET_ROWS).bit_length()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("")).alias("stratum"),
        # a null id is dealt by its text, so that many null ids do not share a bucket
        uniform(seed, F.coalesce(F.col(id_col).cast("string"), text)).alias("h"),
    )
    rows = rows.withColumn("b", F.shiftright("h", 60 - bits))
    tie = ["h", "doc_id", "text_crc32", "size"]
    ranked = _global_rank(rows, ["stratum"], "b", [F.col(c) for c in tie], "r")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # each stratum starts at a hashed phase, so that small strata do not all fall in the middle
    phase = F.shiftright(uniform(seed, F.col("stratum")), 40) / F.lit(float(1 << 20))
    placed = ranked.join(sizes, "stratum").withColumn("frac", (F.col("r") + phase) / F.col("n"))
    placed = placed.withColumn("fb", F.floor(F.col("frac") * F.lit(float(1 << bits)))).withColumn("all", F.lit(0))
    order = [F.col(c) for c in ("frac", "stratum", *tie)]
    placed = _global_rank(placed, ["all"], "fb", order, "pos")
    shard = F.expr(f"(pos * {shards}) div {max(total, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"pos - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum",
    )
