"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this package.
BLANK = r"[\x20\x09-\x0D]"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session names none (tests on one machine) is a folder of our own set; on a cluster
    that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="engramic-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later stages then start from files that outlive any executor, and values that depend on the
    partitioning (partition ids, row ids) are fixed once.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches that carry whole texts, so that long documents fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Parts that the rows of one key are dealt to.
SALTS = 256


def with_totals(rows: DataFrame, key: list[str], part: list[Column], whole: list[Column], by: Column) -> DataFrame:
    """``rows`` and aggregates over their (not null) ``key``; no task meets all rows of a key.

    The rows of a key are dealt to SALTS parts by ``by``; ``part`` aggregates a part, ``whole`` the
    parts of a key, and the parts take the answer back to their rows.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(*key, "_salt").agg(*part)
    told = parts.select(*key, "_salt").join(parts.groupBy(*key).agg(*whole), key)
    return dealt.join(told, [*key, "_salt"]).drop("_salt")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def uniform(seed: str, key: Column) -> Column:
    """A reproducible number in [0, 2^60) for each key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 15), 16, 10).cast("long")
